"""A topology document in a file, replaced by rename; and what a router takes from it.

A newer epoch replaces the active topology if it is sound; the same or an older one, or one that can't be used, does not.
Seeing the active epoch confirmed renews the write lease.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from keyspan.functions.keyspace import KeyspaceError
from keyspan.operators.control import Freshness
from keyspan.plans.catalog import Topology, TopologyError


def load(path: str) -> Topology:
    """A validated topology; whatever is wrong with the document is a TopologyError."""
    try:
        with open(path, encoding="utf-8") as f:
            return Topology.from_json(json.load(f)).validate()
    except (OSError, ValueError, KeyError, TypeError, KeyspaceError) as error:
        raise error if isinstance(error, TopologyError) else TopologyError(f"{path}: {error}") from error


class Watcher:
    """Holds the active topology of a file. poll() is called by whoever keeps time.

    build makes what is served (an engine, say) from a topology; if it fails the one before stays.
    """

    def __init__(self, path: str, build: Callable[[Topology], object] = lambda t: t.routable(), boot: Callable[[], float] = time.monotonic, wall: Callable[[], float] = time.time):
        self.path, self.build, self.boot, self.wall = path, build, boot, wall
        self.topology: Topology | None = None
        self.active: object = None
        self.fault: str | None = None
        self.freshness = Freshness(0)

    def poll(self) -> bool:
        """Whether a new topology became active. Clocks are read before the file: what is read can't be older than said."""
        boot, wall = self.boot(), self.wall()
        try:
            found = load(self.path)
        except TopologyError as error:
            self.fault = str(error)
            return False
        if self.topology is not None and found.epoch <= self.topology.epoch:
            if found == self.topology:
                self.freshness.confirm(found.epoch, boot, wall)
                self.fault = None
            return False
        try:
            active = self.build(found)
        except (TopologyError, KeyspaceError) as error:
            self.fault = str(error)
            return False
        self.topology, self.active, self.fault = found, active, None
        self.freshness = Freshness(found.lease_seconds)
        self.freshness.confirm(found.epoch, boot, wall)
        return True

    def may_write(self) -> bool:
        return self.topology is not None and self.freshness.may_write(self.boot(), self.wall())
