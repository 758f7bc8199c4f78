"""Decisions of a control plane that have state: gates, epochs, leases, statement logs, workflow registry.

Clocks are passed in, so that time is whatever the caller says.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.functions.keyspace import KeyRange, in_range

REPLAN, EXPIRED, REJECTED = "replan", "expired", "rejected"
GATE_FULL = "40001"


@dataclass(frozen=True)
class Scope:
    """What a statement touches."""

    tables: tuple[str, ...] = ()
    positions: tuple[int, ...] = ()
    is_write: bool = True


@dataclass(frozen=True)
class Gate:
    id: str
    deadline: float
    writes_only: bool = True
    everything: bool = False
    tables: tuple[str, ...] = ()
    ranges: tuple[KeyRange, ...] = ()
    min_generation: int = 0

    def holds(self, scope: Scope) -> bool:
        if self.writes_only and not scope.is_write:
            return False
        return self.everything or bool(set(self.tables) & set(scope.tables)) or any(p in r for p in scope.positions for r in self.ranges)


@dataclass
class Session:
    """A parked statement; outcome is None until it is released."""

    since: float
    outcome: str | None = None
    generation: int | None = None
    gone: bool = False


@dataclass
class _Held:
    gate: Gate
    parked: deque[Session] = field(default_factory=deque)
    armed: bool = False


class GateEngine:
    """Parks statements while gates are closed. After a release a statement is planned anew and checked again."""

    def __init__(self, per_gate: int = 5000, total: int = 50_000, max_wait: float = 20.0):
        self.per_gate, self.total, self.max_wait = per_gate, total, max_wait
        self.generation, self._gates = 0, {}

    def close(self, gate: Gate) -> None:
        """Closes a gate, or replaces one of that id, which keeps what is parked and an open that is pending."""
        if gate.id in self._gates:
            self._gates[gate.id].gate = gate
        else:
            self._gates[gate.id] = _Held(gate)

    def open(self, gate_id: str, now: float) -> None:
        """Releases a gate, or arms it until its generation is there. After the deadline it expires."""
        if held := self._gates.get(gate_id):
            held.armed = True
            self._settle(held, now)

    def topology_applied(self, generation: int, now: float) -> None:
        self.generation = max(self.generation, generation)
        for held in list(self._gates.values()):
            if held.armed:
                self._settle(held, now)

    def _settle(self, held: _Held, now: float) -> None:
        """An armed gate lets go once its generation is there; until then it is left to its deadline."""
        if held.gate.min_generation > self.generation:
            return
        self._release(held, EXPIRED if held.gate.deadline <= now else REPLAN)

    def _release(self, held: _Held, outcome: str) -> None:
        del self._gates[held.gate.id]
        for s in held.parked:  # first come, first out
            s.outcome, s.generation = outcome, self.generation if outcome == REPLAN else None

    def expire_due(self, now: float) -> int:
        due = [h for h in self._gates.values() if h.gate.deadline <= now]
        for held in due:
            self._release(held, EXPIRED)
        return len(due)

    def check(self, scope: Scope, now: float) -> Session | None:
        """None to go on; else the session to wait on, which may be rejected already."""
        held = next((h for h in self._gates.values() if h.gate.holds(scope)), None)
        if held is None:
            return None
        for h in self._gates.values():  # who has hung up takes no room
            h.parked = deque(s for s in h.parked if not s.gone)
        session = Session(now)
        if len(held.parked) >= self.per_gate or sum(len(h.parked) for h in self._gates.values()) >= self.total:
            session.outcome = REJECTED
        else:
            held.parked.append(session)
        return session

    def reject_overdue(self, now: float) -> int:
        n = 0
        for held in self._gates.values():
            late = [s for s in held.parked if not s.gone and now - s.since > self.max_wait]
            for s in late:
                s.outcome = REJECTED
            held.parked = deque(s for s in held.parked if not s.gone and s.outcome is None)
            n += len(late)
        return n

    def status(self) -> list[tuple[str, int]]:
        return [(h.gate.id, len(h.parked)) for h in self._gates.values()]


class DecisionError(ValueError):
    """A decision that must not be applied."""


class EpochGuard:
    """Applies decisions in the order of their epochs, each once."""

    def __init__(self) -> None:
        self.applied: tuple[int, str] | None = None

    def check(self, epoch: int, key: str) -> str:
        """`apply`, or `replay` for the decision that was applied last."""
        if epoch < 1:
            raise DecisionError("decision epochs start at 1")
        last, last_key = self.applied or (0, "")
        if epoch < last:
            raise DecisionError(f"epoch {epoch} is behind {last}")
        if epoch == last and key != last_key:
            raise DecisionError(f"epoch {epoch} was used for another decision")
        return "replay" if epoch == last else "apply"

    def commit(self, epoch: int, key: str) -> None:
        """Records a decision once it has succeeded."""
        if self.applied is None or epoch > self.applied[0]:
            self.applied = (epoch, key)


class StatementLog:
    """Runs each schema statement once for its id. An id is bound to its text for good."""

    def __init__(self) -> None:
        self._log: dict[str, list[str]] = {}

    def claim(self, id_: str, sql: str) -> str:
        """`execute`, or `replay` if it is done."""
        if not id_:
            raise DecisionError("a statement needs an id")
        entry = self._log.setdefault(id_, [sql, "new"])
        if entry[0] != sql:
            raise DecisionError(f"{id_} was used for another statement")
        if entry[1] == "running":
            raise DecisionError(f"{id_} is running")
        if entry[1] == "done":
            return "replay"
        entry[1] = "running"
        return "execute"

    def finish(self, id_: str, ok: bool) -> None:
        self._log[id_][1] = "done" if ok else "failed"


class Freshness:
    """How old the active topology's confirmation is. Two clocks, so that neither a suspended host nor a set clock hides age."""

    def __init__(self, lease: float):
        self.lease, self._at, self._epoch = lease, None, 0

    def confirm(self, epoch: int, boot: float, wall: float) -> None:
        """A confirmation read at these times (taken before the read); older ones are ignored."""
        if self._at is None or (epoch >= self._epoch and boot >= self._at[0]):
            self._at, self._epoch = (boot, wall), epoch

    def age(self, boot: float, wall: float) -> float:
        if self._at is None:
            return float("inf")
        ages = boot - self._at[0], wall - self._at[1]
        return float("inf") if ages[0] < 0 else max(ages)

    def may_write(self, boot: float, wall: float) -> bool:
        return self.age(boot, wall) < self.lease


class Workflows:
    """Named runs: starting the same one again is no start, another one of its name is a conflict."""

    def __init__(self) -> None:
        self._runs: dict[str, tuple[object, str]] = {}

    def start(self, id_: str, spec: object) -> bool:
        """True if it must be started now."""
        if id_ in self._runs and self._runs[id_][1] == "running":
            if self._runs[id_][0] != spec:
                raise DecisionError(f"workflow {id_} runs with another specification")
            return False
        self._runs[id_] = (spec, "running")
        return True

    def stop(self, id_: str, state: str = "stopped") -> None:
        if id_ in self._runs:
            self._runs[id_] = (self._runs[id_][0], state)

    def statuses(self, ids: Sequence[str] = ()) -> dict[str, str]:
        return {k: v[1] for k, v in self._runs.items() if not ids or k in ids}


def xid_horizon(base: int, versions: Sequence[int]) -> int | None:
    """The first of the 32-bit transaction ids to come round after base."""
    return min(versions, key=lambda v: (v - base) % (1 << 32), default=None)


# --- the same decisions for many at once ----------------------------------------------------------------------------


def held_by(statements: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """statements (tables array<string>, positions array<long>, is_write) with `gate`, the id of the first gate that holds them."""
    out = F.lit(None).cast("string")
    for g in reversed(gates):
        hit = F.lit(g.everything) | F.arrays_overlap("tables", F.array(*[F.lit(t) for t in g.tables]).cast("array<string>"))
        inside = lambda p, ranges=g.ranges: reduce(Column.__or__, [in_range(p, r) for r in ranges])
        if g.ranges:
            hit |= F.exists("positions", lambda p: inside(p))  # noqa: B023
        out = F.when(hit & (F.col("is_write") if g.writes_only else F.lit(True)), g.id).otherwise(out)
    return statements.withColumn("gate", out)


def gate_outcomes(sessions: DataFrame, gates: DataFrame, generations: DataFrame, max_wait: float) -> DataFrame:
    """sessions (gate, session, since double) with `outcome`, for gates (gate, opened, deadline, min_generation) that were closed before them.

    opened null: never. generations (generation, at double): when topologies were applied. A gate that was opened lets go
    once its generation is there, one that was not by its deadline expires. A session that waits longer than max_wait is
    rejected, and one that comes after its gate has let go isn't held: its outcome is null.
    """
    # a row for each gate that waits for a topology and each topology that does for it
    ready = gates.join(generations, generations["generation"] >= gates["min_generation"]).groupBy("gate").agg(F.min("at").alias("ready"))
    g = gates.join(ready, "gate", "left")
    settled = F.when(F.col("min_generation") <= 0, F.col("opened")).otherwise(F.greatest("opened", F.when(F.col("ready").isNotNull() & F.col("opened").isNotNull(), F.col("ready"))))
    ready_in_time = F.when(F.col("opened").isNotNull() & ((F.col("min_generation") <= 0) | F.col("ready").isNotNull()), settled)
    g = g.withColumn("released", F.when(ready_in_time < F.col("deadline"), ready_in_time)).select("gate", "released", "deadline")
    ends = F.coalesce("released", "deadline")
    outcome = F.when(F.col("since") >= ends, None).when(ends - F.col("since") > max_wait, REJECTED).when(F.col("released").isNotNull(), REPLAN).otherwise(EXPIRED)
    return sessions.join(g, "gate").withColumn("outcome", outcome).drop("released", "deadline")


def judge_decisions(decisions: DataFrame, within: str, order: str) -> DataFrame:
    """decisions (epoch, key) with `verdict`, as an EpochGuard that commits what it lets through says of each, by agent.

    `apply`, `replay` of the one applied last, or a refusal: `invalid`, `stale` or `conflict`. Windows run within an agent.
    """
    before = W.partitionBy(within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # of the highest epoch so far, the decision that came first
    top = F.max(F.when(F.col("epoch") >= 1, F.struct("epoch", (-F.col(order)).alias("nth"), "key"))).over(before)
    last, last_key = F.coalesce(F.col("__top.epoch"), F.lit(0)), F.col("__top.key")
    verdict = F.when(F.col("epoch") < 1, "invalid").when(F.col("epoch") < last, "stale").when(F.col("epoch") > last, "apply").when(F.col("key") == last_key, "replay").otherwise("conflict")
    return decisions.withColumn("__top", top).withColumn("verdict", verdict).drop("__top")


def judge_statements(claims: DataFrame, order: str) -> DataFrame:
    """claims (id, sql, ok) with `verdict`, as a StatementLog says of each when every run ends before the next claim.

    An id is bound to its first text. It is executed until a run succeeds, then replayed; another text is a `conflict`, no
    id at all is `invalid`. Windows run within an id.
    """
    by = W.partitionBy("id").orderBy(order)
    first = F.first("sql").over(by.rowsBetween(W.unboundedPreceding, 0))
    done = F.coalesce(F.max(F.when(F.col("sql") == F.col("__first"), F.col("ok"))).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = claims.withColumn("__first", first).withColumn("__done", done)
    verdict = F.when(F.coalesce("id", F.lit("")) == "", "invalid").when(F.col("sql") != F.col("__first"), "conflict").when(F.col("__done"), "replay").otherwise("execute")
    return rows.withColumn("verdict", verdict).drop("__first", "__done")


def freshness(polls: DataFrame, within: str, order: str, lease: float) -> DataFrame:
    """polls (boot, wall, confirmed) with `age` of the last confirmation before each, and `may_write`.

    The larger of what two clocks say; null, and no writes, without a confirmation or where the boot clock went back.
    """
    before = W.partitionBy(within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("confirmed"), F.struct("boot", "wall")), ignorenulls=True).over(before)
    rows = polls.withColumn("__at", last)
    age = F.when(F.col("boot") >= F.col("__at.boot"), F.greatest(F.col("boot") - F.col("__at.boot"), F.col("wall") - F.col("__at.wall")))
    return rows.withColumn("age", age).withColumn("may_write", F.coalesce(F.col("age") < lease, F.lit(False))).drop("__at")


def xid_horizons(versions: DataFrame) -> DataFrame:
    """(base, horizon) of versions (base, version): the first of a base's 32-bit transaction ids to come round after it."""
    return versions.groupBy("base").agg(F.min_by("version", F.pmod(F.col("version") - F.col("base"), F.lit(1 << 32))).alias("horizon"))
