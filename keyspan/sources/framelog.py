"""Change frames as a stream source with offsets: a folder of segments for each shard.

A segment, <folder>/<shard>/<first seq>-<frames>.frames, holds whole transactions and appears under its name only when it
is complete, so it never changes. An offset names for each shard the last segment that was read: a stream that is started
again goes on strictly after it, whatever was read but not finished is read once more, and what is finished is acknowledged
in <folder>/acknowledged.json, which only ever moves forward.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "shard string, seq long, frame binary"
FORMAT = "keyspan_frames"
_NAME = re.compile(r"(\d{20})-(\d{10})\.frames\Z")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder) if "://" in folder or folder.startswith("file:") else "file://" + folder)


def write_segment(folder: str, shard: str, first: int, frames: Iterable[bytes]) -> str:
    """Adds the frames of whole transactions, numbered from first on, as a segment; returns its name."""
    system, base = _open(folder)
    system.create_dir(f"{base}/{shard}", recursive=True)
    temp, n = f"{base}/{shard}/.{uuid.uuid4().hex}", 0
    with system.open_output_stream(temp) as out:
        for frame in frames:
            out.write(struct.pack(">I", len(frame)) + frame)
            n += 1
    name = f"{first:020d}-{n:010d}.frames"
    system.move(temp, f"{base}/{shard}/{name}")
    return name


def acknowledged(folder: str) -> dict[str, str]:
    """The last segment of each shard that a stream has finished with; older ones may go."""
    system, base = _open(folder)
    path = f"{base}/acknowledged.json"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


class _Segment(InputPartition):
    def __init__(self, shard: str, name: str):
        super().__init__(None)
        self.shard, self.name = shard, name


class FrameReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _segments(self) -> dict[str, list[str]]:
        system, base = _open(self.folder)
        found: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if _NAME.search(info.base_name) and info.type == fs.FileType.File:
                found.setdefault(info.path.split("/")[-2], []).append(info.base_name)
        return {shard: sorted(names) for shard, names in found.items()}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {shard: names[-1] for shard, names in self._segments().items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Segment(shard, n) for shard, names in sorted(self._segments().items()) for n in names if start.get(shard, "") < n <= end.get(shard, "")]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        system, base = _open(self.folder)
        seq, n = (int(x) for x in _NAME.search(partition.name).groups())
        with system.open_input_stream(f"{base}/{partition.shard}/{partition.name}") as f:
            for i in range(n):
                size = struct.unpack(">I", f.read(4))[0]
                yield partition.shard, seq + i, f.read(size)

    def commit(self, end: dict) -> None:
        """Told once a batch's effects are safe."""
        done = acknowledged(self.folder)
        new = {shard: max(name, done.get(shard, "")) for shard, name in end.items()}
        if new.items() <= done.items():
            return
        system, base = _open(self.folder)
        temp = f"{base}/.{uuid.uuid4().hex}"
        with system.open_output_stream(temp) as out:
            out.write(json.dumps(done | new, sort_keys=True).encode())
        system.move(temp, f"{base}/acknowledged.json")


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource); spark.readStream.format("keyspan_frames").option("path", folder).load()"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrameReader(self.options["path"])
