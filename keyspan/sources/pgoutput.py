"""Decoding a database's logical replication frames (pgoutput, protocol versions 1 to 4).

A frame is a tag byte and its fields in network order. Inside a stream bracket frames begin with a transaction id; whether
a frame is in one is a running sum over tags, so frames are decoded wherever they are, in any number of tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from keyspan.sources import pgoutput_batch
from keyspan.sources.scratch import kept


class DecodeError(ValueError):
    """A frame that is not what its tag says."""


#: One row for each frame. Positions are unsigned 64-bit numbers in longs.
SCHEMA = (
    "shard string, seq long, txn long, op string, xid long, commit_lsn long, end_lsn long, ts long, rel_oid long, schema string, table string, replica_identity string, "
    "columns array<struct<flags:int,name:string,type_oid:long,typmod:int>>, before_kind string, before array<struct<kind:string,value:binary>>, after array<struct<kind:string,value:binary>>, "
    "prefix string, content binary, transactional boolean, relations array<long>, options int, subxid long, gid string"
)
_KINDS = {b"n": "null", b"u": "unchanged", b"t": "text", b"b": "binary"}


class _Frame:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.data):
            raise DecodeError("the frame ends early")
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError("a name without an end")
        out, self.at = self.data[self.at : end], end + 1
        try:
            return out.decode()
        except UnicodeDecodeError as error:
            raise DecodeError("a name that is not UTF-8") from error

    def sized(self) -> bytes:
        n = self.unpack("i")
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError("a value longer than its frame" if n >= 0 else "a negative length")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out

    def many(self, form: str, least: int) -> int:
        """A count of things that take so many bytes each at least."""
        n = self.unpack(form)
        if n < 0 or n * least > len(self.data) - self.at:
            raise DecodeError("a count that the frame can't hold")
        return n

    def tuple(self) -> list[dict]:
        cells = []
        for _ in range(self.many("h", 1)):
            kind = _KINDS.get(self.unpack("c"))
            if kind is None:
                raise DecodeError("a cell of no known kind")
            cells.append({"kind": kind, "value": self.sized() if kind in ("text", "binary") else None})
        return cells

    def expect(self, *marks: bytes) -> bytes:
        mark = self.unpack("c")
        if mark not in marks:
            raise DecodeError(f"{mark!r} instead of a row")
        return mark


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


class Decoder:
    """Decodes the frames of one shard in order. parallel: aborts of streamed transactions carry a position and time."""

    def __init__(self, parallel: bool = False):
        self.parallel, self.in_stream = parallel, False

    def decode(self, data: bytes) -> dict:
        """The frame's fields; `op` says which frame it is. A bad frame changes nothing."""
        f = _Frame(data)
        tag = f.unpack("c").decode("latin-1")
        read = _READERS.get(tag)
        if read is None:
            raise DecodeError(f"no frame has the tag {tag!r}")
        out = read(self, f)
        if f.at != len(data):
            raise DecodeError(f"{len(data) - f.at} bytes follow the frame")
        self.in_stream = {"S": True, "E": False}.get(tag, self.in_stream)
        return out

    def _xid(self, f: _Frame) -> dict:
        return {"xid": f.unpack("I")} if self.in_stream else {}

    def _begin(self, f):
        lsn, ts, xid = f.unpack("QqI")
        return {"op": "begin", "commit_lsn": _signed(lsn), "ts": ts, "xid": xid}

    def _commit(self, f):
        _, lsn, end, ts = f.unpack("BQQq")
        return {"op": "commit", "commit_lsn": _signed(lsn), "end_lsn": _signed(end), "ts": ts}

    def _message(self, f):
        out = self._xid(f)
        flags, lsn = f.unpack("BQ")
        return out | {"op": "message", "transactional": bool(flags & 1), "commit_lsn": _signed(lsn), "prefix": f.text(), "content": f.sized()}

    def _origin(self, f):
        return {"op": "origin", "commit_lsn": _signed(f.unpack("Q")), "prefix": f.text()}

    def _relation(self, f):
        out = self._xid(f)
        out |= {"op": "relation", "rel_oid": f.unpack("I"), "schema": f.text(), "table": f.text(), "replica_identity": f.unpack("c").decode("latin-1"), "columns": []}
        for _ in range(f.many("h", 10)):
            flags, name = f.unpack("B"), f.text()
            oid, typmod = f.unpack("Ii")
            out["columns"].append({"flags": flags, "name": name, "type_oid": oid, "typmod": typmod})
        return out

    def _type(self, f):
        return self._xid(f) | {"op": "type", "rel_oid": f.unpack("I"), "schema": f.text(), "table": f.text()}

    def _insert(self, f):
        out = self._xid(f) | {"op": "insert", "rel_oid": f.unpack("I")}
        f.expect(b"N")
        return out | {"after": f.tuple()}

    def _update(self, f):
        out = self._xid(f) | {"op": "update", "rel_oid": f.unpack("I")}
        mark = f.expect(b"K", b"O", b"N")
        if mark != b"N":
            out |= {"before_kind": {b"K": "key", b"O": "full"}[mark], "before": f.tuple()}
            f.expect(b"N")
        return out | {"after": f.tuple()}

    def _delete(self, f):
        out = self._xid(f) | {"op": "delete", "rel_oid": f.unpack("I")}
        mark = f.expect(b"K", b"O")
        return out | {"before_kind": {b"K": "key", b"O": "full"}[mark], "before": f.tuple()}

    def _truncate(self, f):
        out = self._xid(f)
        n = f.unpack("i")
        options = f.unpack("B")
        if n < 0 or n * 4 > len(f.data) - f.at:
            raise DecodeError("a count that the frame can't hold")
        return out | {"op": "truncate", "options": options, "relations": [f.unpack("I") for _ in range(n)]}

    def _stream_start(self, f):
        xid, first = f.unpack("IB")
        return {"op": "stream_start", "xid": xid, "options": first}

    def _stream_stop(self, f):
        return {"op": "stream_stop"}

    def _stream_commit(self, f):
        xid, _, lsn, end, ts = f.unpack("IBQQq")
        return {"op": "stream_commit", "xid": xid, "commit_lsn": _signed(lsn), "end_lsn": _signed(end), "ts": ts}

    def _stream_abort(self, f):
        xid, sub = f.unpack("II")
        out = {"op": "stream_abort", "xid": xid, "subxid": sub}
        if self.parallel:
            lsn, ts = f.unpack("Qq")
            out |= {"commit_lsn": _signed(lsn), "ts": ts}
        return out

    def _prepared(self, f, op, flags=True):
        if flags:
            f.unpack("B")
        lsn, end, ts, xid = f.unpack("QQqI")
        return {"op": op, "commit_lsn": _signed(lsn), "end_lsn": _signed(end), "ts": ts, "xid": xid, "gid": f.text()}

    def _rollback_prepared(self, f):
        _, lsn, end, _, ts, xid = f.unpack("BQQqqI")
        return {"op": "rollback_prepared", "commit_lsn": _signed(lsn), "end_lsn": _signed(end), "ts": ts, "xid": xid, "gid": f.text()}


_READERS = {
    "B": Decoder._begin, "C": Decoder._commit, "M": Decoder._message, "O": Decoder._origin, "R": Decoder._relation, "Y": Decoder._type, "I": Decoder._insert, "U": Decoder._update, "D": Decoder._delete, "T": Decoder._truncate,
    "S": Decoder._stream_start, "E": Decoder._stream_stop, "c": Decoder._stream_commit, "A": Decoder._stream_abort, "r": Decoder._rollback_prepared,
    "b": lambda d, f: d._prepared(f, "begin_prepare", flags=False), "P": lambda d, f: d._prepared(f, "prepare"), "K": lambda d, f: d._prepared(f, "commit_prepared"), "p": lambda d, f: d._prepared(f, "stream_prepare"),
}


def decode_batch(batch: pa.RecordBatch, schema: pa.Schema, parallel: bool = False) -> pa.RecordBatch:
    """A batch (shard, seq, frame, txn, in_stream, ...) decoded: rows, begins and commits together, other frames one by one."""
    frame, in_stream = batch.column("frame"), batch.column("in_stream")
    inside = in_stream.to_numpy(zero_copy_only=False).astype(bool)
    read, columns = pgoutput_batch.decode(frame, inside, schema)
    rest = np.flatnonzero(~read)
    decoder, others = Decoder(parallel), []
    for i, data in zip(rest.tolist(), frame.take(pa.array(rest)).to_pylist(), strict=True):
        decoder.in_stream = bool(inside[i])
        others.append(decoder.decode(data))
    n = len(batch) - len(rest)
    own = {name: column for name, column in zip(batch.schema.names, batch.columns, strict=True) if name not in ("frame", "in_stream")}
    place = np.empty(len(batch), np.int64)  # where each frame's row is once those read together are followed by the others
    place[read], place[rest] = np.arange(n), np.arange(n, len(batch))
    out = []
    for f in schema:
        if f.name in own:
            out.append(own[f.name].cast(f.type))
            continue
        column = columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type)
        if others:
            column = pa.concat_arrays([column, pa.array([r.get(f.name) for r in others], f.type)]).take(pa.array(place))
        out.append(column)
    return pa.RecordBatch.from_arrays(out, schema=schema)


def decode_frames(frames: DataFrame, parallel: bool = False, after: int | None = None) -> DataFrame:
    """Decoded rows of frames (shard, seq, frame); seq is their order within a shard. A bad frame is an error.

    after: transactions that commit there or before were applied; of these only relations are decoded.

    Frames are dealt by their order into parts and kept with what a part's own frames tell (`pgoutput_batch.mark`): the
    transaction of each (`txn`, the number of begins so far), the positions of its commit (`txn_lsn`, `txn_end`, null without
    one), and whether it is in a stream bracket. What the parts before add is a row for each part and shard; the few commits
    that stand in another part than their transaction's frames are looked up. The frames are decoded in Arrow batches.
    """
    spark = frames.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = frames.select(F.col("shard").cast("string").alias("shard"), F.col("seq").cast("long").alias("seq"), "frame")
    rows = rows.repartitionByRange(parts, "shard", "seq").sortWithinPartitions("shard", "seq").withColumn("part", F.spark_partition_id())
    kind = _parse_datatype_string("shard string, seq long, frame binary, part int, mark long, upto long, txn_lsn long, txn_end long, closes boolean")
    marked_arrow = to_arrow_schema(kind)
    marked = kept(rows.mapInArrow(lambda batches: pgoutput_batch.mark(batches, marked_arrow), kind), "marked")
    total = marked.groupBy("part", "shard").agg(F.sum("mark").alias("total"))
    before = total.select(F.col("part").alias("__part"), F.col("shard").alias("__shard"), F.sum("total").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    marked = marked.join(F.broadcast(before), (F.col("part") == F.col("__part")) & F.col("shard").eqNullSafe(F.col("__shard")), "left").drop("__part", "__shard")
    marks = F.coalesce("before", F.lit(0)) + F.col("upto")
    # a stream's end is still in it, but carries no transaction id
    marked = marked.withColumns({"txn": F.shiftright(marks, 32), "in_stream": marks.bitwiseAND(F.lit((1 << 32) - 1)) > 0})
    ends = marked.filter("closes").groupBy(F.col("shard").alias("__shard"), F.col("txn").alias("__txn")).agg(F.max("txn_lsn").alias("__lsn"), F.max("txn_end").alias("__end"))
    rows = marked.join(F.broadcast(ends), (F.col("txn") == F.col("__txn")) & F.col("shard").eqNullSafe(F.col("__shard")), "left")
    rows = rows.select("shard", "seq", "frame", "txn", "in_stream", F.coalesce("txn_lsn", "__lsn").alias("txn_lsn"), F.coalesce("txn_end", "__end").alias("txn_end"))
    if after is not None:
        rows = rows.filter(F.col("txn_lsn").isNull() | (F.col("txn_lsn") > after) | (F.substring("frame", 1, 1) == F.lit(b"R")))
    schema = _parse_datatype_string(f"{SCHEMA}, txn_lsn long, txn_end long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode_batch(batch, arrow, parallel)

    return rows.mapInArrow(run, schema)


def unwrap(messages: DataFrame) -> DataFrame:
    """messages (data binary, ...) of a replication connection with kind, wal_start, wal_end, server_time and frame.

    `wal` carries a frame, `keepalive` none, but reply says whether an answer is wanted. Anything else is an error.
    """
    data, tag = F.col("data"), F.substring("data", 1, 1)
    number = lambda at: F.conv(F.hex(F.substring(data, at, 8)), 16, -10).cast("bigint")
    wal = (tag == F.lit(b"w")) & (F.octet_length(data) >= 25)
    alive = (tag == F.lit(b"k")) & (F.octet_length(data) == 18)
    kind = F.when(wal, "wal").when(alive, "keepalive").otherwise(F.raise_error(F.lit("a replication message that is neither WAL nor a keepalive")))
    rows = messages.withColumn("kind", kind)
    is_wal = F.col("kind") == "wal"
    rows = rows.withColumns({
        "wal_start": F.when(is_wal, number(2)), "wal_end": F.when(is_wal, number(10)).otherwise(number(2)), "server_time": F.when(is_wal, number(18)).otherwise(number(10)),
        "reply": F.when(~is_wal, F.substring(data, 18, 1) != F.lit(b"\0")), "frame": F.when(is_wal, F.expr("substring(data, 26)")),
    })
    return rows.drop("data")


def commit_time(ts: str = "ts"):
    """Column expression: the time of microseconds since 2000-01-01 UTC."""
    return F.timestamp_micros(F.col(ts) + 946_684_800_000_000)


# --- writing frames, for tests and for change logs of our own --------------------------------------------------------


def encode_tuple(cells: list[bytes | None | type(...)]) -> bytes:
    """None is null, ... an unchanged value, bytes are text."""
    out = struct.pack(">h", len(cells))
    for c in cells:
        out += b"n" if c is None else b"u" if c is ... else b"t" + struct.pack(">i", len(c)) + c
    return out


def begin(lsn: int, xid: int = 1, ts: int = 0) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, ts, xid)


def commit(lsn: int, end: int, ts: int = 0) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end, ts)


def relation(oid: int, schema: str, table: str, columns: list[tuple[str, int, bool]], identity: str = "d") -> bytes:
    out = b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + table.encode() + b"\0" + identity.encode() + struct.pack(">h", len(columns))
    return out + b"".join(struct.pack(">B", key) + name.encode() + b"\0" + struct.pack(">Ii", type_oid, -1) for name, type_oid, key in columns)


def insert(oid: int, new: list) -> bytes:
    return b"I" + struct.pack(">I", oid) + b"N" + encode_tuple(new)


def update(oid: int, new: list, key: list | None = None) -> bytes:
    return b"U" + struct.pack(">I", oid) + (b"K" + encode_tuple(key) if key is not None else b"") + b"N" + encode_tuple(new)


def delete(oid: int, key: list) -> bytes:
    return b"D" + struct.pack(">I", oid) + b"K" + encode_tuple(key)
