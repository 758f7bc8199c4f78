"""Frames of rows, begins and commits outside stream brackets, read a batch at a time.

The fields of all frames of a batch are read together, cell by cell. A frame that is of another kind, or not what its tag
says, is left to the decoder of single frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_OPS = {"B": "begin", "C": "commit", "I": "insert", "U": "update", "D": "delete"}
_KINDS = pa.array(["null", "unchanged", "text", "binary"])
_CODES = np.full(256, -1, np.int8)
for _i, _c in enumerate(b"nutb"):
    _CODES[_c] = _i


#: Rows of a transaction that wait for its commit, in memory; those of a longer one look it up later.
WAIT = 20_000


class _Bytes:
    def __init__(self, frames: pa.Array):
        frames = frames.cast(pa.large_binary())
        bounds = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
        self.start, self.end = bounds[:-1], bounds[1:]
        held = frames.buffers()[2]
        # eight bytes more, so that no number is read past the end; whether a frame holds it is checked
        self.data = np.concatenate([np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8), np.zeros(8, np.uint8)])

    def number(self, at: np.ndarray, kind: str) -> np.ndarray:
        """Numbers in network order; positions past the end give what is there, for the caller to refuse."""
        size = np.dtype(kind).itemsize
        at = np.minimum(at, len(self.data) - size)
        return np.ascontiguousarray(self.data[at[:, None] + np.arange(size)]).view(kind)[:, 0]

    def slices(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of parts put end to end."""
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        return offsets, self.data[np.repeat(at - offsets[:-1], length) + np.arange(offsets[-1])]


class _Cells:
    """The cells of one tuple of each row."""

    def __init__(self, raw: _Bytes, rows: np.ndarray, at: np.ndarray, end: np.ndarray):
        """rows: which rows have a tuple, that begins at `at`; afterwards `at` is behind it, and `ok` says whether it could be read."""
        n = raw.number(at, ">i2").astype(np.int64)
        self.ok = (at + 2 <= end) & (n >= 0)
        n = np.where(self.ok, n, 0)
        at, parts, todo = at + 2, [], np.flatnonzero(n > 0)
        j = 0
        while len(todo):
            here, last = at[todo], end[todo]
            code = np.where(here < last, _CODES[raw.data[np.minimum(here, len(raw.data) - 1)]], -1)
            sized = code >= 2
            length = np.where(sized, raw.number(here + 1, ">i4").astype(np.int64), 0)
            good = (code >= 0) & (~sized | ((here + 5 <= last) & (length >= 0) & (here + 5 + length <= last)))
            self.ok[todo[~good]] = False
            todo, here, code, length, sized = todo[good], here[good], code[good], length[good], sized[good]
            parts.append((rows[todo], code, here + 5, length))
            at[todo] = here + np.where(sized, 5 + length, 1)
            j += 1
            todo = todo[n[todo] > j]
        self.at = at
        self.rows, self.codes, self.values, self.lengths = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64) for _ in range(4))

    def array(self, raw: _Bytes, present: np.ndarray, kind: pa.DataType) -> pa.Array:
        """A list for each row, null where there is no tuple; cells of rows that could not be read are left out."""
        keep = np.flatnonzero(present[self.rows])
        keep = keep[np.argsort(self.rows[keep], kind="stable")]
        codes, length = self.codes[keep].astype(np.int8), self.lengths[keep]
        offsets, held = raw.slices(self.values[keep], length)
        valid = pa.py_buffer(np.packbits(codes >= 2, bitorder="little").tobytes())
        values = pa.Array.from_buffers(pa.large_binary(), len(codes), [valid, pa.py_buffer(offsets), pa.py_buffer(held)])
        of = kind.value_type
        cells = pa.StructArray.from_arrays([_KINDS.take(pa.array(codes)).cast(of.field("kind").type), values.cast(of.field("value").type)], fields=[of.field("kind"), of.field("value")])
        ends = np.zeros(len(present) + 1, np.int32)
        np.cumsum(np.bincount(self.rows[keep], minlength=len(present)), out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), cells, type=kind, mask=pa.array(~present))


def decode(frames: pa.Array, in_stream: np.ndarray, schema: pa.Schema) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(which frames were read, columns of schema by name with a value for each of those); columns not named are null."""
    raw, size = _Bytes(frames), len(frames)
    start, end = raw.start, raw.end
    tag = np.where((start < end) & ~in_stream, raw.data[np.minimum(start, len(raw.data) - 1)], 0)
    is_tag = {t: tag == ord(t) for t in _OPS}
    begins, commits = is_tag["B"] & (end - start == 21), is_tag["C"] & (end - start == 26)

    changes = np.flatnonzero(is_tag["I"] | is_tag["U"] | is_tag["D"])
    at, last = start[changes] + 5, end[changes]
    mark = np.where(at < last, raw.data[np.minimum(at, len(raw.data) - 1)], 0)
    key_or_full = (mark == ord("K")) | (mark == ord("O"))
    insert, delete, new = is_tag["I"][changes], is_tag["D"][changes], mark == ord("N")
    ok = np.where(insert, new, np.where(delete, key_or_full, new | key_or_full))

    with_old = np.flatnonzero(ok & key_or_full)
    old = _Cells(raw, changes[with_old], at[with_old] + 1, last[with_old])
    ok[with_old] &= old.ok
    at[with_old] = old.at
    # behind an update's old row comes the mark of the new one
    both = with_old[~delete[with_old] & ok[with_old]]
    ok[both] &= (at[both] < last[both]) & (raw.data[np.minimum(at[both], len(raw.data) - 1)] == ord("N"))
    with_new = np.flatnonzero(ok & ~delete)
    now = _Cells(raw, changes[with_new], at[with_new] + 1, last[with_new])
    ok[with_new] &= now.ok
    at[with_new] = now.at
    ok &= at == last

    rows = np.zeros(size, bool)
    rows[changes[ok]] = True
    read = begins | commits | rows
    has_old, has_new = np.zeros(size, bool), np.zeros(size, bool)
    has_old[changes[ok & key_or_full]] = True
    has_new[changes[ok & ~delete]] = True
    picked = np.flatnonzero(read)

    def longs(parts: list[tuple[np.ndarray, int, str]]) -> pa.Array:
        """Numbers of some frames (which, distance from the start, type); null elsewhere."""
        out, there = np.zeros(size, np.int64), np.zeros(size, bool)
        for which, off, kind in parts:
            out[which] = raw.number(start[which] + off, kind).astype(np.int64)
            there |= which
        return pa.array(out[picked], mask=~there[picked])

    names = np.empty(size, np.int8)
    for i, t in enumerate(_OPS):
        names[is_tag[t]] = i
    full = np.zeros(size, bool)
    full[changes] = mark == ord("O")
    columns = {
        "op": pa.array(list(_OPS.values())).take(pa.array(names[picked])),
        "xid": longs([(begins, 17, ">u4")]),
        "commit_lsn": longs([(begins, 1, ">i8"), (commits, 2, ">i8")]),
        "end_lsn": longs([(commits, 10, ">i8")]),
        "ts": longs([(begins, 9, ">i8"), (commits, 18, ">i8")]),
        "rel_oid": longs([(rows, 1, ">u4")]),
        "before_kind": pa.array(["key", "full"]).take(pa.array(full[picked].astype(np.int8), mask=~has_old[picked])),
        "before": old.array(raw, has_old, schema.field("before").type).take(pa.array(picked)),
        "after": now.array(raw, has_new, schema.field("after").type).take(pa.array(picked)),
    }
    return read, columns


def mark(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Frames (shard, seq, frame, part) of one part of a log, in order, with what is known of their transactions there.

    mark: 1 << 32 for a begin, 1 and -1 for a stream's start and end; upto: its sum over the part's frames of the shard so
    far; txn_lsn and txn_end: of the commit of the frame's transaction, null if it is not among the frames at hand; closes:
    whether this is a commit that frames elsewhere may have to look up.
    """
    held, last, sums, partial = None, None, (0, 0), False  # sums of marks and begins before the held frames, which are of shard `last` unless told otherwise

    def told(rows: pa.Table, final: bool):
        nonlocal held, last, sums, partial
        rows = rows.combine_chunks().to_batches()[0]
        raw, n = _Bytes(rows.column(2)), len(rows)
        tag = np.where(raw.start < raw.end, raw.data[raw.start], 0)
        begins = tag == ord("B")
        marks = (begins.astype(np.int64) << 32) + (tag == ord("S")) - (tag == ord("E"))
        of = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        turns = np.empty(n, bool)  # where another shard begins
        turns[0], turns[1:] = last != (rows.column(0)[0].as_py(),), of[1:] != of[:-1]

        def along(values: np.ndarray, before: int) -> np.ndarray:
            upto = np.cumsum(values)
            first = np.maximum.accumulate(np.where(turns, np.arange(n), -1))
            return upto - np.where(first >= 0, upto[first] - values[first], -before)

        upto, begun = along(marks, sums[0]), along(begins.astype(np.int64), sums[1])
        group = np.cumsum(begins | turns)
        group -= group[0]
        at = np.flatnonzero(tag == ord("C"))
        ends = np.full(group[-1] + 1, -1)
        ends[group[at]] = at
        end = ends[group]
        known = end >= 0
        where = raw.start[np.maximum(end, 0)]
        upto_here = partial and not (begins[0] or turns[0])  # frames of the first transaction went on before
        cut = n if final else int(np.searchsorted(group, group[-1]))
        split = cut == 0 and n > WAIT
        if split:
            cut = n
        closes = (tag == ord("C")) & ((begun == 0) | (upto_here & (group == 0)) | ((split or final) & (group == group[-1])))
        columns = [marks, upto, *(pa.array(raw.number(where + off, ">i8").astype(np.int64), mask=~known) for off in (2, 10)), closes]
        out = pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c) for c in columns)], schema=schema).slice(0, cut)
        held = rows.slice(cut) if cut < n else None
        if cut:
            last, sums, partial = (rows.column(0)[cut - 1].as_py(),), (int(upto[cut - 1]), int(begun[cut - 1])), split
        return out

    for batch in batches:
        if len(batch):
            out = told(pa.Table.from_batches([batch] if held is None else [held, batch]), False)
            if len(out):
                yield out
    if held is not None:
        yield told(pa.Table.from_batches([held]), True)
