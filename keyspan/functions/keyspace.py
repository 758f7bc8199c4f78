"""Keys, positions in the 64-bit keyspace, ranges, and their column expressions.

A key's position (its keyspace id) is the xxHash64, seed 0, of its canonical bytes. Columns hold a position as a signed
long with the same 64 bits; comparisons are unsigned, which `biased` turns into signed ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

INT, TEXT, UUID, BYTEA = "int", "text", "uuid", "bytea"
KEY_TYPES = (INT, TEXT, UUID, BYTEA)
SPACE = 1 << 64
HASH = "xxhash64_v1"
# Hashes to 0 under Spark's fixed seed 42, so that a second column is hashed with seed 0.
_SEED_ZERO = -365884300664092260
_SIGN = -(1 << 63)
_INT = re.compile(r"[+-]?[0-9]+\Z")


class KeyspaceError(ValueError):
    """An unusable key, range or partition."""


# --- keys ---------------------------------------------------------------------------------------------------------


def coerce(kind: str, value: object) -> int | str | bytes | None:
    """The canonical value of a literal for a key column of a declared type; None where it is not a value of the type."""
    if value is None or isinstance(value, bool):
        return None
    if kind == INT:
        if isinstance(value, int):
            return value if -(1 << 63) <= value < 1 << 63 else None
        return coerce(INT, int(value.strip())) if isinstance(value, str) and _INT.match(value.strip()) else None
    if kind == TEXT:
        return value if isinstance(value, str) else None
    if isinstance(value, bytes):
        return value if kind == BYTEA or len(value) == 16 else None
    if not isinstance(value, str):
        return None
    if kind == UUID:
        if value.startswith("{") != value.endswith("}"):
            return None
        digits = value.removeprefix("{").removesuffix("}").replace("-", "")
        return bytes.fromhex(digits) if re.fullmatch(r"[0-9A-Fa-f]{32}", digits) else None
    if kind == BYTEA:
        return bytes.fromhex(value[2:]) if re.fullmatch(r"\\x(?:[0-9A-Fa-f]{2})*", value) else None
    raise KeyspaceError(f"no key type {kind!r}")


def key_bytes(value: int | str | bytes) -> bytes:
    """The bytes that are hashed: eight of a big-endian integer, UTF-8 of text, others as they are."""
    if isinstance(value, int):
        return value.to_bytes(8, "big", signed=True)
    return value.encode() if isinstance(value, str) else value


def keyspace_id(value: int | str | bytes) -> int:
    """Position of a canonical value, 0 to 2^64 - 1."""
    return xxhash.xxh64_intdigest(key_bytes(value), seed=0)


#: Hash functions by name; an unknown name is an error for the caller to raise.
FUNCTIONS = {HASH: keyspace_id}


def shard_function(name: str):
    try:
        return FUNCTIONS[name]
    except KeyError:
        raise KeyspaceError(f"unknown shard function {name!r}") from None


# --- ranges -------------------------------------------------------------------------------------------------------


def format_bound(v: int) -> str:
    """Big-endian hex without trailing zero bytes; 0 is empty."""
    return re.sub(r"(?:00)+\Z", "", f"{v:016x}")


def parse_bound(s: str) -> int:
    if len(s) > 16 or len(s) % 2 or not re.fullmatch(r"[0-9A-Fa-f]*", s):
        raise KeyspaceError(f"bad bound {s!r}")
    return int(s.ljust(16, "0"), 16) if s else 0


def canonical_bound(s: str) -> int:
    """The value of a bound that must be spelled the one way that format_bound spells it."""
    v = parse_bound(s)
    if format_bound(v) != s:
        raise KeyspaceError(f"bound {s!r} is not spelled {format_bound(v)!r}")
    return v


@dataclass(frozen=True, order=True)
class KeyRange:
    """start <= id < end; end None is the end of the space."""

    start: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.start < SPACE or (self.end is not None and not self.start < self.end < SPACE):
            raise KeyspaceError(f"empty or impossible range {self.start:#x} to {self.end if self.end is None else hex(self.end)}")

    @property
    def stop(self) -> int:
        return SPACE if self.end is None else self.end

    def __contains__(self, position: int) -> bool:
        return self.start <= position < self.stop

    def intersects(self, other: KeyRange) -> bool:
        return self.start < other.stop and other.start < self.stop

    def split_evenly(self, parts: int) -> list[KeyRange]:
        width = self.stop - self.start
        if parts < 1 or parts > width:
            raise KeyspaceError(f"{parts} parts of a range of {width}")
        cuts = [self.start + i * width // parts for i in range(parts)] + [self.stop]
        return [KeyRange(a, None if b == SPACE else b) for a, b in zip(cuts, cuts[1:], strict=False)]

    @classmethod
    def parse(cls, text: str) -> KeyRange:
        start, dash, end = text.partition("-")
        if not dash or "-" in end:
            raise KeyspaceError(f"a range is start-end, not {text!r}")
        return cls(parse_bound(start), parse_bound(end) if end else None)

    def __str__(self) -> str:
        return f"{format_bound(self.start)}-{'' if self.end is None else format_bound(self.end)}"


def validate_partition(ranges: Sequence[KeyRange]) -> list[KeyRange]:
    """The ranges in order if each position is in exactly one; otherwise says what is wrong and where."""
    ordered = sorted(ranges, key=lambda r: r.start)
    if not ordered:
        raise KeyspaceError("no ranges")
    if ordered[0].start:
        raise KeyspaceError(f"positions below {ordered[0].start:#x} are in no range")
    for i, (a, b) in enumerate(zip(ordered, ordered[1:], strict=False)):
        if a.stop != b.start:
            raise KeyspaceError(f"{'gap' if a.stop < b.start else 'overlap'} after range {i} ({a})")
    if ordered[-1].end is not None:
        raise KeyspaceError(f"positions from {ordered[-1].end:#x} are in no range")
    return ordered


# --- columns ------------------------------------------------------------------------------------------------------


def signed(v: int) -> int:
    """A position as the long that has its bits."""
    return v - SPACE if v >= 1 << 63 else v


def coerce_column(kind: str, text: Column) -> Column:
    """Canonical value of a text column, null where it is not a value of the type."""
    if kind == INT:
        bare = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
        return F.when(bare.rlike(r"\A[+-]?[0-9]+\z"), bare.try_cast("bigint"))
    if kind == TEXT:
        return text
    if kind == UUID:
        digits = F.regexp_replace(F.regexp_replace(text, r"\A\{|\}\z", ""), "-", "")
        balanced = text.startswith("{") == text.endswith("}")
        return F.when(balanced & digits.rlike(r"\A[0-9A-Fa-f]{32}\z"), F.unhex(digits))
    if kind == BYTEA:
        return F.when(text.rlike(r"\A\\x([0-9A-Fa-f]{2})*\z"), F.unhex(F.substring(text, 3, 1 << 30)))
    raise KeyspaceError(f"no key type {kind!r}")


def id_column(kind: str, key: Column) -> Column:
    """Position of a canonical key column (integers of any width, text, or binary); null for null, never a position."""
    raw = F.unhex(F.lpad(F.hex(key.cast("bigint")), 16, "0")) if kind == INT else key
    return F.when(key.isNotNull(), F.xxhash64(F.lit(_SEED_ZERO), raw))


def text_id_column(kind: str, text: Column) -> Column:
    """Position of a key given as text, the form that copies and change streams carry; the same for both."""
    return id_column(kind, coerce_column(kind, text))


def required(column: Column, what: str) -> Column:
    """The column, with an error where it is null: an unroutable row is never dropped or put somewhere by default."""
    return F.when(column.isNotNull(), column).otherwise(F.raise_error(F.lit(what)))


def biased(position: Column) -> Column:
    """A long whose signed order is the unsigned order of positions."""
    return position.bitwiseXOR(F.lit(_SIGN))


def in_range(position: Column, r: KeyRange) -> Column:
    """Membership by unsigned comparison; null for a null position."""
    at = biased(position)
    if r.end is None:
        return at >= r.start + _SIGN
    return (at >= r.start + _SIGN) & (at < r.end + _SIGN)


def route_column(position: Column, shards: Sequence[tuple[str, KeyRange]]) -> Column:
    """Shard of a position: a ladder over the partition's ranges in order, compiled into the scan's code."""
    ordered = sorted(shards, key=lambda s: s[1].start)
    at = biased(position)
    out = F.when(position.isNull(), None)
    for name, r in ordered[:-1]:
        out = out.when(at < r.end + _SIGN, name)
    return out.otherwise(ordered[-1][0])


def format_bound_column(position: Column) -> Column:
    return F.lower(F.regexp_replace(F.lpad(F.hex(position), 16, "0"), "(00)+$", ""))


def parse_bound_column(text: Column) -> Column:
    """The long with the bits of a bound; null if it is none."""
    ok = text.rlike(r"\A([0-9A-Fa-f]{2}){0,8}\z")
    wide = F.conv(F.rpad(text, 16, "0"), 16, 10).cast("decimal(20,0)")
    return F.when(ok, F.when(wide > (1 << 63) - 1, wide - F.lit(str(SPACE)).cast("decimal(20,0)")).otherwise(wide).cast("bigint"))
