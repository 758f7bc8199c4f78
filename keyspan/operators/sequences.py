"""Ids from global sequences: disjoint blocks, dense within a batch, gaps between blocks allowed."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyspan.sources.scratch import kept


class SequenceError(RuntimeError):
    """Ids that can't be given."""

    code = "55000"


@dataclass
class Block:
    """Ids next to end - 1."""

    next: int
    end: int

    @classmethod
    def of(cls, start: int, size: int) -> Block:
        if size < 1 or start + size > 1 << 63:
            raise SequenceError(f"no block of {size} ids starts at {start}")
        return cls(start, start + size)

    @property
    def left(self) -> int:
        return self.end - self.next


class Allocator:
    """Gives ids one by one from reserved blocks. Threads that find a block used up wait for one reservation, not one each."""

    def __init__(self, reserve: Callable[[str], tuple[int, int]]):
        self._reserve, self._lock = reserve, threading.Lock()
        self._held: dict[str, tuple[threading.Lock, list[Block]]] = {}
        self._size: dict[str, int] = {}

    def _of(self, sequence: str) -> tuple[threading.Lock, list[Block]]:
        with self._lock:
            return self._held.setdefault(sequence, (threading.Lock(), []))

    def _add(self, sequence: str, blocks: list[Block]) -> None:
        start, size = self._reserve(sequence)
        blocks.append(Block.of(start, size))
        self._size[sequence] = size

    def next_id(self, sequence: str) -> int:
        lock, blocks = self._of(sequence)
        with lock:
            while blocks and not blocks[0].left:
                blocks.pop(0)
            if not blocks:
                self._add(sequence, blocks)
            blocks[0].next += 1
            return blocks[0].next - 1

    def needs_refill(self, sequence: str) -> bool:
        """Whether a fifth of a block (one id at least) or less is left."""
        lock, blocks = self._of(sequence)
        with lock:
            return sum(b.left for b in blocks) <= max(self._size.get(sequence, 0) // 5, 1)

    def refill(self, sequence: str) -> bool:
        """Reserves the next block ahead of need; whether there was need."""
        if not self.needs_refill(sequence):
            return False
        lock, blocks = self._of(sequence)
        with lock:
            self._add(sequence, blocks)
        return True


def number_rows(df: DataFrame, order: Sequence[str | Column], start: int, column: str) -> DataFrame:
    """df with dense ids from start, in the order of `order` (ties in any order).

    Rows are numbered within range partitions, and partitions by the sums of their sizes: no single task sees all rows.
    The partitions are kept as a table, for a range partitioning need not come out the same twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = kept(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    by = by.withColumn("__part", F.shiftright("__at", 33))
    # one row for each partition
    sizes = by.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    out = by.join(F.broadcast(before), "__part")
    return out.withColumn(column, F.lit(start) + F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")
