"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit distance.

The CGK embedding walks over a sequence: at each step it writes the symbol under it and moves on by a random bit that
depends on step and symbol. Sequences at a small edit distance walk in step again soon after each edit, so their
embeddings agree in most places: edit distance has become Hamming distance, for which sampling a few places is a
locality-sensitive hash. Symbols here are words (ASCII without case and punctuation, other letters as they are).

Windows start at every word of a document. The sampled places lie among a walk's first STEPS steps, so one walk serves
the windows of all item sizes; items in turn are entered at each of their words, so an edit near an item's start costs
nothing, and each repetition has its own random bits and places. There are as many of them as an item needs to be hit
with the target recall however its permitted edits are spread: e edits leave e + 1 runs of words unharmed, and one
repetition misses one such run with a probability of MISS at most. A hit proposes where an item would lie; the item's
edit distance to the text there is then computed exactly (Myers' bit-parallel search, free at both ends).

A walk is given up as soon as the places sampled so far occur in no item, which loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import small_batches
from keyspan.llm.tokens import PUNCTUATION, mix, releasing, word_hashes

STEPS, PLACES = 14, 9
#: Least recall aimed at, the fewest repetitions, and the measured worst case of one (edits spread evenly, so that runs are shortest).
RECALL, REPEATS, MISS = 0.99, 4, 0.87
#: Repetitions that share one word of random bits.
_TOGETHER = 4
#: Bytes of items searched for at once; more items are taken in blocks.
ITEM_BYTES = 8 << 20
#: Bits of the tables that end hopeless walks.
_TABLE = 17
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray


class Probe(NamedTuple):
    """One repetition over items of one walk length."""

    steps: int
    places: tuple[int, ...]
    salt: int
    shift: int
    tables: list[np.ndarray]  # after each sampled place but the last: which prefixes of keys occur
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray


class Index(NamedTuple):
    items: list[Item]
    probes: list[Probe]
    percent: int
    first: np.ndarray  # which words any walk of an item starts with, as hashed in _walk


def allowed(words: int, percent: int) -> int:
    """The most edits that leave an item of so many words at a similarity of percent."""
    return words * (100 - percent) // 100


def repeats(words: int, percent: int) -> int:
    """Repetitions after which an item of so many words with all its permitted edits is hit with a probability of RECALL."""
    edits = allowed(words, percent)
    return max(REPEATS, math.ceil(math.log(1 - RECALL) / ((edits + 1) * math.log(MISS)))) if edits else 1


def _bits(words: np.ndarray, salt: int) -> np.ndarray:
    return mix(words ^ np.uint64((0xA5A5A5A5DEADBEEF + salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * _FOLD) >> np.uint64(64 - _TABLE)


def _first_key(words: np.ndarray) -> np.ndarray:
    key = (words + np.uint64(1)) * _FOLD
    return key ^ (key >> np.uint64(29))


def _walk(words: np.ndarray, bits: np.ndarray, at: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (key so far, place of the walk, start) at each sampled step; send() a mask to keep only some walks."""
    start, key = at, np.zeros(len(at), dtype=np.uint64)
    for step in range(probe.places[-1] + 1):
        if step in probe.places:
            key = (key + words[at] + np.uint64(step + 1)) * _FOLD
            key ^= key >> np.uint64(29)
            keep = yield key, at, start
            if keep is not None:
                key, at, start = key[keep], at[keep], start[keep]
        at = at + ((bits[at] >> np.uint64((probe.shift + step) & 63)) & np.uint64(1)).astype(np.int64)


def _places(steps: int, repeat: int) -> tuple[int, ...]:
    """The first step and others chosen at random, in order."""
    rest = np.random.default_rng(1000 * steps + repeat).permutation(np.arange(1, steps))[: PLACES - 1]
    return (0, *sorted(int(x) for x in rest))


def build_index(items: list[tuple[int | None, str | None]], percent: int) -> Index:
    known = []
    for item_id, text in items:
        words = [h for _, _, _, h in word_hashes(pa.array([text or ""], pa.string()), PUNCTUATION)]
        if words and len(words[0]):
            known.append(Item(item_id, words[0]))
    probes = []
    with np.errstate(over="ignore"):
        # a walk of an item shorter than STEPS must not leave it, so such items have walks as long as they are
        for steps in sorted({min(STEPS, len(x.words)) for x in known}):
            often = {i: repeats(len(x.words), percent) for i, x in enumerate(known) if min(STEPS, len(x.words)) == steps}
            for repeat in range(max(often.values())):
                some = [i for i, n in often.items() if n > repeat]
                probe = Probe(steps, _places(steps, repeat), repeat // _TOGETHER, repeat % _TOGETHER * STEPS, [], None, None, None)
                found = {n: [] for n in range(len(probe.places))}
                rows = []
                for i in some:
                    words = np.concatenate([known[i].words, np.zeros(steps + 1, np.uint64)])
                    n = len(known[i].words)
                    walk = _walk(words, _bits(words, probe.salt), np.arange(n), probe)
                    trail = list(walk)
                    inside = trail[-1][1] < n  # the walk stays in the item up to its last place
                    for depth, (key, _, _) in enumerate(trail):
                        found[depth].append(key[inside])
                    rows.append((np.full(int(inside.sum()), i), np.flatnonzero(inside)))
                for depth in range(len(probe.places) - 1):
                    table = np.zeros(1 << _TABLE, dtype=bool)
                    table[_slot(np.concatenate(found[depth]))] = True
                    probe.tables.append(table)
                keys = np.concatenate(found[len(probe.places) - 1])
                order = np.argsort(keys, kind="stable")
                probes.append(probe._replace(keys=keys[order], items=np.concatenate([x for x, _ in rows])[order], offsets=np.concatenate([x for _, x in rows])[order]))
    first = np.zeros(1 << _TABLE, dtype=bool)
    for probe in probes:
        first |= probe.tables[0] if probe.tables else True  # without tables, any start is walked
    return Index(known, probes, percent, first)


def candidates(index: Index, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in words, item, place in item) of all hits in a run of words."""
    out = []
    padded = np.concatenate([words, np.zeros(STEPS + 1, np.uint64)])
    bits = {salt: _bits(padded, salt) for salt in {probe.salt for probe in index.probes}}
    slots = _slot(_first_key(words))
    starts = np.flatnonzero(index.first[slots])
    for probe in index.probes:
        own = starts[probe.tables[0][slots[starts]]] if probe.tables else starts
        walk = _walk(padded, bits[probe.salt], own, probe)
        key, _, start = next(walk)
        for table in probe.tables:
            key, _, start = walk.send(np.flatnonzero(table[_slot(key)]))
            if not len(key):
                break
        else:
            lo, hi = np.searchsorted(probe.keys, key, "left"), np.searchsorted(probe.keys, key, "right")
            n = hi - lo
            which = np.repeat(np.arange(len(key)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
            out.append((start[which], probe.items[at], probe.offsets[at]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


def pattern_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def best_match(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(least edit distance of a pattern of m words to any run of words of text, where that run ends)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a run may start anywhere: no cost above the first row
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _search(index: Index, cache: dict, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, edits, end of the run in the row's words) of each row and item within reach."""
    place, item, offset = candidates(index, words)
    if not len(place):
        return
    row = np.searchsorted(bounds, place, side="right") - 1
    size = np.array([len(x.words) for x in index.items])
    reach = np.array([allowed(int(n), index.percent) for n in size])
    start = place - offset
    # hits that propose nearly the same place are one
    hit = np.unique(np.stack([row, item, start]), axis=1)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    last, done = (-1, -1), -1
    for r, i, s in hit.T.tolist():
        k = int(reach[i])
        lo, hi = max(int(bounds[r]), s - k), min(int(bounds[r + 1]), s + int(size[i]) + 2 * k)
        if (r, i) == last and hi <= done:
            continue
        # one look covers the places proposed after this one, too
        hi = min(int(bounds[r + 1]), hi + int(size[i]))
        last, done = (r, i), hi
        if i not in cache:
            cache[i] = pattern_masks(index.items[i].words.tolist())
        text = words[max(int(bounds[r]), lo - k) : hi].tolist()
        if len(cache[i].keys() & set(text)) < len(cache[i]) - k:
            continue  # each edit loses one of the item's different words at most
        edits, end = best_match(cache[i], int(size[i]), text)
        if edits <= k and (edits, lo) < best.get((r, i), (k + 1, 0)):
            best[r, i] = (edits, max(int(bounds[r]), lo - k) + end - int(bounds[r]))
    for (r, i), (edits, end) in best.items():
        yield r, i, edits, end


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word, similarity): a row for each row of docs and item found in it.

    An item is found where some run of the document's words is within a word edit distance of
    (100 - percent) percent of the item's words, rounded down. end_word is where the best run ends. Whole texts are
    searched. Null and wordless texts hold nothing, null and wordless items are nowhere. Repeated rows of docs, and of
    items, each give their rows. An empty table on either side gives an empty result.
    """
    small_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // ITEM_BYTES) or 1
    out = None
    for block in range(blocks):
        # a block of the query set, of about ITEM_BYTES
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = docs.mapInArrow(_leaks(build_index([(x["item_id"], x["text"]) for x in part.collect()], percent)), "doc_id long, item_id long, edits int, item_words int, end_word int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def _leaks(index: Index):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = ["doc_id", "item_id", "edits", "item_words", "end_word", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for first, _, bounds, words in word_hashes(batch.column("text"), PUNCTUATION):
                    for r, i, edits, end in _search(index, cache, words, bounds):
                        n = len(index.items[i].words)
                        rows.append((ids[first + r].as_py(), index.items[i].item_id, edits, n, end, 1 - edits / n))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kind) for c, kind in enumerate(kinds)], names=names)

    return releasing(run)


def op2_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80)
