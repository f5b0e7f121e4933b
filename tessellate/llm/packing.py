"""Packing by minimum bin slack.

A document's ids, ended by a separator, are cut into full windows and one remainder.
Only the counts of the remainder lengths (at most ``capacity`` of them, whatever the
corpus) go to the driver.  There each window opens with the longest length left; bitset
subset-sum dynamic programming finds the multiset of the other lengths that fills it
closest to capacity, and backtracking gives the counts.  A window's multiset is used as
often as the counts allow, so the plan is bounded by the number of lengths, too.

Pieces get a rank within their length (hot lengths are ranked in buckets), and length
and rank decide sequence and offset by a binary search in the plan.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import bound_batches, stored
from .word_bpe import blocks, encoded, word_ids

CAPACITY = 4096


def pieces(docs: DataFrame, path: str, separator: int = 2, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and a remainder of each document.

    Null and empty texts are the separator alone.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = word_ids(path)
        for b in blocks(batches):
            row, start, length, crc, tokens = [], [], [], [], []
            ids, ends = encoded(w, b.column(1), separator)
            raw, first = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
            for i, last in enumerate(ends.tolist()):
                n = last - first
                for s in range(0, n, capacity):
                    size = min(capacity, n - s)
                    row.append(i), start.append(s), length.append(size), tokens.append(n)
                    crc.append(zlib.crc32(raw[4 * (first + s) : 4 * (first + s + size)]))
                first = last
            cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fill(capacity: int, left: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The multiset of the lengths left (ascending list) whose sum is closest to capacity, not above it."""
    reach, steps = 1, []
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    for size in reversed(lengths):
        if size > capacity:
            continue
        n, k = min(left[size], capacity // size), 1
        while n > 0:
            k = min(k, n)
            steps.append((size, k, reach))
            reach |= (reach << size * k) & mask
            n -= k
            k *= 2
        if reach & full:
            break
    total, counts = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> total & 1:
            counts[size] = counts.get(size, 0) + k
            total -= size * k
    return counts


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """length -> count gives [(first sequence, how many sequences, multiset of lengths)], by minimum bin slack."""
    left = {s: n for s, n in counts.items() if n > 0}
    lengths: list[int] = []
    for s in left:
        insort(lengths, s)
    out, first = [], 0
    while lengths:
        seed = lengths[-1]
        left[seed] -= 1
        usable = lengths if left[seed] else lengths[:-1]
        chosen = fill(capacity - seed, left, usable)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[s] // k for s, k in chosen.items())
        out.append((first, times, chosen))
        first += times
        for s, k in chosen.items():
            left[s] -= k * times
            if not left[s]:
                lengths.remove(s)
    return out


def _search_table(windows: list[tuple[int, int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """By length and first rank: multiplicity, first sequence, offset of the first one in its sequence."""
    used: dict[int, int] = {}
    rows = []
    for first, times, chosen in windows:
        offset = 0
        for size in sorted(chosen, reverse=True):
            k = chosen[size]
            rows.append((size << 40 | used.get(size, 0), k, first, offset))
            used[size] = used.get(size, 0) + k * times
            offset += size * k
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("key", "many", "first", "offset"), cols))


def packed(docs: DataFrame, path: str, separator: int = 2, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every row of docs lies in one piece; repeated rows are packed as often as they stand.
    An empty table gives no piece.
    """
    cut = stored(pieces(docs, path, separator, capacity, text, doc_id), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = _search_table(plan(counts, capacity))
    order = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    rows = ranked(cut, counts, "length", order).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.searchsorted(table["key"], size << 40 | rank, "right") - 1
            nth = rank - (table["key"][at] & ((1 << 40) - 1))
            seq = table["first"][at] + nth // table["many"][at]
            offset = table["offset"][at] + nth % table["many"][at] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
