"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, by Lloyd's rounds with Hamerly's bounds.

A stored row carries, for each part, its entry, an upper bound of its distance to that
entry and a lower bound of its distance to every other one.  When entries move, the bounds
move with them.  A part is scanned in full only if its upper bound, made exact
first, is not strictly below the larger of its lower bound and half the way from its
entry to the next one; so a tie is always scanned and goes to the lower index.

Components are integers, and so are entries (floors of means).  Bounds are integers as
well: roots of exact squares, rounded up or down, so they hold without a word on float
errors.  What does not fit into 64 bits is computed with Python's integers.

A round is two jobs: one rewrites the state with new codes and bounds, the other sums the
parts by entry in every task and adds up the at most parts x entries sums of the tasks.
Only codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, LongType, StringType, StructField, StructType

from .storage import bound_batches, fresh, released, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_FAR, _MOST = np.int64(2**60), 2**63 - 1  # two bounds of _FAR can be added


def whole(x: float) -> int:
    """floor(SCALE x)."""
    return int(x) * SCALE if abs(x) > 2**53 else math.floor(x * SCALE)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of each component: 64-bit integers if squared distances of such vectors fit, Python's otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if small(scaled):
        return scaled.astype(np.int64)
    return np.array([whole(float(x)) for x in vectors.reshape(-1)], object).reshape(vectors.shape)


def small(rows: np.ndarray) -> bool:
    """Do squared distances of such vectors fit into 62 bits?"""
    return not rows.size or float(np.abs(rows).max()) < 2**30 / rows.shape[-1] ** 0.5


def root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Integer square roots, rounded down or up, as 64-bit integers; beyond them, the bound that says nothing."""
    if squares.dtype == object:
        down = np.array([math.isqrt(int(s)) for s in squares.reshape(-1)], object).reshape(squares.shape)
        exact = down + (down * down < squares) if up else down
        return np.minimum(exact, int(_FAR)).astype(np.int64) if up else np.where(exact < int(_FAR), exact, 0).astype(np.int64)
    down = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    down -= down * down > squares
    down += (down + 1) * (down + 1) <= squares
    return down + (down * down < squares) if up else down


@dataclass
class Codebooks:
    """entries[p]: the integer entries of part p, a row each."""

    entries: list[np.ndarray]
    bounds: list[int]  # where parts begin and end

    def halves(self) -> np.ndarray:
        """By part and entry: the floor of half the way to the next entry."""
        out = []
        for e in self.entries:
            far = ((e[:, None, :] - e[None, :, :]) ** 2).sum(2)
            near = [min((far[i, j] for j in range(len(e)) if j != i), default=None) for i in range(len(e))]
            out.append([int(_FAR) if n is None else min(math.isqrt(int(n) // 4), int(_FAR)) for n in near])
        return np.array(out, np.int64).reshape(len(self.entries), -1)

    def moves(self, before: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(by part and entry: how far it moved, rounded up; by part and entry: the furthest that any other one moved)."""
        own = np.array([root(((a - b) ** 2).sum(1), True) for a, b in zip(self.entries, before.entries)], np.int64).reshape(len(self.entries), -1)
        others = np.array([[max((m for j, m in enumerate(row) if j != i), default=0) for i in range(len(row))] for row in own.tolist()], np.int64).reshape(own.shape)
        return own, others

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for row in e for x in row).encode()).hexdigest()

    def nearest(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, squared distance, squared distance of the second nearest) by a full scan; ties go to the lower index."""
        far = ((rows[:, None, :] - self.entries[p][None, :, :]) ** 2).sum(2)
        at = np.argmin(far, 1)
        best = far[np.arange(len(far)), at]
        if far.shape[1] == 1:
            return at, best, np.full(len(far), int(_FAR) ** 2 if far.dtype == object else _FAR)
        far[np.arange(len(far)), at] = far.max() + 1
        return at, best, far.min(1)

    def distances(self, p: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((rows - self.entries[p][codes]) ** 2).sum(1)

    def assign(self, p: int, rows: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> int:
        """Brings codes and bounds of part p up to date, in place. Returns how many rows were scanned in full."""
        safe = np.maximum(lower, half[codes])
        open_ = np.flatnonzero(upper >= safe)
        if len(open_):
            upper[open_] = root(self.distances(p, rows[open_], codes[open_]), True)
            open_ = open_[upper[open_] >= safe[open_]]
        for low in range(0, len(open_), 4096):
            scan = open_[low : low + 4096]
            at, best, second = self.nearest(p, rows[scan])
            codes[scan], upper[scan], lower[scan] = at, root(best, True), root(second, False)
        return len(open_)


def kept(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, empty, or of null or non-finite components, as (vec_id, vector, label columns as they are)."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)))


def smallest(table: DataFrame, column: str, many: int) -> list:
    """The smallest distinct values of a column, nulls aside: each task hands on that many."""
    values = table.select(column).filter(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = (pa.concat_arrays([held, b.column(0)]) if held is not None else b.column(0)).unique()
            held = held.take(pc.select_k_unstable(held, many, sort_keys=[("", "ascending")]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], [column])

    return [r[0] for r in values.mapInArrow(run, values.schema).distinct().orderBy(column).limit(many).collect()]


def _state(codes, upper, lower) -> list[pa.Array]:
    lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.reshape(-1), kind))
    return [lists(codes, pa.int16()), lists(upper, pa.int64()), lists(lower, pa.int64())]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Coded:
    """rows: vec_id, label, codes (an entry a part), error; books: the final codebooks."""

    rows: DataFrame
    books: Codebooks


def coded(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Coded:
    """Codes of all kept vectors after ``rounds`` rounds and a last assignment.

    The dimension is that of the kept vector with the smallest vec_id; vectors of another one are dropped. Where it is no multiple of
    ``parts``, part p begins at floor(p dimension / parts). Entries begin as the parts of the ``entries`` smallest distinct vec_ids, of
    repeated ones the smallest vector; a null vec_id is never among them. With fewer vectors there are fewer entries; with none
    (or only null vec_ids) the result is empty. Repeated rows count as often as they stand. An error, or a sum of errors, beyond 2^63 - 1 is given as this number.
    """
    spark = table.sparkSession
    bound_batches(spark)
    good = kept(table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")), "vec_id", "vector")
    least = good.filter("vec_id IS NOT NULL").agg(F.min(F.struct("vec_id", "vector")).alias("s")).first()["s"]
    width = len(least["vector"]) if least else 0
    good = good.filter(F.size("vector") == width)
    ids = smallest(good, "vec_id", entries) if least else []
    seeds = [r["v"] for r in good.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("v")).orderBy("vec_id").collect()]
    bounds = [p * width // parts for p in range(parts + 1)]
    start = integers(np.array(seeds, np.float64).reshape(len(seeds), width))
    books = Codebooks([start[:, a:b] for a, b in zip(bounds, bounds[1:])], bounds)

    out = StructType([*good.schema.fields, StructField("codes", ArrayType(ShortType())), StructField("upper", ArrayType(LongType())), StructField("lower", ArrayType(LongType()))])
    end = StructType([*out.fields[:1], out.fields[2], out.fields[3], StructField("error", LongType())])
    sums_of = StructType([StructField("part", LongType()), StructField("entry", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(StringType()))])

    def step(books: Codebooks, before: Codebooks | None, last: bool):
        half = books.halves()
        own, others = books.moves(before) if before else (None, None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = integers(_matrix(b.column(1), width))
                if before is None:  # bounds that say nothing: every part is scanned
                    codes, upper, lower = np.zeros((len(rows), parts), np.int64), np.full((len(rows), parts), _FAR), np.zeros((len(rows), parts), np.int64)
                else:
                    codes, upper, lower = (_matrix(b.column(k), parts).astype(np.int64) for k in (3, 4, 5))
                error = np.zeros(len(rows), rows.dtype)
                for p, (a, e) in enumerate(zip(bounds, bounds[1:])):
                    c, u, low = codes[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    if before is not None:
                        u, low = np.minimum(u + own[p][c], _FAR), np.maximum(low - others[p][c], 0)
                    books.assign(p, rows[:, a:e], c, u, low, half[p])
                    codes[:, p], upper[:, p], lower[:, p] = c, u, low
                    if last:
                        error = error + books.distances(p, rows[:, a:e], c)
                made = _state(codes, upper, lower)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), made[0], pa.array([min(x, _MOST) for x in error.tolist()], pa.int64())], end.names) if last else pa.RecordBatch.from_arrays([*b.columns[:3], *made], out.names)

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((entries, width), object)
        for b in batches:
            rows, codes = integers(_matrix(b.column(0), width)), _matrix(b.column(1), parts)
            for p, (a, e) in enumerate(zip(bounds, bounds[1:])):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for k in np.unique(codes[:, p]):
                    total[k, a:e] += rows[codes[:, p] == k, a:e].sum(0)  # a batch's sums fit, a task's are Python's integers
        at = [(p, k) for p in range(parts) for k in range(entries) if n[p, k]]
        sums = [[str(x) for x in total[k, bounds[p] : bounds[p + 1]]] for p, k in at]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int64()), pa.array([k for _, k in at], pa.int64()), pa.array([int(n[p, k]) for p, k in at], pa.int64()), pa.array(sums, pa.list_(pa.string()))], sums_of.names)

    def added(of_tasks: pa.Table) -> pa.Table:
        sums = of_tasks.column("sums").combine_chunks()
        total = np.array([int(x) for x in sums.flatten().to_pylist()], object).reshape(len(sums), -1).sum(0)
        return pa.table([of_tasks.column("part").slice(0, 1), of_tasks.column("entry").slice(0, 1), [pc.sum(of_tasks.column("n")).as_py()], pa.array([[str(x) for x in total]], pa.list_(pa.string()))], schema=of_tasks.schema)

    state, before = good, None
    for _ in range(rounds if seeds else 0):
        new = stored(state.mapInArrow(step(books, before, False), out), "codes")
        state = released(new, state) if before else new
        # At most parts x entries rows, whatever the table's size.
        found = state.select("vector", "codes").mapInArrow(summed, sums_of).groupBy("part", "entry").applyInArrow(added, sums_of).collect()
        moved = [e.astype(object) for e in books.entries]
        for r in found:
            moved[r["part"]][r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
        fits = all(small(e) for e in moved)
        before, books = books, Codebooks([e.astype(np.int64) if fits else e for e in moved], bounds)
    if not seeds:
        return Coded(spark.createDataFrame([], end), books)
    return Coded(state.mapInArrow(step(books, before, True), end), books)


def digests(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    found = coded(table, vec_id=vec_id, vector=vector, label=label)
    rows = stored(found.rows, "coded")
    name = lambda c, of: F.col(c).eqNullSafe(F.col(of))
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))))
    return rows.join(sums, name("label", "of")).select("vec_id", code.alias("code"), "error", "label_error", F.lit(found.books.digest()).alias("codebooks_sha256"))


def decoded(rows: DataFrame, books: Codebooks, codes: str = "codes") -> DataFrame:
    """rows with ``vector_``: the entries that the codes name, divided by SCALE. Null codes give null."""
    name = fresh(rows, "vector_")
    pieces = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in row)) for row in e)) for e in books.entries))
    return rows.withColumn(name, F.flatten(F.transform(F.col(codes), lambda c, p: F.element_at(F.element_at(pieces, p + 1), c.cast("int") + 1))))
