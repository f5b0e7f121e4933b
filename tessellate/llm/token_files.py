"""Token ids of a corpus in files of Re-Pair shards, in ascending id order.

1. Rows are dealt by ranges of (doc_id, hash of the text, place), so that equal ids can
   be split, and sorted within a range.  There are at most RANGES of them, at any size.
2. A task walks its range in blocks of text (word_bpe): the distinct words of a
   block are encoded once, its ids are cut between documents into shards of some
   SHARD_IDS ids, and every shard is compressed by itself (re_pair).  A row of the written
   table is a shard: the ids of its documents, how many ids of its range come before it, and
   the compressed ids.
3. Readers need no other row: starts come from the count before a shard in its range and
   the totals of at most RANGES ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import re_pair
from .re_pair import Shard, compressed
from .storage import bound_batches, stored
from .word_bpe import blocks, encoded, word_ids

RANGES, RANGE_BYTES, SHARD_IDS = 10_000, 32 << 20, 1 << 20


def _cuts(ends: np.ndarray) -> list[int]:
    """Numbers of the documents before which a shard ends: it has SHARD_IDS ids or one document."""
    out, low, before = [0], 0, 0
    while low < len(ends):
        low = max(low + 1, int(np.searchsorted(ends, before + SHARD_IDS, "right")))
        before = int(ends[low - 1])
        out.append(low)
    return out


def written(docs: DataFrame, path: str, end: int, text: str = "text", doc_id: str = "doc_id", least: int = re_pair.LEAST) -> DataFrame:
    """The table of shards: (range, shard, before, n_ids, doc_ids, data), stored. Null ids come first, a null text is an empty one, repeated rows stay; equal ids are in the order of a hash of the text."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(size // RANGE_BYTES, spark.sparkContext.defaultParallelism, 1), RANGES)
    order = [F.col("doc_id").asc_nulls_first(), F.col("mixed"), F.col("place")]
    dealt = rows.select("*", F.xxhash64("text").alias("mixed"), F.monotonically_increasing_id().alias("place")).repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType
    out = StructType([
        StructField("range", IntegerType()), StructField("shard", IntegerType()), StructField("before", LongType()), StructField("n_ids", LongType()),
        StructField("doc_ids", ArrayType(kind)), StructField("data", BinaryType()),
    ])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = word_ids(path)
        number, before = 0, 0
        for b in blocks(batches):
            ids, ends = encoded(w, b.column("text"), end)
            cuts = _cuts(ends)
            for low, high in zip(cuts, cuts[1:]):
                first = int(ends[low - 1]) if low else 0
                part = ids[first : ends[high - 1]]
                names = b.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [b.column("range").slice(0, 1), pa.array([number], pa.int32()), pa.array([before]), pa.array([len(part)]),
                     pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([compressed(part, ends[low:high] - first, least).to_bytes()])],
                    out.names,
                )
                number, before = number + 1, before + len(part)

    made = dealt.select(F.spark_partition_id().alias("range"), "doc_id", "text").mapInArrow(shards, out)
    # Rows are megabytes: look at the size of a row group after each.
    return stored(made, "shards", **{"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"})


def _starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each range: at most RANGES rows."""
    totals = shards.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect()
    out, total = {}, 0
    for r in totals:
        out[r["range"]], total = total, total + r["n"]
    return out


def read(shards: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens and ids, or with ``digest`` ids_crc32) of every document, from the written table alone."""
    bound_batches(shards.sparkSession)
    starts = _starts(shards)
    last = StructField("ids_crc32", LongType()) if digest else StructField("ids", ArrayType(LongType()))
    out = StructType([StructField("doc_id", shards.schema["doc_ids"].dataType.elementType), StructField("start", LongType()), StructField("n_tokens", LongType()), last])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k] for name in b.schema.names}
                ids, ends = Shard.from_bytes(row["data"].as_py()).decoded()
                begins = np.concatenate([[0], ends[:-1]])
                if digest:
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    said = pa.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist())], pa.int64())
                else:
                    said = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                start = starts[row["range"].as_py()] + row["before"].as_py() + begins
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start), pa.array(ends - begins), said], out.names)

    return shards.select("range", "before", "doc_ids", "data").mapInArrow(documents, out)


def spans(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, first, last, ids) for every row (doc_id, first, last) of ``wanted``: ids first .. last - 1 of the documents of this id, cut at their ends.

    Only shards that hold a wanted document are read whole by a task, and only symbols that cover a span are expanded. Ids that no document has give no row.
    """
    kind = shards.schema["doc_ids"].dataType.elementType
    at = shards.select("range", "shard", F.posexplode("doc_ids").alias("nth", "doc_id")).join(wanted.select("doc_id", "first", "last"), "doc_id")
    asked = at.groupBy("range", "shard").agg(F.collect_list(F.struct("nth", "doc_id", "first", "last")).alias("asked"))
    out = StructType([StructField("doc_id", kind), StructField("first", LongType()), StructField("last", LongType()), StructField("ids", ArrayType(LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, asked in zip(b.column(0), b.column(1)):
                shard, rows = Shard.from_bytes(data.as_py()), asked.as_py()
                ids = [shard.ids(r["nth"], r["first"], r["last"]).tolist() for r in rows]
                names = asked.values.field("doc_id")
                yield pa.RecordBatch.from_arrays([names, *(pa.array([r[c] for r in rows], pa.int64()) for c in ("first", "last")), pa.array(ids, pa.list_(pa.int64()))], out.names)

    return shards.join(asked, ["range", "shard"]).select("data", "asked").mapInArrow(cut, out)
