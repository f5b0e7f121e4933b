"""Byte-balanced shards by Karmarkar-Karp differencing. Law: ``bytes``.

Rows with equal texts form a group that is never cut.  The items that are differenced
are the groups of at least 1/HEAVY of all bytes, each by itself (so at most HEAVY of
them), and BUNDLES hash bundles of all smaller groups.  Their number is bounded
whatever the corpus, so differencing runs on the driver, and the maps from item to
shard are broadcast under that bound.  Texts are never shuffled: a row is 32 bytes.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import stored

SHARDS, HEAVY, BUNDLES = 16, 8192, 4096


def differencing(sizes: list[int], parts: int = SHARDS) -> list[int]:
    """The part of each item. The two partial partitions of the largest spread are combined, oppositely ordered."""
    serial = count()
    heap = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        sums = [(sizes[i], i)] + [(0, None)] * (parts - 1)
        heap.append((-sizes[i] if parts > 1 else 0, next(serial), sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = [(x + y, (m, n) if m is not None and n is not None else n if m is None else m) for (x, m), (y, n) in zip(a, reversed(b))]
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], next(serial), both))
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        todo = [tree] if tree is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            else:
                out[node] = part
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of docs.

    A null text is grouped with the empty one (size 1, CRC-32 0). Null ids and repeated rows keep their
    rows and get slots of their own. An empty table gives an empty result. grown_shard is null under this law.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(whole).cast("long") + 1).alias("size"),
            F.crc32(whole).alias("text_crc32"),
            F.xxhash64(whole).alias("group"),
        ),
        "sizes",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    groups = keyed.groupBy("group").agg(F.sum("size").alias("bytes"))
    heavy = F.col("bytes") * HEAVY >= F.lit(total)
    items = groups.groupBy(F.when(heavy, F.col("group")).alias("group"), F.when(~heavy, F.pmod("group", F.lit(BUNDLES))).alias("bundle"))
    found = items.agg(F.sum("bytes").alias("bytes")).orderBy("group", "bundle").collect()  # at most HEAVY + BUNDLES rows
    part = differencing([r.bytes for r in found], shards)
    spark = docs.sparkSession
    single = spark.createDataFrame([(r.group, p) for r, p in zip(found, part) if r.group is not None], "group long, own int")
    bundle = spark.createDataFrame([(r.bundle, p) for r, p in zip(found, part) if r.group is None], "bundle long, shared int")
    placed = keyed.withColumn("bundle", F.pmod("group", F.lit(BUNDLES))).join(F.broadcast(single), "group", "left").join(F.broadcast(bundle), "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    sizes = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}  # a row a shard
    return ranked(placed, sizes, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
