"""Gapless ranks within a few large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANK_BUCKET = 1000


def ranked(rows: DataFrame, sizes: dict[int, int], by: str, order: list[str], bucket: int = RANK_BUCKET) -> DataFrame:
    """rows with ``rank``, gapless from 0 within each value of ``by``.

    sizes: the count of each value (a bounded number of values). A value is ranked in as many buckets as
    its count needs, and the bucket's rows in front are added, so no value is sorted in one task.
    """
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(s, -(-n // bucket)) for s, n in sizes.items()] or [(0, 1)], f"{by} long, _cuts long")
    dealt = rows.join(F.broadcast(cuts), by).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_cuts"))).drop("_cuts")
    fronts = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    fronts = fronts.withColumn("_front", F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("rank", inside).join(fronts, [by, "_bucket"]).withColumn("rank", F.col("rank") + F.coalesce("_front", F.lit(0))).drop("_front", "_bucket")
