"""Running sums and ranks within groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def running(df: DataFrame, group: str, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of the group that come before in the order (which must be total).

    Rows are dealt by ranges of group and order and written. A range sums up its part of every group; those few
    sums are added up by group, and within a range a window adds what is in front. So a group that holds all rows is
    spread over all ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    laid = kept(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = laid.groupBy("_range", group).agg(F.sum(value).alias("_sum"))
    front = sums.withColumn("_front", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_range").alias("_r"), F.col(group).alias("_g"), "_front")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range", group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = laid.withColumn("_inside", inside)
    return placed.join(front, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn(out, F.col("_inside") + F.col("_front")).drop("_range", "_inside", "_r", "_g", "_front")
