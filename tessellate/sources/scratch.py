"""Tables that a job writes on its way, in the folder that driver and executors share. They go when the interpreter ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@lru_cache(maxsize=8)
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessellate-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, label: str) -> str:
    """A new folder's name, which is deleted in the end."""
    _made.append((spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: its lineage is cut, and lost executors cost nothing that is done."""
    path = place(df.sparkSession, label)
    void = {f.name for f in df.schema if f.dataType.typeName() == "void"}  # Parquet has no such column
    df.drop(*void).write.parquet(path)
    found = df.sparkSession.read.schema(StructType([f for f in df.schema if f.name not in void])).parquet(path)
    return found.select(*(F.lit(None).alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in df.schema)) if void else found


@atexit.register
def _clean_up() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
