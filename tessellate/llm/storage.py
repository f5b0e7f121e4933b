"""Reading tables, shared intermediate tables and Arrow batch bounds."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.scratch import shared_dir

ARROW_BYTES = 2 << 20
ARROW_ROWS = 4096

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, so that very long texts do not add up in a worker. A session's own smaller bounds stay.

    Spark reads these settings when a plan starts, which is after the operator has returned, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, upper and lower case alike: the name, with as many underscores as it takes."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. options: of the Parquet writer.

    What the driver held for the plan so far, its broadcast tables and shuffles, is garbage from here on. Spark lets go of them
    only when the driver collects, and an operator of many rounds would fill the driver's whole heap before it does so by itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path))
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def appended(docs: DataFrame, text: str, new: dict[str, str], compute: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """docs with the columns ``new`` (name -> type) computed from a text column, batch by batch; all rows and columns stay.

    The names must be new to docs: take them from fresh().
    """
    bound_batches(docs.sparkSession)
    if set(new) & set(docs.columns):
        raise ValueError(f"docs already has a column of {sorted(new)}")
    at, names = docs.columns.index(text), [*docs.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *compute(b.column(at).to_pylist())], names)
        pa.default_memory_pool().release_unused()

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])
    return docs.mapInArrow(run, schema)


def released(out: DataFrame, *used: DataFrame) -> DataFrame:
    """out, which is a stored table of its own, after the stored tables that went into it are deleted."""
    ends = {f.rsplit("/", 2)[-2] for df in used for f in df.inputFiles()}
    for entry in list(_written):
        if entry[1].rsplit("/", 1)[-1] in ends:
            _delete(*entry)
            _written.remove(entry)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
