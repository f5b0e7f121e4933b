"""Files that are not tables: compressed sitemaps, tar bundles, and index files in several encodings."""

from __future__ import annotations

import base64
import gzip
import io
import posixpath
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = 8 << 20
_GZ = re.compile(r"\.gz($|\?)", re.IGNORECASE)


def inflated(data: bytes | None) -> bytes:
    """Bytes as they are, or unpacked if they open like gzip; what is broken stays as it is."""
    if not data or data[:2] != b"\x1f\x8b":
        return data or b""
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return data


def compressed(name: str = "path", content: str = "content"):
    """Is a file gzip, by suffix or first bytes?"""
    return F.col(name).rlike(r"(?i)\.gz($|\?)") | (F.hex(F.substring(content, 1, 2)) == "1F8B")


def by_bytes(rows: Iterator[tuple], most: int = BATCH) -> Iterator[list[tuple]]:
    """Rows in lists that end once their texts and bytes come to more than most."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _per_file(files: DataFrame, schema: str, rows) -> DataFrame:
    """A row for each that rows(path, content) gives, in batches of about BATCH bytes of output: what is unpacked may be far more than what is read."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in by_bytes(r for path, data in zip(b.column(0), b.column(1)) for r in rows(path.as_py(), data.as_py() or b"")):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def texts(files: DataFrame) -> DataFrame:
    """(path, gz, body): files of the binary source as text, unpacked where they are compressed."""
    return _per_file(files, "path string, gz boolean, body string", lambda path, data: [(path, data[:2] == b"\x1f\x8b" or bool(_GZ.search(path)), inflated(data).decode("utf-8", "replace"))])


def members(files: DataFrame) -> DataFrame:
    """(path, name, body): the regular files of tar bundles, packed or not; names that leave the bundle are refused. A bundle that cannot be read has one row without a name."""

    def rows(path: str, data: bytes):
        found = []
        try:
            with tarfile.open(fileobj=io.BytesIO(inflated(data))) as tar:
                for m in tar:
                    name = posixpath.normpath(m.name)
                    if m.isfile() and not name.startswith(("/", "..")):
                        found.append((path, name, tar.extractfile(m).read()))
        except (tarfile.TarError, OSError, EOFError):
            found.append((path, None, None))
        return found

    return _per_file(files, "path string, name string, body binary", rows)


def extracted(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Members that existing(name) does not have: nothing is overwritten. Bundles that cannot be read give none."""
    return members(files).filter("name is not null").join(existing.select("name"), "name", "left_anti")


def encoded_text(path: str, data: bytes) -> str:
    """An index file's text, peeled of .b64 and .gz in the order of its name."""
    name = path.lower()
    if name.endswith(".b64"):
        data, name = base64.b64decode(data), name[:-4]
    return inflated(data).decode("utf-8")


def index_files(files: DataFrame) -> DataFrame:
    """(path, body): index files in any of their encodings."""
    return _per_file(files, "path string, body string", lambda path, data: [(path, encoded_text(path, data))])


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def evidence_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; those that cannot be read come as rows with only their file name."""
    read = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))


def write_evidence(df: DataFrame, path: str, derived: tuple[str, ...] = ("scoring", "lead_score")) -> None:
    """Evidence is stored, what is derived from it never."""
    df.drop(*derived).write.mode("append").json(path)
