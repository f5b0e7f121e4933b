"""Queries that read files in encodings: made from the test tables in memory, as the binary source gives them."""

from __future__ import annotations

import base64
import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives


def _packed(pages: DataFrame, pack) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for made in archives.by_bytes(pack(k.as_py(), t.as_py() or "") for k, t in zip(b.column(0), b.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], ["path", "content"])

    return pages.select("page_id", "html").mapInArrow(run, "path string, content binary")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def gzip_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _packed(_pages(spark, sf_dir), lambda k, t: (f"s{k}.xml", gzip.compress(t.encode(), 1, mtime=0) if k % 2 else t.encode()))
    return archives.texts(files).select("path", "gz", F.length("body").alias("chars"))


def index_load_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(k: int, t: str):
        raw = t.encode()
        return (f"i{k}.json", raw) if k % 3 == 0 else (f"i{k}.json.gz", gzip.compress(raw, 1, mtime=0)) if k % 3 == 1 else (f"i{k}.json.gz.b64", base64.b64encode(gzip.compress(raw, 1, mtime=0)))

    return archives.index_files(_packed(_pages(spark, sf_dir), pack)).select("path", F.length("body").alias("chars"))


def seed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(k: int, t: str):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name in (f"calib/{k}.json", f"../out{k}.json"):
                info = tarfile.TarInfo(name)
                info.size = len(t.encode())
                tar.addfile(info, io.BytesIO(t.encode()))
        return f"seed{k}.tar", out.getvalue()

    pages = _pages(spark, sf_dir)
    existing = pages.filter("page_id % 4 = 0").select(F.concat(F.lit("calib/"), "page_id", F.lit(".json")).alias("name"))
    return archives.extracted(_packed(pages, pack), existing).select("name", F.length("body").alias("bytes"))


QUERIES = {"gzip_sniff": gzip_sniff, "index_load_encodings": index_load_encodings, "seed_extract": seed_extract}
#: What the queries give, as SQL over the tables that the files are made of.
CHECKS = {
    "gzip_sniff": "SELECT concat('s', page_id, '.xml') AS path, page_id % 2 = 1 AS gz, CAST(length(html) AS INTEGER) AS chars FROM pages",
    "index_load_encodings": "SELECT concat('i', page_id, CASE page_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.json.gz' ELSE '.json.gz.b64' END) AS path, CAST(length(html) AS INTEGER) AS chars FROM pages",
    "seed_extract": "SELECT concat('calib/', page_id, '.json') AS name, CAST(strlen(html) AS INTEGER) AS bytes FROM pages WHERE page_id % 4 <> 0",
}
