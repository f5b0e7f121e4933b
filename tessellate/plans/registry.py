"""Named relations, the queries that are registered from them, and how they run over files or a caller's DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import kept
from .dialect import DUCK, SPARK, Dialect

BASE = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
RELATIONS: dict[str, Callable[[Dialect], str]] = {}
QUERIES: list[str] = []
#: Relations that Spark builds with DataFrame code from other relations: name -> (names that it reads, function of those).
FRAMES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}
#: Relations that several others read and that are worth a table: Spark writes each once a call, to the shared folder.
WRITTEN: set[str] = set()
#: Queries of DataFrame code with a DuckDB text of their own.
CHECKS: dict[str, str] = {}
#: Relations that are put together from raw inputs, in place of which a caller may give those: name -> the relation that does it.
ASSEMBLED = {"evidence": "assembled_evidence"}
#: The raw inputs, with their columns. Where a caller gives some of them and no files, the others count as not observed.
INPUTS = {
    "sitemap_url": "pos long, site_host string, loc string, lastmod timestamp_ntz, doc_no long",
    "page_html": "page_id long, url string, html string",
    "robots_txt": "site long, host string, body string",
    "job": "site long, ord long, title string, department string, location string, posted_at timestamp_ntz, description string, ats string",
    "company_post": "company long, employee long, post_id long, kind string, ts timestamp_ntz, is_decision_maker boolean, is_post boolean",
    "competitor": "name string",
}
_FROM = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)")


def relation(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Registers a relation under its function's name. Its text may read base tables and other relations by name."""
    RELATIONS[build.__name__] = build
    return build


def query(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """A relation that is also a query."""
    QUERIES.append(build.__name__)
    return relation(build)


def written(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """A relation that Spark writes once and reads back where others read it."""
    WRITTEN.add(build.__name__)
    return relation(build)


def frame(name: str, *reads: str):
    """Registers DataFrame code as Spark's form of a relation; the relation's text remains DuckDB's."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FRAMES[name] = (reads, build)
        return build

    return register


def text(name: str, d: Dialect, given: frozenset[str] = frozenset(), instead: dict[str, str] | None = None) -> tuple[str, set[str]]:
    """One statement for a relation with all that it reads, and what it reads from outside: base tables and relations in ``given``.

    instead: relations that stand in the place of others.
    """
    parts: dict[str, str] = {}
    instead = instead or {}
    outside: set[str] = set()

    def visit(n: str) -> None:
        if n in parts:
            return
        body = RELATIONS[instead.get(n, n)](d)
        for dep in dict.fromkeys(_FROM.findall(body)):
            if dep in given:
                outside.add(dep)
            elif dep in RELATIONS and dep != n:
                if d.spark and (dep in FRAMES or instead.get(dep, dep) in WRITTEN):
                    outside.add(dep)
                else:
                    visit(dep)
            elif dep in BASE:
                outside.add(dep)
        parts[n] = body

    visit(name)
    recursive = any("WITH_RECURSION" in p for p in parts.values())
    ctes = ",\n".join(f"{n} AS ({p.replace('/*WITH_RECURSION*/', '')})" for n, p in parts.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\nSELECT * FROM {name}", outside


def over(spark: SparkSession, name: str, sf_dir: str | None = None, instead: dict[str, str] | None = None, _made: dict[str, DataFrame] | None = None, **tables: DataFrame) -> DataFrame:
    """A relation over the caller's DataFrames: over(spark, "graded", evidence=df) reads df wherever the relation reads ``evidence``.

    What is not given comes from the files in sf_dir. Without files, a relation of ASSEMBLED that is not given is put together from the raw
    inputs that are, so over(spark, "overall_grade", sitemap_url=..., page_html=..., robots_txt=..., job=..., company_post=...) grades
    sites; inputs that are left out are empty tables, and what they would have shown counts as not observed. Neither the session's views nor its time zone are left changed:
    each input is a view of a name of its own for as long as the statement is analysed.
    """
    if sf_dir is None and instead is None and tables.keys() & INPUTS.keys():
        instead = {k: v for k, v in ASSEMBLED.items() if k not in tables}
    if name in tables:
        return tables[name]
    missing = INPUTS.keys() - tables.keys() if sf_dir is None and instead else set()
    if name in missing:
        return spark.createDataFrame([], INPUTS[name])
    made = {} if _made is None else _made
    if name in made:
        return made[name]

    def held(t: str) -> DataFrame:
        """What a statement or a frame reads by a name; a relation worth a table is written the first time."""
        if t in made or t in tables or (instead or {}).get(t, t) not in WRITTEN:
            return over(spark, t, sf_dir, instead, made, **tables)
        made[t] = kept(over(spark, t, sf_dir, instead, made, **tables), t)
        return made[t]

    if name in FRAMES:
        reads, build = FRAMES[name]
        return build(*(held(r) for r in reads))
    statement, outside = text(name, SPARK, frozenset(tables) | missing, instead)
    views = {}
    for t in sorted(outside):
        if t in missing:
            source = spark.createDataFrame([], INPUTS[t])
        elif t in tables or t in RELATIONS:
            source = held(t)
        elif sf_dir is None:
            raise ValueError(f"{name} reads {t}: give it as a DataFrame")
        else:
            source = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        views[t] = f"_{t}_{uuid.uuid4().hex}"
        source.createOrReplaceTempView(views[t])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return spark.sql(re.sub(_FROM, lambda m: m[0].replace(m[1], views.get(m[1], m[1])), statement))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for view in views.values():
            spark.catalog.dropTempView(view)


#: Queries that are others with relations put in the place of those that they read: name -> (query, what stands for what).
VARIANTS: dict[str, tuple[str, dict[str, str]]] = {}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    name, instead = VARIANTS.get(name, (name, {}))
    return over(spark, name, sf_dir, instead)


def check(name: str) -> str:
    """A query's text for DuckDB."""
    name, instead = VARIANTS.get(name, (name, {}))
    return text(name, DUCK, instead=instead)[0]


def names() -> list[str]:
    return [*QUERIES, *VARIANTS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, n=n: run(n, spark, sf_dir)) for n in names()}


def oracles() -> dict[str, str]:
    return {n: check(n) for n in names()} | CHECKS
