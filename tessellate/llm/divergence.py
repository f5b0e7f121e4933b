"""How far the sources of a language are apart, by smoothed term rates.

1. Tasks count terms by language and source as they read, and hand on sums; a shuffle adds
   them up.  No row stands for a word, so a source with a third of all text is no hot key.
2. A language's kept terms get wide vectors: an array with the source's number and
   the count for every source that has the term.  Vectors are dealt by language and a hash of the term.
3. From each vector higher-order functions make the rates of all sources, and for every
   pair of sources how far they are apart beyond what two sources without the term are.
   Those differences are summed before they are shuffled; what sources without a term
   are apart, times the number of kept terms, is added to the sums by pair.  So a vector
   costs the number of sources that have the term times the number of all sources.

All arithmetic is in integers: rates are parts of SCALE, divided in three steps of 1,000.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .storage import bound_batches, stored

SCALE, PRIOR, LEAST_DOCUMENTS, TOP_TERMS = 1_000_000_000, 5, 30, 50
#: A task's counts are handed on when there are this many, and the vectors of a language are dealt to this many groups.
HELD, DEALT = 1 << 18, 64
_NUL = b"\0"
# Terms are runs of ASCII letters and of bytes from 128; only A to Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents with the term, summed. Nulls count as ''. Every group has a row with a null term."""
    bound_batches(docs.sparkSession)
    out = StructType([StructField(c, StringType()) for c in ("lang", "source", "term")] + [StructField(c, LongType()) for c in ("n", "n_docs")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for words, *group in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = words.encode().translate(_LETTERS).split()
                terms, documents = held.setdefault(tuple(group), (Counter(), Counter()))
                size -= len(terms)
                terms.update(words)
                documents.update(set(words))
                size += len(terms)
                if size >= HELD:
                    yield from handed(held)
                    held, size = {}, 0
        yield from handed(held)

    def handed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (name, source_name), (terms, documents) in held.items():
            words = list(terms)
            for low in range(0, len(words) + 1, 1 << 14):
                part = words[low : low + (1 << 14)]
                rows = [w.decode() for w in part], [terms[w] for w in part], [documents[w] for w in part]
                if not low:
                    rows = [None, *rows[0]], [0, *rows[1]], [0, *rows[2]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), pa.string()), pa.array([source_name] * len(rows[0]), pa.string()), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], out.names)

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")) for c in (text, lang, source)))
    return rows.mapInArrow(count, out).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def rate(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), exact up to totals of 9e15: SCALE is 1,000 cubed, and the fraction is at most 1."""
    over = lambda a, b: F.call_function("div", a, b)
    below, rest, whole = F.greatest(total + PRIOR * kept, F.lit(1)), n + PRIOR, F.lit(0).cast("long")  # 1: no terms, nothing to rate
    for _ in range(3):
        whole, rest = whole * 1000 + over(rest * 1000, below), rest * 1000 % below
    return whole + 1


def vectors(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(languages, wide vectors).

    languages: (lang, kept, total, sources: array of (source, total) in the order of the names); vectors: (lang, term, n, counts: map from the source's number to its count).
    """
    per = Window.partitionBy("lang").orderBy("source")
    numbered = counts.filter("term IS NULL").select("lang", "source").withColumn("number", F.row_number().over(per) - 1)
    terms = counts.filter("term IS NOT NULL").join(numbered, ["lang", "source"])
    wide = terms.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("number", "n"))).alias("counts"))
    wide = stored(wide.filter(F.col("n_docs") >= least).drop("n_docs"), "vectors")
    by_source = wide.select("lang", F.explode("counts").alias("number", "n")).groupBy("lang", "number").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    totals = numbered.join(by_source, ["lang", "number"], "left").groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    return stored(totals.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))), "languages"), wide


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a row for each other source of the language, ``term`` the ``top`` terms that a source has more often than its language.

    Null text, lang and source are ''. Repeated rows count as often as they stand. Ties are ranked in the UTF-8 order of the items.
    A language without kept terms has pairs of value 0; one with a single source has no pair; an empty table has no row.
    """
    languages, wide = vectors(stored(counted(docs, text, lang, source), "terms"), least)
    absent = languages.withColumn("absent", F.transform("sources", lambda s: rate(F.lit(0).cast("long"), s["total"], F.col("kept"))))
    # Each language meets its vectors in DEALT groups, so that one with most terms is no hot key.
    dealt = absent.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rated = wide.withColumn("group", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int")).join(dealt, ["lang", "group"])
    rated = rated.withColumn("whole", rate(F.col("n"), F.col("total"), F.col("kept"))).drop("group")
    rates = F.transform("sources", lambda s, k: F.when(F.map_contains_key("counts", k), rate(F.element_at("counts", k), s["total"], F.col("kept"))).otherwise(F.element_at("absent", k + 1)))
    rated = rated.select("lang", "term", "counts", "whole", "absent", rates.alias("rates"), "sources")

    apart = lambda r, i, j: F.abs(r[i] - r[j])
    numbers = F.sequence(F.lit(0), F.size("rates") - 1)
    others = lambda i: F.filter(numbers, lambda j: (j > i) | ((j < i) & ~F.map_contains_key("counts", j)))
    pair = lambda i, j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), (apart(F.col("rates"), i, j) - apart(F.col("absent"), i, j)).alias("more"))
    contributions = F.flatten(F.transform(F.array_sort(F.map_keys("counts")), lambda i: F.transform(others(i), lambda j: pair(i, j))))
    sums = rated.select("lang", F.inline(contributions)).groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))

    alone = absent.select("lang", "kept", "absent", "sources", F.posexplode("sources").alias("a", "from"))
    pairs = alone.select("lang", "kept", "a", F.col("from.source").alias("source"), F.element_at("absent", F.col("a") + 1).alias("own"), F.posexplode(F.arrays_zip("sources", "absent")).alias("b", "to")).filter("a <> b")
    pairs = pairs.select("lang", "source", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("to.sources.source").alias("item"), (F.col("kept") * F.abs(F.col("own") - F.col("to.absent"))).alias("base"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("more", F.lit(0))).alias("value"))

    above = rated.select("lang", "term", "whole", F.explode(F.transform(F.map_entries("counts"), lambda e: F.struct(F.element_at("sources", e["key"] + 1)["source"].alias("source"), F.element_at("rates", e["key"] + 1).alias("rate")))).alias("s"))
    terms = above.select("lang", F.col("s.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("s.rate") - F.col("whole")).alias("value")).filter("value > 0")

    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranks).unionByName(terms.withColumn("rank", ranks).filter(F.col("rank") <= top))
