"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once: the ledger holds a document's measurements and one bit a
failed rule.  Policies are masks over the bits, with versions; they are applied, and
their rules ablated, by bit operations on the ledger or on the counts of its distinct
bit sets (at most 2^rules rows), without another look at a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bytes that separate words, and the symbols that are counted.
BLANK = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measurements) is true. Bits are never reused for another rule."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("strict", 1, tuple(r.name for r in RULES)),
    Policy("lines", 1, ("few_words", "duplicate_lines")),
)
PRODUCTION = POLICIES[1]


def bound_to(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside a lambda a bare expression would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more, the first one included."""

    def windows(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))
        return bound_to(each, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    def covered(w: Column) -> Column:
        by_hash = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bound_to(by_hash, lambda s: F.filter(s, lambda x, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == x["h"]))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = bound_to(places, lambda p: F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - x)).otherwise(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 2 * WINDOW - (WINDOW - 1), 0).otherwise(bound_to(F.transform(words, lambda x: F.xxhash64(x)), windows)).cast("long")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id and the measurements): a row for each row of docs; a null text measures like an empty one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nothing = lambda c, chars: F.length(F.translate(c, chars, ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: nothing(x, BLANK) > 0)
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        nothing(F.col("text"), BLANK).cast("long").alias("word_chars"),
        (F.length("text") - nothing(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        bound_to(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("lines"),
    )
    return rows.select("doc_id", bound_to(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"), "word_chars", "n_symbols", "lines").select("doc_id", "w.*", "word_chars", "n_symbols", "lines.*")


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured() with ``failed``: a long with the bit of every rule that fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return measured(docs, text, doc_id).withColumn("failed", bits)


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A row a policy and rule: documents, rejected by the policy, failing the rule, and rejected by this rule alone.

    The ledger is first counted by bit set; the rest is arithmetic on those few rows.
    """
    counts = book.groupBy("failed").agg(F.count("*").alias("n"))
    cases = F.array(*(F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit")) for p in policies for r in RULES if r.name in p.rules))
    rows = counts.select("failed", "n", F.inline(cases))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return rows.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_by_this_alone"),
    )
