"""Token counts from pre-token frequencies.

A text is cut into pre-tokens: maximal runs without white space, with the one space in
front, and runs of white space.  The tokenizer's own pattern never joins what lies in
two of them, so their piece counts add up.  Three jobs:

1. The distinct pre-tokens of the corpus are aggregated with their frequencies, and the
   pieces of each are counted once.
2. Every document is reduced to its pre-token frequencies.  The FREQUENT most frequent
   pre-tokens, a bounded table, are broadcast and joined where the document lies.
3. What is left of a document, its rare pre-tokens, is joined to the table by a shuffle,
   which hot pre-tokens do not enter; the counts are summed by document.

No ids are kept.  A pre-token over LONG characters stands for nothing but itself (blobs,
scripts without spaces), so it is counted where it is and never shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, stored

FREQUENT, LONG = 1 << 18, 48
_HELD = 1 << 18  # distinct pre-tokens that a task adds up before it hands them on
# The white space of the tokenizers' pattern engine (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRETOKEN = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class JsonCounter:
    """A byte-level BPE tokenizer file whose pre-tokenizer keeps a space with the word after it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation(), self.model.no_padding()
        special = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special strings between them."""
        if self.special is None or not self.special.search(text):
            return _PRETOKEN.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in _PRETOKEN.findall(part)], len(parts) - 1

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for low in range(0, len(pretokens), 4096) for e in self.model.encode_batch_fast(pretokens[low : low + 4096], add_special_tokens=False)]


class PieceCounter:
    """A SentencePiece model: its parts between spaces are the pre-tokens."""

    def __init__(self, path: str):
        from .piece_bpe import codec

        self.codec = codec(path)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        return self.codec.words(text), 0

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(ids) for low in range(0, len(pretokens), 65536) for ids in self.codec.encode_words(pretokens[low : low + 65536])]


@lru_cache(maxsize=4)
def counter(path: str) -> JsonCounter | PieceCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def pretoken_table(texts: DataFrame, path: str) -> DataFrame:
    """texts(text) -> (pretoken, n, pieces): every distinct pre-token of at most LONG characters, its frequency and its pieces, counted once."""
    bound_batches(texts.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = counter(path), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update([p for p in c.pretokens(t or "")[0] if len(p) <= LONG])
                if len(seen) > _HELD:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.pieces(b.column(0).to_pylist()), pa.int32())], ["pretoken", "n", "pieces"])

    distinct = texts.select("text").mapInArrow(tally, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "pretoken string, n long, pieces int")


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): a row for each row of docs, repeated ids and null ids included.

    Null and empty texts: 0 and 0. An empty table gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = stored(pretoken_table(rows, path), "pretokens")
    top = table.orderBy(F.desc("n"), "pretoken").limit(frequent).select("pretoken", "pieces").toArrow()  # at most ``frequent`` rows of at most LONG characters
    known = spark.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["pieces"].to_pylist())))
    rest = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int32())]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, pieces = counter(path), known.value
        for b in batches:
            size, total, rare = [], [], []
            for t in b.column(2).to_pylist():
                t = t or ""
                found, specials = c.pretokens(t)
                frequencies = Counter(found)
                left = [p for p in frequencies if p not in pieces]
                long = [p for p in left if len(p) > LONG]
                out = sum([n * pieces[p] for p, n in frequencies.items() if p in pieces])
                size.append(len(t.encode()))
                total.append(specials + out + sum(n * frequencies[p] for p, n in zip(long, c.pieces(long))))
                rare.append([{"pretoken": p, "n": frequencies[p]} for p in left if len(p) <= LONG])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(rare, rest)], ["row", "doc_id", "n_bytes", "counted", "rest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    reduced = stored(numbered.mapInArrow(reduce, f"row long, doc_id {kind}, n_bytes long, counted long, rest array<struct<pretoken:string,n:int>>"), "frequencies")
    joined = reduced.select("row", F.inline("rest")).join(table.select("pretoken", "pieces"), "pretoken")
    sums = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return reduced.select("row", "doc_id", "n_bytes", "counted").join(sums, "row", "left").select("doc_id", "n_bytes", (F.col("counted") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
