"""Language identification by prediction by partial matching.

Each language has a context tree of bytes: counts of every byte after the 0 to ORDER
bytes in front of it.  The code length of a byte is -log2 of its probability in the
longest context that was seen; a byte new there costs the escape of that context
(distinct / (total + distinct), method C) and goes on in the next shorter one, and at
last to one of 256.  The statistics are frozen after training, so a code length depends
only on a byte and the ORDER bytes in front of it, and is computed once for each
distinct string of ORDER + 1 bytes in a batch.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, stored

ORDER = 4
#: A language's tree is fitted on a hash sample of about so many of its documents, fewer if there are fewer.
TRAINING_DOCUMENTS = 1200
#: And on so many of all languages together, so that the model stays bounded however many languages are named.
TRAINING_TOTAL = 24_000
#: So many bytes of text of all languages together, and so many different strings of ORDER + 1 bytes.
TRAINING_BYTES, MODEL_STRINGS = 64 << 20, 4_000_000
UNDETERMINED = "und"
_SHARE = 1 << 30
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 19  # bytes of text at a time


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: the number of its text, and the byte with the ORDER in front of it (zeros at the start) as one number."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(x for t in texts for x in (bytes(ORDER), t)), np.uint8).astype(np.int64)
    key = flat[ORDER:].copy()
    for k in range(1, ORDER + 1):
        key |= flat[ORDER - k : len(flat) - k] << 8 * k
    owner = np.repeat(np.arange(len(texts)), sizes)
    return owner, key[np.arange(len(owner)) + ORDER * owner]


@dataclass(frozen=True)
class Tree:
    """Sorted strings of every order with their counts, and sorted contexts with total and distinct."""

    strings: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray) -> Tree:
        strings, contexts = [], []
        for order in range(ORDER + 1):
            known, at = np.unique(key & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(at, count, len(known))
            ctx, at = np.unique(known >> 8, return_inverse=True)
            strings.append((known, n))
            contexts.append((ctx, np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float)))
        return cls(strings, contexts)

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of each string's last byte after the others."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        for order in range(ORDER, -1, -1):
            k = key[todo] & ((1 << 8 * (order + 1)) - 1)
            known, n = self.strings[order]
            ctx, total, distinct = self.contexts[order]
            if not len(ctx):
                continue
            c = np.minimum(np.searchsorted(ctx, k >> 8), len(ctx) - 1)
            seen = ctx[c] == k >> 8
            s = np.minimum(np.searchsorted(known, k), len(known) - 1)
            hit = known[s] == k
            out[todo[hit]] -= np.log2(n[s[hit]] / (total[c[hit]] + distinct[c[hit]]))
            escape = seen & ~hit
            out[todo[escape]] -= np.log2(distinct[c[escape]] / (total[c[escape]] + distinct[c[escape]]))
            todo = todo[~hit]
        out[todo] += 8
        return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (size < _BLOCK or high == low):
                size += len(texts[high])
                high += 1
            owner, key = grams(texts[low:high])
            code, distinct = pd.factorize(key)
            for k, tree in enumerate(self.trees):
                out[low:high, k] = np.bincount(owner, tree.bits(distinct)[code], high - low) if len(code) else 0
            low = high
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): score is the share of the best code's probability; ties go to the first by name.

        Null texts and texts without a letter: und, 0. Without a trained language likewise.
        """
        speaks = [bool(t and _LETTER.search(t)) and bool(self.languages) for t in texts]
        bits = self.code_lengths([t.encode().lower() if s else b"" for t, s in zip(texts, speaks)])
        out = []
        for row, s in zip(bits, speaks):
            if not s:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(row.argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum())))
        return out


def trained(docs: DataFrame, keep: Column | None = None, bound: int = TRAINING_DOCUMENTS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most: int = MODEL_STRINGS) -> Model:
    """A model of the languages named in docs, from the rows for which ``keep`` holds; every one of them with a text in the sample is learned.

    Rows without text, language or id teach nothing. The sample is bounded in documents and in bytes, and so are the strings
    of ORDER + 1 bytes: a language with more than its share of ``most`` leaves out its rarest counts, but never all.
    A language whose documents the sample misses takes its smallest document by hash. An empty table gives a model of no language.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null")
    if keep is not None:
        rows = rows.filter(keep)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(_SHARE))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(place).alias("first")).collect()  # a row a language
    if not sizes:
        return Model([], [])
    bound, size = max(1, min(bound, TRAINING_TOTAL // len(sizes))), max(1, TRAINING_BYTES // len(sizes))
    limit = {r.lang: max(int(_SHARE * min(1.0, bound / r.n, size / max(r.bytes, 1))), r["first"] + 1) for r in sizes}
    spark = docs.sparkSession
    limits = spark.createDataFrame(list(limit.items()), "lang string, _limit long")
    sample = rows.join(F.broadcast(limits), "lang").filter(place < F.col("_limit")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(name, []).append(t.encode().lower())
            for name, held in texts.items():
                key, n = np.unique(grams(held)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "gram", "n"])

    counted = stored(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    least = _least_counts(counted.groupBy("lang", "n").count().collect(), max(1, most // len(sizes)))
    cuts = spark.createDataFrame(list(least.items()), "lang string, _least long")
    found = counted.join(F.broadcast(cuts), "lang").filter("n >= _least").select("lang", "gram", "n").toArrow() if least else None
    trees = {}
    for name in sorted(least):
        part = found.filter(pc.equal(found["lang"], name))
        trees[name] = Tree.of(part["gram"].to_numpy(), part["n"].to_numpy().astype(float))
    return Model(list(trees), list(trees.values()))


def _least_counts(rows: list, most: int) -> dict[str, int]:
    """Rows (lang, n, count) -> by language the least n with at most ``most`` strings of n or more; the largest n if all are too many."""
    by: dict[str, list[tuple[int, int]]] = {}
    for lang, n, count in rows:
        by.setdefault(lang, []).append((n, count))
    out = {}
    for lang, counts in by.items():
        total, out[lang] = 0, max(counts)[0]
        for n, count in sorted(counts, reverse=True):
            total += count
            if total > most:
                break
            out[lang] = n
    return out


def predicted(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score): a row for each row of docs."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = held.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
