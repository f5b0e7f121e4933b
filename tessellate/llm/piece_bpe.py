"""SentencePiece BPE, encoding and decoding, by vectorised merge rounds.

All distinct words of a batch lie in one flat array of symbols.  A round looks up the
rank of every adjacent pair, takes the smallest rank of each word (a segmented
minimum), merges its occurrences from the left at once, and compacts the array; words
without a pair leave it.  Merging all occurrences at once equals the queue of the
library if no pair that a merge brings up ranks as high as that merge; for the few
pieces where one does, only the leftmost occurrence is merged in a round.

A text is cut where no piece of the vocabulary reaches across, so cutting loses nothing
and the parts repeat: a worker keeps what it knows of them in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches

SPACE = "▁"
MEMO_WORDS, MEMO_CHARS, LONG = 1 << 19, 48, 128
_FOREIGN = 1 << 21  # a character that no piece has: this plus its code point
_NEVER = np.iinfo(np.int32).max
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCodec:
    """A SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = [i for i in range(n) if model.is_byte(i)]
        if len(self.byte_ids) != 256 or any(model.is_unused(i) for i in range(n)) or model.encode("a  b Ａ", out_type=str)[0][0] != SPACE:
            raise ValueError("a BPE model with byte fallback, a leading space and no unused piece is needed")
        self.n = n
        self.ids = {self.pieces[i]: i for i in plain}
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.adjacent = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        scores = np.array([model.get_score(i) for i in range(n)], np.float32)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in plain}, reverse=True))}
        rank = {i: order[scores[i]] for i in plain}
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - set(symbols)):
            symbols[c] = n + len(symbols)
        self.char = np.arange(0x110000, dtype=np.int64) + _FOREIGN
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        pairs, self.leftmost = {}, set()
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
                    self.leftmost |= {rank[x] for x in (a, b) if x in rank and rank[i] <= rank[x]}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([rank[pairs[k]] for k in self.keys.tolist()], np.int32)
        self.alone = np.zeros(len(order), bool)
        self.alone[list(self.leftmost)] = True
        self.bytes = [b"" if model.is_control(i) else "⁇".encode() if model.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for v, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([v])
        self.memo: dict[str, tuple[int, str, bytes]] = {}
        self.passing: list[str] = []

    @cached_property
    def spaces(self) -> tuple[int, int]:
        """(length, id) of the longest piece of spaces, where a long run starts with it again and again; else (0, 0)."""
        size = max((len(p) for p in self.ids if set(p) == {SPACE}), default=0)
        if size < 2:
            return 0, 0
        run = self._rounds([SPACE * (4 * size + 3)])[0]
        return (size, run[0]) if run[:3] == [self.ids[SPACE * size]] * 3 else (0, 0)

    def words(self, text: str) -> list[str]:
        """The text with its leading space, cut where no piece reaches across."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _WORDS.findall(marked) if self.cuts_at_space else [marked]

    def _cut(self, word: str) -> list[str]:
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.adjacent]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        parts, owner, lead = [], [], {}
        for w, word in enumerate(words):
            if len(word) > LONG:
                size, piece = self.spaces
                run = len(word) - len(word.lstrip(SPACE))
                if size and run > 4 * size:
                    blocks = (run - 2 * size) // size
                    lead[w], word = [piece] * blocks, word[blocks * size :]
                cut = self._cut(word)
            else:
                cut = [word]
            parts += cut
            owner += [w] * len(cut)
        out: list[list[int]] = [lead.get(w, []) for w in range(len(words))]
        low = 0
        while low < len(parts):  # so many characters at a time
            high, size = low, 0
            while high < len(parts) and (size < 1 << 19 or high == low):
                size += len(parts[high])
                high += 1
            for w, ids in zip(owner[low:high], self._rounds(parts[low:high])):
                out[w] = out[w] + ids if out[w] else ids
            low = high
        return out

    def _rounds(self, words: list[str]) -> list[list[int]]:
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.char[flat]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done = []
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NEVER)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            rank = np.append(rank, _NEVER)
            least = np.minimum.reduceat(rank, first)
            ended = np.repeat(least == _NEVER, size)
            hit = (rank == np.repeat(least, size)) & ~ended
            # within adjoining occurrences every other one, from the left
            where = np.flatnonzero(hit)
            if not len(where):
                break
            fresh = np.r_[True, np.diff(where) != 1]
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            take = nth % 2 == 0
            single = self.alone[rank[where]]
            if single.any():
                opens = np.r_[True, word[where][1:] != word[where][:-1]]
                take &= ~single | opens
            where = where[take]
            symbol[where] = self.merged[np.searchsorted(self.keys, key[where])]
            keep = ~ended
            keep[where + 1] = False
            if ended.any():
                done.append((word[ended], symbol[ended]))
            symbol, word = symbol[keep], word[keep]
        done.append((word, symbol))
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        ids = symbol[order].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [self._bytes(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def _bytes(self, ids: list[int]) -> list[int]:
        if not ids or max(ids) < self.n:
            return ids
        out: list[int] = []
        for i in ids:
            if i < self.n:
                out.append(i)
            else:
                c = chr(i - _FOREIGN) if i >= _FOREIGN else next(c for c in self._rare if self.char[ord(c)] == i)
                out += [self.byte_ids[b] for b in c.encode()]
        return out

    @cached_property
    def _rare(self) -> list[str]:
        return [c for c in sorted({c for p in self.ids for c in p}) if self.char[ord(c)] >= self.n]

    def known(self, texts: list[list[str]]) -> dict[str, tuple[int, str, bytes]]:
        """word -> (number of ids, decimal ids joined, decoded bytes) for all words of a batch."""
        for w in self.passing:  # long words are known for their own batch only
            self.memo.pop(w, None)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list({w for words in texts for w in words} - self.memo.keys())
        self.passing = [w for w in new if len(w) > MEMO_CHARS]
        for w, ids in zip(new, self.encode_words(new)):
            self.memo[w] = len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids))
        return self.memo

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, as the library gives them; null and empty: none."""
        return [i for ids in self.encode_words(self.words(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined as UTF-8 (broken ones U+FFFD), less the leading space."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        lead = next((i for i in ids if self.bytes[i]), None)
        if lead is not None and self.pieces[lead].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded): a row for each row of docs; null text: no ids, decoded ''."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without carrying the ids through Arrow.

    Null and empty texts: 0 ids and the digests of the empty string. Rows repeat as they do in docs.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.words(t or "") for t in b.column(1).to_pylist()]
            known = c.known(texts)
            count, ids, decoded = [], [], []
            for words in texts:
                found = [known[w] for w in words]
                count.append(sum(x[0] for x in found))
                ids.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x[2] for x in found])[1:]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
