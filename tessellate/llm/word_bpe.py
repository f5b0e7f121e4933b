"""Ids of a BPE tokenizer with word ends that drops white space: the ids of a text are those of its words.

Most words are plain: Latin letters and ASCII signs.  Their merges are run by a byte-pair library over the
same vocabulary, which looks at what two symbols spell, not at which two they are.  Both
give the same ids if no merge spells what only another pair of symbols may be merged to;
that is so for every entry of the vocabulary that its own merges reach when its symbols
stand alone, so the others are left out (no word's merges reach them either).  All other
words go to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_count import WHITE

#: Texts are encoded in blocks of so many bytes, and their distinct words so many at once.
BLOCK, AT_ONCE = 4 << 20, 4096
_ODD = re.compile("[\x1c-\x1f]")
_WORD = re.compile(f"[^{WHITE}]+")
# Letters that are one code point in NFC and lower case letter by letter; the tokenizer's pattern, and what it is for such letters and ASCII.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END, _MARK = "</w>", "\x01"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def reached(symbols: list[str], rank: dict[tuple[str, str], int]) -> bool:
    """Do the merges leave one symbol of these?"""
    while len(symbols) > 1:
        r, k = min((rank.get(pair, 1 << 30), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
        if r == 1 << 30:
            return False
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]
    return True


class PlainWords:
    """The merges of plain words."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        import tiktoken

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        rank = {p: k for k, p in enumerate(pairs)}
        letters = byte_letters()
        entries = {}
        for text, number in vocabulary.items():
            core = text.removesuffix(_END)
            if not core or any(c not in letters for c in core):
                continue
            symbols = [*core[:-1], core[-1] + text[len(core) :]]
            if reached(symbols, rank):
                entries[bytes(letters[c] for c in core) + _MARK.encode() * (len(core) < len(text))] = number
        order = [entries[k] for k in sorted(entries, key=lambda k: (len(k) > 1, entries[k]))]
        if len(set(order)) != len(order) or any(bytes([b]) not in entries for b in range(256)) or any(vocabulary.get(a + b, -1) < vocabulary.get(x + y, -1) for (a, b), (x, y) in zip(pairs[1:], pairs)):
            raise ValueError("a byte-level vocabulary in the order of its merges is needed")
        self.library = tiktoken.Encoding("words", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=entries, special_tokens={})
        self.ends = np.zeros(max(order) + 1, bool)
        self.ends[[n for k, n in entries.items() if len(k) > 1 and k.endswith(_MARK.encode())]] = True

    def encoded(self, words: list[str]) -> list[bytes]:
        parts, last = [], []
        for w in _MARK.join(words).lower().split(_MARK):
            if w.isalpha():
                parts.append(w)
            else:
                parts += _PARTS.findall(w)
            last.append(len(parts) - 1)
        ids = np.array(self.library.encode_ordinary(_MARK.join(parts) + _MARK), "<u4")
        at, raw = (4 * np.flatnonzero(self.ends[ids])[last] + 4).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *at], at)]


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation(), self.model.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        bpe, steps = said["model"], said["pre_tokenizer"]["pretokenizers"]
        known = bpe["type"] == "BPE" and bpe.get("end_of_word_suffix") == _END and not bpe.get("continuing_subword_prefix") and steps[0].get("pattern", {}).get("Regex") == _PATTERN and [n["type"] for n in said["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.plain = PlainWords(bpe["vocab"], bpe["merges"]) if known else None

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORD.findall(text) if _ODD.search(text) else text.split()

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        plain = [w for w in words if _PLAIN.fullmatch(w) and "<|" not in w] if self.plain else []
        known = dict(zip(plain, self.plain.encoded(plain))) if plain else {}
        rest = [w for w in words if w not in known]
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False)))
        return [known[w] for w in words]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def spread(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices offsets[0] .. offsets[0] + lengths[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(offsets - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def encoded(w: WordIds, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts, each with the id ``end`` after it; where each ends). Distinct words are encoded once, and nothing is kept for other blocks."""
    odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
    if pc.any(odd).as_py():  # no white space for the tokenizer, but for Arrow
        words = pa.array([w.words(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        words = pc.utf8_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known = [ids for low in range(0, len(distinct), AT_ONCE) for ids in w.encoded(distinct[low : low + AT_ONCE])]
    flat = np.concatenate([np.frombuffer(b"".join(known), "<u4"), np.array([end], "<u4")])
    sizes = np.append(np.fromiter(map(len, known), np.int64, len(known)) // 4, 1)
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    which = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], len(known))
    lengths = sizes.take(which)
    ends = np.concatenate([[0], np.cumsum(lengths)])[bounds[1:] + np.arange(1, len(bounds))]
    return flat.take(spread((np.cumsum(sizes) - sizes).take(which), lengths)), ends


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have BLOCK bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
