"""Re-Pair grammar compression of token ids.

Frequent pairs of neighbouring symbols are replaced by nonterminals, again and again,
until no pair is left that occurs LEAST times in a shard.  A round counts the pairs,
ranks those that are frequent, and replaces every pair that is more frequent than the
two it overlaps with; only places beside a replacement, and frequent pairs that lost to
a neighbour, are looked at in the next one, as no other pair can become frequent.
No rule crosses the end of a document.

A shard is one binary value: the rules, the expansion length of each, how many symbols
each document has, and the symbols.  A document, or any range of its ids, is decoded
from its own symbols alone: expansion lengths say where a place lies.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from .word_bpe import spread

LEAST = 16
_MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIIB")  # magic, documents, symbols, rules, rounds, first nonterminal, bytes a symbol


def _size(symbols: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    rule = symbols >= first
    out = np.ones(len(symbols), np.int64)
    out[rule] = lengths[symbols[rule].astype(np.int64) - first]
    return out


@dataclass
class Shard:
    """Documents of a shard as symbols of its grammar. Symbols below ``first`` are ids; ``first + k`` is rule k."""

    first: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    rounds: np.ndarray  # rules by round: those of one use only ids and rules of rounds before
    symbols: np.ndarray
    ends: np.ndarray  # of each document in symbols

    def to_bytes(self) -> bytes:
        top = self.first + len(self.left)
        width = next(w for w in (1, 2, 3, 4) if top <= 1 << 8 * w)
        pack = lambda a: np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()
        head = _HEAD.pack(_MAGIC, len(self.ends), len(self.symbols), len(self.left), len(self.rounds), self.first, width)
        sizes = np.diff(self.ends, prepend=0).astype("<u4").tobytes()
        return b"".join([head, self.rounds.astype("<u4").tobytes(), pack(self.left), pack(self.right), self.lengths.astype("<u4").tobytes(), sizes, pack(self.symbols)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, docs, symbols, rules, rounds, first, width = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEAD.size

        def plain(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return np.frombuffer(data, "<u4", n, at - 4 * n).astype(np.int64)

        def packed(n: int) -> np.ndarray:
            nonlocal at
            out = np.zeros((n, 4), np.uint8)
            out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
            at += n * width
            return out.view("<u4").reshape(-1)

        by_round, left, right = plain(rounds), packed(rules), packed(rules)
        lengths, sizes = plain(rules), plain(docs)
        return cls(first, left, right, lengths, by_round, packed(symbols), np.cumsum(sizes))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all expansions one after the other, offset and length of each symbol's, ids first).

        The rules of a round stand for disjoint parts of the shard, least times each or more, so they add at most its size / least.
        """
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        offsets = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[: self.first] = np.arange(self.first)
        low = 0
        for n in self.rounds.tolist():
            k = np.arange(low, low + n)
            sides = np.stack([self.left[k], self.right[k]], 1).reshape(-1)
            flat[spread(offsets[self.first + k], self.lengths[k])] = flat[spread(offsets[sides], sizes[sides])]
            low += n
        return flat, offsets, sizes

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        return _size(symbols, self.first, self.lengths)

    def decoded(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each document ends)."""
        flat, offsets, sizes = self.table
        lengths = sizes.take(self.symbols)
        ends = np.concatenate([[0], np.cumsum(lengths)])[self.ends]
        return flat.take(spread(offsets.take(self.symbols), lengths)), ends

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start .. stop - 1 of document k. Only rules of the symbols that hold them are expanded, from the top down."""
        symbols = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        bounds = np.concatenate([[0], np.cumsum(self._sizes(symbols))])
        start, stop = min(max(start, 0), bounds[-1]), bounds[-1] if stop is None else min(stop, bounds[-1])
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, stop, "left")
        out = symbols[low:high]
        while (rule := out >= self.first).any():
            which = out[rule].astype(np.int64) - self.first
            at = np.cumsum(1 + rule) - 1 - rule
            new = np.empty(len(out) + len(which), np.uint32)
            new[at[~rule]] = out[~rule]
            new[at[rule]], new[at[rule] + 1] = self.left[which], self.right[which]
            out = new
        return out[start - bounds[low] : stop - bounds[low]]


def _chosen(place: np.ndarray, after: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places are replaced: those whose pair ranks before the pairs that overlap it. In a run of one symbol, every second one.

    place: where frequent pairs begin, ascending; after: where the right symbol of each begins.
    """
    beside = np.zeros(len(place), bool)  # does the next frequent pair begin with the right symbol of this one?
    beside[:-1] = after[:-1] == place[1:]
    step = np.zeros(len(place), np.int64)
    step[:-1] = np.where(beside[:-1], np.sign(rank[1:] - rank[:-1]), 2)  # 1: this one is better than the next, -1: worse, 0: the same pair
    step[-1:] = 2
    best = step > 0
    best[1:] &= (step[:-1] < 0) | (step[:-1] == 2)
    if (same := step == 0).any():
        run = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
        first = ~np.concatenate([[False], same[:-1]])[run]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        nth = np.arange(len(run)) - begin
        stops = np.append(np.flatnonzero(first)[1:], len(run)) - 1
        which = np.cumsum(first) - 1
        ahead, behind = run[begin], run[stops[which]]
        free = (ahead == 0) | (step[ahead - 1] != 1)  # no better pair holds the run's first symbol
        # A better pair after the run takes the right symbol of its last place.
        open_end = (step[behind] == 1) | (step[behind] == 2)
        last = np.arange(len(run)) == stops[which]
        best[run] = (nth % 2 == np.where(free, 0, 1)) & (~last | open_end)
    return best


def compressed(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> Shard:
    """The grammar of documents given one after the other: their ids (below 2^31), and where each ends."""
    n = len(ids)
    first = int(ids.max()) + 1 if n else 0
    symbols = ids.astype(np.uint32)
    last = np.zeros(n, bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    follow, lead = np.arange(1, n + 1), np.arange(-1, n - 1)  # a place's neighbours
    alive = np.ones(n, bool)
    left, right, rounds, made = [], [], [], 0
    known = np.zeros(0, np.int64)
    place = np.flatnonzero(~last)
    while len(place):
        after = follow.take(place)
        keys = np.empty((len(place), 2), "<u4")
        keys[:, 0], keys[:, 1] = symbols.take(after), symbols.take(place)
        found = pa.array(keys.view("<u8").reshape(-1)).dictionary_encode()
        pairs, which = found.dictionary.to_numpy(), found.indices.to_numpy()
        counts = np.bincount(which)
        twice = np.flatnonzero(keys[:, 0] == keys[:, 1])
        if len(twice):  # a symbol twice: of a run only every second place counts
            apart = np.append(True, after[twice[:-1]] != place[twice[1:]])
            nth = np.arange(len(twice)) - np.maximum.accumulate(np.where(apart, np.arange(len(twice)), 0))
            counts = counts - np.bincount(which[twice[nth % 2 == 1]], minlength=len(counts))
        often = np.flatnonzero(counts >= least)
        order = often[np.lexsort((pairs[often], -counts[often]))]
        if not len(order):
            break
        rank = np.full(len(pairs), -1)
        rank[order] = np.arange(len(order))
        rank = rank.take(which)
        some = np.flatnonzero(rank >= 0)
        place, after, rank = place.take(some), after.take(some), rank.take(some)
        best = _chosen(place, after, rank)
        taken = np.bincount(rank[best], minlength=len(order)) >= least
        use = np.flatnonzero(best & taken.take(rank))
        # The most frequent pair is taken wherever it stands, so every round has a rule.
        at, end, loser = place.take(use), after.take(use), np.delete(place, use)
        new = np.cumsum(taken) - 1
        sides = pairs[order[taken]]
        a, b = (sides >> np.uint64(32)).astype(np.int64), (sides & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left.append(a), right.append(b), rounds.append(len(sides))
        known = np.concatenate([known, _size(a, first, known) + _size(b, first, known)])
        symbols[at] = first + made + new.take(rank.take(use))
        made += len(sides)
        alive[end] = False
        last[at] = last.take(end)
        beyond = follow.take(end)
        follow[at] = beyond
        inside = beyond < n
        lead[beyond[inside]] = at[inside]
        before = lead.take(at)
        before = before[before >= 0]
        if len(at) + len(loser) > n // 16:
            mark = np.zeros(n, bool)
            mark[at], mark[before], mark[loser] = True, True, True
            place = np.flatnonzero(mark & alive & ~last)
        else:
            place = np.unique(np.concatenate([at, before, loser]))
            place = place[alive.take(place) & ~last.take(place)]
    kept = np.flatnonzero(alive)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(alive)])[ends]
    return Shard(first, join(left), join(right), known, np.array(rounds, np.int64), symbols[kept], bounds)
