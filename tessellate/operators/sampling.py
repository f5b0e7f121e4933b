"""The seeded draw of pages within each stratum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans import registry

SLOTS = 8


def seed(text: str) -> int:
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    return h or 1


def stepped(x):
    """The generator's next number, of an int or of an array of uint32."""
    x = x ^ (x << 13 & 0xFFFFFFFF if isinstance(x, int) else x << np.uint32(13))
    x = x ^ x >> (17 if isinstance(x, int) else np.uint32(17))
    return x ^ (x << 5 & 0xFFFFFFFF if isinstance(x, int) else x << np.uint32(5))


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A step of many steps: the generator is linear over bits, so it is a matrix (what becomes of each bit) times the bits of x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _jump(steps: int) -> np.ndarray:
    result, power = np.uint32(1) << np.arange(32, dtype=np.uint32), stepped(np.uint32(1) << np.arange(32, dtype=np.uint32))
    while steps:
        if steps & 1:
            result = _times(power, result)
        power, steps = _times(power, power), steps >> 1
    return result


LANES, DEPTH, FEW = 1 << 10, 1 << 10, 1 << 14


def swaps(n: int, x: int) -> Iterator[tuple[int, np.ndarray]]:
    """What the shuffle of n places swaps, last swap first: (i, the partners of i, i + 1, ...) in pieces of at most LANES x DEPTH.

    A shuffle goes from place n - 1 down to 1; the generator is run ahead by jumps, so that its last numbers come first and none is kept.
    """
    chunk, total = LANES * DEPTH, n - 1
    if total <= FEW:
        found = []
        for i in range(total, 0, -1):
            x = stepped(x)
            found.append(x * (i + 1) >> 32)
        yield 1, np.array(found[::-1], np.int64)
        return
    far, starts = _jump(chunk), [np.array([x], np.uint32)]
    for _ in range((total - 1) // chunk):
        starts.append(_times(far, starts[-1]))
    doubling = [_jump(DEPTH << b) for b in range(LANES.bit_length() - 1)]
    for c in range(len(starts) - 1, -1, -1):
        lanes = starts[c]
        for jump in doubling:
            lanes = np.concatenate([lanes, _times(jump, lanes)])
        out = np.empty((DEPTH, LANES), np.uint32)
        for k in range(DEPTH):
            lanes = out[k] = stepped(lanes)
        numbers = out.T.reshape(-1)[: min(chunk, total - c * chunk)].astype(np.uint64)  # of place n - 1 - c chunk, and down
        places = np.arange(n - 1 - c * chunk, n - 1 - c * chunk - len(numbers), -1, dtype=np.uint64)
        yield int(places[-1]), (numbers * (places + np.uint64(1)) >> np.uint64(32)).astype(np.int64)[::-1]


def drawn(n: int, k: int, name: str) -> list[int]:
    """k of n places: those that a shuffle under xorshift32 from the name's hash puts first, in order.

    Nothing is shuffled: the first k places are followed back through the swaps, from the last to the first, so memory
    does not grow with n.
    """
    held = list(range(min(k, n)))
    if n < 2:
        return held
    for first, partners in swaps(n, seed(name)):
        done = 0
        while first + done < k and done < len(partners):  # where both places of a swap may be ones that are followed
            i, j = first + done, int(partners[done])
            held = [j if q == i else i if q == j else q for q in held]
            done += 1
        # From here on place i is none of them yet: one that was swapped with i was there before.
        hits = np.flatnonzero(np.isin(partners[done:], held)) + done
        hits = list(hits)
        while hits:
            at = int(hits.pop(0))
            i, j = first + at, int(partners[at])
            if j not in held or i == j:
                continue
            held[held.index(j)] = i
            more = np.flatnonzero(partners[at + 1 :] == i) + at + 1
            hits = sorted({*hits, *more.tolist()})
    return sorted(held)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages of a host on every run: quotas by section, drawn under a seed of host and section.

    A draw needs a stratum's size and quota only, so places are drawn from one row a stratum; pages
    are then numbered and joined to the places. No stratum's pages meet in a Python task.
    """
    places = drawn_places(registry.run("quota_alloc", spark, sf_dir))
    pool = registry.run("sample_pool", spark, sf_dir)
    return pool.join(places, ["host", "section", "place"]).select("host", "section", "url")


def checks() -> dict[str, str]:
    """The sample as SQL for DuckDB: the shuffle as recursion."""
    from .assembly import draw_sql

    quota, pool = registry.text("quota_alloc", registry.DUCK)[0], registry.text("sample_pool", registry.DUCK)[0]
    return {"stratified_sample": f"SELECT p.host, p.section, p.url FROM ({pool}) p JOIN ({draw_sql(registry.DUCK, f'({quota})')}) d ON p.host = d.host AND p.section = d.section AND p.place = d.place"}


def drawn_places(quota: DataFrame) -> DataFrame:
    """(host, section, place) of quota(host, section, n, quota): the places drawn of each stratum, from 1."""

    def draw(frames):
        for f in frames:
            rows = [(r.host, r.section, p + 1) for r in f.itertuples() for p in drawn(r.n, r.quota, f"{r.host}::{r.section}")]
            yield pd.DataFrame(rows, columns=["host", "section", "place"])

    return quota.filter("quota > 0").select("host", "section", "n", "quota").mapInPandas(draw, "host string, section string, place long")
