"""Arithmetic of scores, and hashes."""

from __future__ import annotations

from ..plans.dialect import Dialect


def piecewise(d: Dialect, x: str, points: list[tuple[float, float]]) -> str:
    """Linear between the points, level outside; null stays null."""
    v = f"({d.dbl(x)})"
    cases = [f"WHEN {v} <= {points[0][0]} THEN {d.dbl(points[0][1])}"]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        cases.append(f"WHEN {v} <= {x1} THEN {d.dbl(y0)} + (({v} - {d.dbl(x0)}) / {d.dbl(round(x1 - x0, 6))}) * {d.dbl(round(y1 - y0, 6))}")
    return f"CASE WHEN {v} IS NULL THEN NULL {' '.join(cases)} ELSE {d.dbl(points[-1][1])} END"


def clamp(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


def pct(d: Dialect, n: str, total: str) -> str:
    """Per cent to a tenth, halves up; null for a total of zero."""
    return f"CASE WHEN ({total}) > 0 THEN floor({d.dbl(n)} / {d.dbl(total)} * 1000 + 0.5) / 10 END"


def grade(x: str, bands: list[tuple[str, int]]) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(f'WHEN {x} >= {low} THEN {chr(39)}{name}{chr(39)}' for name, low in bands)} END"


def fnv1a(d: Dialect, x: str) -> str:
    """FNV-1a, 32 bits, over the code points of a text (ASCII); 0 becomes 1."""
    if d.spark:
        h = f"aggregate(transform(filter(split({x}, ''), c -> c <> ''), c -> ascii(c)), CAST(2166136261 AS BIGINT), (h, c) -> ((h ^ c) * 16777619) & 4294967295)"
    else:
        h = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    return f"CASE WHEN {h} = 0 THEN 1 ELSE {h} END"


def xorshift32(d: Dialect, x: str) -> str:
    """One step of the generator, 32 bits."""
    xor = (lambda a, b: f"({a} ^ {b})") if d.spark else (lambda a, b: f"xor({a}, {b})")
    left = lambda a, n: f"({a} * {1 << n} & 4294967295)"
    one = xor(x, left(x, 13))
    two = xor(one, f"{d.idiv(one, 1 << 17)}")
    return xor(two, left(two, 5))
