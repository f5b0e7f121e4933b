"""Relational text for two engines: Spark SQL, which runs the plans, and DuckDB, which checks them.

A plan is written once over these few differences, so that a rule or a band table exists once.
"""

from __future__ import annotations


class Dialect:
    spark = False

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def strings(self, values) -> str:
        return ", ".join(self.lit(v) for v in values)

    def rx(self, x: str, pattern: str) -> str:
        """Does the pattern (without quotes; \\z is the end) occur in x?"""
        return f"regexp_matches({x}, {self.pattern(pattern)})"

    def pattern(self, p: str) -> str:
        return self.lit(p)

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        """The group's first match, '' without one."""
        return f"regexp_extract({x}, {self.pattern(pattern)}, {group})"

    def exta(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.pattern(pattern)}, {group})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.lit(by)}, 'g')"

    def group(self, n: int) -> str:
        return f"\\{n}"

    def trim(self, x: str) -> str:
        return self.sub(self.sub(x, r"^\s+"), r"\s+\z")

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, {self.lit(by)})"

    def filt(self, a: str, v: str, cond: str) -> str:
        return f"list_filter({a}, lambda {v}: {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS INTEGER)"

    def at(self, a: str, i: int | str) -> str:
        return f"list_extract({a}, {i})"

    def join(self, a: str, by: str) -> str:
        return f"array_to_string({a}, {self.lit(by)})"

    def slice(self, a: str, start: int, n: int | str) -> str:
        return f"list_slice({a}, {start}, {start} + {n} - 1)"

    def last(self, a: str, n: int) -> str:
        return f"list_slice({a}, -{n}, -1)"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def distinct_sorted(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def distinct(self, a: str) -> str:
        """The elements of an array, each where it stands first."""
        return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"

    def append(self, a: str, x: str) -> str:
        return f"list_append({a}, {x})"

    def fold(self, a: str, step) -> str:
        """An array of texts folded into another one, from the left: step(kept, x) is the new one."""
        return f"list_reduce(list_transform({a}, lambda x: [x]), lambda kept, x: {step('kept', 'x[1]')}, CAST([] AS VARCHAR[]))"

    def hexdigits(self, x: str) -> str:
        return f"lower(to_hex({x}))"

    def pos(self, x: str, part: str) -> str:
        """Where a part stands in x, from 1; 0 without it."""
        return f"strpos({x}, {part})"

    def percent_decoded(self, x: str) -> str:
        return f"url_decode({x})"

    def hexed(self, x: str) -> str:
        """The number that hexadecimal digits are."""
        return f"CAST(concat('0x', {x}) AS BIGINT)"

    def explode(self, columns: str, source: str, array: str, value: str, at: str = "idx") -> str:
        """columns, value and its place from 0, of the array's elements."""
        return f"SELECT {columns}, unnest({array}) AS {value}, CAST(unnest(range(0, len({array}))) AS INTEGER) AS {at} FROM {source}"

    def lists(self, value: str, order: str) -> str:
        """An aggregate: values in the order given."""
        return f"list({value} ORDER BY {order})"

    def idiv(self, a: str, b: int | str) -> str:
        return f"(({a}) // ({b}))"

    def seq(self, a: str, b: str) -> str:
        return f"range({a}, ({b}) + 1)"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%d')"

    def month(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m')"

    def seconds(self, ts: str) -> str:
        return f"CAST(floor(epoch({ts})) AS BIGINT)"

    def big(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def dbl(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def chars(self, x: str) -> str:
        return f"CAST(length({x}) AS INTEGER)"

    def r1(self, x: str) -> str:
        """Rounded to a tenth, halves up."""
        return f"(floor(({x}) * 10 + 0.5) / 10)"

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, {prefix})"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {part})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def number(self, x: str) -> str:
        """A number of 60 bits made from a text."""
        return f"CAST(concat('0x', substring(md5({x}), 1, 15)) AS BIGINT)"

    def at_head(self) -> str:
        """Where the head of a page opens: the place of the last character of <head>."""
        return "(strpos(html, '<head>') + 5)"

    def count_if(self, cond: str) -> str:
        return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


class SparkDialect(Dialect):
    spark = True

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pattern(self, p: str) -> str:
        return self.lit(p)

    def rx(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.pattern(pattern)})"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {self.lit(by)})"

    def group(self, n: int) -> str:
        return f"${n}"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.lit(''.join(chr(92) + c if c in '.|*+?()[]{}^$' + chr(92) else c for c in by))}, -1)"

    def filt(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def at(self, a: str, i: int | str) -> str:
        return f"try_element_at({a}, {i})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {self.lit(by)})"

    def slice(self, a: str, start: int, n: int | str) -> str:
        return f"slice({a}, {start}, {n})"

    def last(self, a: str, n: int) -> str:
        return f"slice({a}, greatest(size({a}) - {n - 1}, 1), {n})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def sorted(self, a: str) -> str:
        return f"sort_array({a})"

    def distinct_sorted(self, a: str) -> str:
        return f"sort_array(array_distinct({a}))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def append(self, a: str, x: str) -> str:
        return f"array_append({a}, {x})"

    def fold(self, a: str, step) -> str:
        return f"aggregate({a}, CAST(array() AS ARRAY<STRING>), (kept, x) -> {step('kept', 'x')})"

    def hexdigits(self, x: str) -> str:
        return f"lower(hex({x}))"

    def pos(self, x: str, part: str) -> str:
        return f"instr({x}, {part})"

    def percent_decoded(self, x: str) -> str:
        return f"url_decode(replace({x}, '+', '%2B'))"

    def hexed(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def explode(self, columns: str, source: str, array: str, value: str, at: str = "idx") -> str:
        return f"SELECT {columns}, {value}, {at} FROM {source} LATERAL VIEW posexplode({array}) _e AS {at}, {value}"

    def lists(self, value: str, order: str) -> str:
        return f"transform(sort_array(collect_list(struct({order} AS o, {value} AS v))), _s -> _s.v)"

    def idiv(self, a: str, b: int | str) -> str:
        return f"(({a}) div ({b}))"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def month(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')"

    def seconds(self, ts: str) -> str:
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))"

    def chars(self, x: str) -> str:
        return f"length({x})"

    def r1(self, x: str) -> str:
        return f"(floor(CAST(({x}) AS DOUBLE) * 10 + 0.5) / 10)"

    def starts(self, x: str, prefix: str) -> str:
        return f"startswith({x}, {prefix})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def number(self, x: str) -> str:
        return f"CAST(conv(substring(md5({x}), 1, 15), 16, 10) AS BIGINT)"

    def at_head(self) -> str:
        return "(instr(html, '<head>') + 5)"

    def count_if(self, cond: str) -> str:
        return f"count_if({cond})"


SPARK, DUCK = SparkDialect(), Dialect()
