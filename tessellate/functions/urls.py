"""Expressions over URLs, hosts and paths."""

from __future__ import annotations

from ..plans.dialect import Dialect
from . import fixed

LOCALE = r"(?i)^/([a-z]{2})(?:[-_]([a-z0-9]{2,3}))?(?:/|\z)"


def host(d: Dialect, url: str) -> str:
    return f"lower({d.ext(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)')})"


def path(d: Dialect, url: str) -> str:
    return f"greatest({d.ext(url, r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)')}, '/')"  # '' or something after a slash


def without_dots(d: Dialect, p: str) -> str:
    """A path without its segments . and .. (RFC 3986, 5.2.4); a leading slash stays."""
    rest = d.sub(p, "^/")
    parts = d.split(rest, "/")
    up = lambda kept: d.slice(kept, 1, f"greatest({d.size(kept)} - 1, 0)")
    folded = d.join(d.fold(parts, lambda kept, x: f"CASE WHEN {x} = '.' THEN {kept} WHEN {x} = '..' THEN {up(kept)} ELSE {d.append(kept, x)} END"), "/")
    end = f"CASE WHEN {d.rx(rest, r'(^|/)[.][.]?\z')} AND {folded} <> '' THEN '/' ELSE '' END"
    return f"concat(CASE WHEN {d.rx(p, '^/')} THEN '/' ELSE '' END, {folded}, {end})"


def resolved(d: Dialect, base: str, href: str) -> str:
    """The address that a reference on a page names (RFC 3986, 5.2): relative, with .. or without, a query or a fragment alone, without a scheme. A web address without a path gets /."""
    scheme, mine = d.ext(href, "^([A-Za-z][A-Za-z0-9+.-]*):"), d.ext(base, "^([A-Za-z][A-Za-z0-9+.-]*):")
    rest, own = d.sub(href, "^[A-Za-z][A-Za-z0-9+.-]*:"), d.sub(base, "^[A-Za-z][A-Za-z0-9+.-]*:")
    host_part = "^(//[^/?#]*)"
    authority, at = d.ext(rest, host_part), d.ext(own, host_part)
    path_of = lambda x: d.ext(x, r"^(?://[^/?#]*)?([^?#]*)")
    p, b = path_of(rest), path_of(own)
    query_, fragment = d.ext(rest, r"^[^?#]*(\?[^#]*)"), d.ext(rest, "(#.*)$")
    merged = f"CASE WHEN {at} <> '' AND {b} = '' THEN concat('/', {p}) ELSE concat({d.ext(b, '^(.*/)')}, {p}) END"
    full = (
        f"CASE WHEN {scheme} <> '' THEN concat({scheme}, ':', {authority}, CASE WHEN {authority} <> '' OR {d.rx(p, '^/')} THEN {without_dots(d, p)} ELSE {p} END, {query_}, {fragment}) "
        f"WHEN {authority} <> '' THEN concat({mine}, ':', {authority}, {without_dots(d, p)}, {query_}, {fragment}) "
        f"WHEN {p} = '' THEN concat({mine}, ':', {at}, {b}, CASE WHEN {query_} <> '' THEN {query_} ELSE {d.ext(own, r'^[^?#]*(\?[^#]*)')} END, {fragment}) "
        f"WHEN {d.rx(p, '^/')} THEN concat({mine}, ':', {at}, {without_dots(d, p)}, {query_}, {fragment}) ELSE concat({mine}, ':', {at}, {without_dots(d, merged)}, {query_}, {fragment}) END"
    )
    rooted = d.sub(full, r"(?i)^(https?://[^/?#]+)([?#].*)?\z", f"{d.group(1)}/{d.group(2)}")
    plain = f"{d.rx(href, '(?i)^https?://[^/?#]+/')} AND NOT {d.rx(href, r'/[.][.]?(/|[?#]|\z)')}"  # most links
    return f"CASE WHEN {plain} THEN {href} ELSE {rooted} END"


def with_ipv6_words(d: Dialect, source: str, columns: str, x: str) -> str:
    """source with w1 to w4: the IPv6 address x as four words of 32 bits, high first; null where it is none. :: stands for the zeros that are missing, a dotted end for two groups."""
    octet = lambda k: f"CAST(nullif({d.ext('four', r'^([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)$', k)}, '') AS BIGINT)"
    pair = lambda a, b: d.hexdigits(f"{octet(a)} * 256 + {octet(b)}")
    dotted = r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+\z"
    flat = f"CASE WHEN four = '' THEN six ELSE concat({d.sub('six', dotted)}, {pair(1, 2)}, ':', {pair(3, 4)}) END"
    groups = lambda part: d.filt(d.split(part, ":"), "g", "g <> ''")
    tail = groups(f"CASE WHEN {d.contains('flat', d.lit('::'))} THEN {d.sub('flat', '^.*?::')} ELSE '' END")
    n = f"({d.size('head')} + {d.size('tail')})"
    valid = (
        f"{d.rx('six', r'^[0-9a-f:]*:[0-9a-f:]*([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)?\z')} AND NOT {d.rx('six', ':::|::.*::|^:[^:]|[^:]:$')} AND NOT {d.rx('flat', '[0-9a-f]{5}')} "
        f"AND CASE WHEN {d.contains('flat', d.lit('::'))} THEN {n} <= 7 ELSE {n} = 8 END AND (four = '' OR greatest({', '.join(octet(k) for k in range(1, 5))}) <= 255)"
    )
    at = lambda i: f"CASE WHEN {i} <= {d.size('head')} THEN {d.hexed(d.at('head', i))} WHEN {i} > 8 - {d.size('tail')} THEN {d.hexed(d.at('tail', f'greatest({i} - 8 + {d.size('tail')}, 1)'))} ELSE 0 END"
    words = ", ".join(f"CASE WHEN valid THEN ({at(2 * k + 1)}) * 65536 + ({at(2 * k + 2)}) END AS w{k + 1}" for k in range(4))
    return f"""
SELECT {columns}, {words} FROM (SELECT *, {valid} AS valid FROM (SELECT *, {groups(d.sub('flat', '::.*'))} AS head, {tail} AS tail FROM (
  SELECT *, {flat} AS flat FROM (SELECT *, {d.ext('six', f'({dotted})')} AS four FROM (SELECT *, lower({x}) AS six FROM {source})))))"""


def ipv6_blocked(d: Dialect, w: tuple[str, ...] = ("w1", "w2", "w3", "w4")) -> str:
    """Are the four words of an address unspecified, loopback, link-local, unique-local, multicast, for documentation, or those of an IPv4 address that is kept out? What is no address is."""
    a, b, c, e = w
    octets = [f"({d.idiv(e, 1 << s)}) % 256" for s in (24, 16, 8, 0)]
    inner = ipv4_octets_blocked(*octets)
    return (
        f"CASE WHEN {a} IS NULL THEN true WHEN {a} = 0 AND {b} = 0 AND {c} = 0 AND {e} IN (0, 1) THEN true WHEN {a} = 0 AND {b} = 0 AND {c} IN (0, 65535) THEN {inner} "
        f"WHEN {d.idiv(a, 1 << 22)} = {0xFE80 >> 6} THEN true WHEN {d.idiv(a, 1 << 25)} = {0xFC >> 1} THEN true WHEN {d.idiv(a, 1 << 24)} = {0xFF} THEN true WHEN {a} = {0x20010DB8} THEN true ELSE false END"
    )


def normalized_domain(d: Dialect, x: str) -> str:
    """The host of what a visitor typed, or null: numbers, empty labels and reserved names are no domains."""
    s = d.trim(x)
    full = f"CASE WHEN {d.rx(s, '(?i)^https?://')} THEN {s} ELSE concat('https://', {s}) END"
    h = d.sub(host(d, full), r"\.+\z")
    return (
        f"CASE WHEN {d.rx(s, r'^[0-9]+\z')} OR {h} = '' OR {d.rx(h, r'[^a-z0-9.-]')} OR {d.rx(h, r'^\.|\.\.')} OR {d.rx(h, r'\.(test|example|invalid|localhost)\z')} THEN NULL ELSE {h} END"
    )


def cache_key(d: Dialect, x: str) -> str:
    return d.sub(d.sub(d.sub(f"lower({x})", r"\.+\z"), r"^www[0-9]?\."), "[^a-z0-9.-]", "_")


def registrable_domain(d: Dialect, x: str) -> str:
    """The label under the public suffix, with it; null for addresses and single labels."""
    s = d.trim(x)
    full = f"CASE WHEN {d.rx(s, '(?i)^[a-z][a-z0-9+.-]*://')} THEN {s} ELSE concat('https://', {s}) END"
    h = d.sub(host(d, full), r"\.\z")
    bare = d.sub(h, r"^www[0-9]?\.")
    two = d.ext(bare, r"([^.]+\.[^.]+)\z")
    three = d.ext(bare, r"([^.]+\.[^.]+\.[^.]+)\z")
    return (
        f"CASE WHEN {h} = '' OR NOT {d.contains(h, d.lit('.'))} OR {d.rx(h, r'^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+\z')} THEN NULL "
        f"WHEN {two} IN ({d.strings(fixed.TWO_LABEL_SUFFIXES)}) AND {three} <> '' THEN {three} WHEN {two} = '' THEN {bare} ELSE {two} END"
    )


def ipv4_blocked(d: Dialect, x: str) -> str:
    """Is a dotted address private, local, reserved or for documentation? What is no address is blocked, too."""
    octet = [f"CAST(nullif({d.ext(x, r'^([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)\z', k)}, '') AS BIGINT)" for k in (1, 2, 3, 4)]
    return f"coalesce(CASE WHEN NOT {d.rx(x, r'^[0-9]{1,3}([.][0-9]{1,3}){3}\z')} THEN true WHEN greatest({', '.join(octet)}) > 255 THEN true ELSE {ipv4_octets_blocked(*octet)} END, true)"


def ipv4_octets_blocked(a: str, b: str, c: str, _: str) -> str:
    return (
        f"CASE WHEN {a} IN (0, 10, 127) OR {a} >= 224 THEN true WHEN {a} = 100 AND {b} BETWEEN 64 AND 127 THEN true WHEN {a} = 169 AND {b} = 254 THEN true "
        f"WHEN {a} = 172 AND {b} BETWEEN 16 AND 31 THEN true WHEN {a} = 192 AND {b} = 168 THEN true WHEN {a} = 192 AND {b} = 0 AND {c} IN (0, 2) THEN true "
        f"WHEN {a} = 198 AND ({b} IN (18, 19) OR {b} = 51 AND {c} = 100) THEN true WHEN {a} = 203 AND {b} = 0 AND {c} = 113 THEN true ELSE false END"
    )


def host_check(d: Dialect, h: str, bare: str, four: str) -> str:
    """Why a host is not looked up, null if it is. Columns: the cleaned host, it without brackets, and the dotted address it ends with."""
    v4, v6 = d.rx(bare, r"^[0-9]{1,3}([.][0-9]{1,3}){3}\z"), d.rx(bare, r"^[0-9a-f:.]*:[0-9a-f:.]*\z")
    inner = f"({four} = '' OR {ipv4_blocked(d, four)})"
    blocked = (
        f"CASE WHEN NOT {v6} THEN {inner} WHEN {bare} IN ('::', '::1') THEN true WHEN {d.rx(bare, '^::ffff:')} THEN {inner} "
        f"WHEN {d.rx(bare, '^(fe[89ab]|f[cd]|ff|2001:db8)')} THEN true WHEN {d.rx(bare, '^::')} AND {four} <> '' THEN {inner} ELSE false END"
    )
    return (
        f"CASE WHEN {h} = '' THEN 'empty' WHEN length({h}) > 253 THEN 'too long' WHEN ({v4} OR {v6}) AND ({blocked}) THEN 'reserved address' WHEN {v4} OR {v6} THEN 'raw address' "
        f"WHEN {d.rx(h, r'^(0x[0-9a-f]+|[0-9]+)\z')} THEN 'numeric address' WHEN {d.rx(h, r'(^|\.)localhost\z')} THEN 'localhost' "
        f"WHEN {d.rx(h, r'\.(local|internal|lan|home\.arpa)\z')} THEN 'internal name' WHEN NOT {d.contains(h, d.lit('.'))} THEN 'no public name' END"
    )


def cleaned_host(d: Dialect, x: str) -> str:
    return d.sub(f"lower({d.trim(x)})", r"\.\z")


def without_brackets(d: Dialect, x: str) -> str:
    return d.sub(x, r"^\[|\]\z")


def dotted_end(d: Dialect, x: str) -> str:
    return d.ext(x, r"([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)\z")


def bare_path(d: Dialect, p: str) -> str:
    """A path without index page and suffix."""
    s = d.sub(d.sub(p, r"(?i)/index\.html?\z", "/"), r"(?i)\.html?\z")
    return f"CASE WHEN {s} = '' THEN '/' ELSE {s} END"


def unwrapped(d: Dialect, p: str) -> str:
    """What follows a wrapping first segment; null without one."""
    rest = d.sub(p, r"(?i)^/(corp|content|global)(/|\z)", d.group(2))
    return f"CASE WHEN {d.rx(p, r'(?i)^/(corp|content|global)(/|\z)')} THEN CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


def locale_lang(d: Dialect, p: str) -> str:
    return f"lower({d.ext(p, LOCALE, 1)})"


def locale_region(d: Dialect, p: str) -> str:
    return f"lower({d.ext(p, LOCALE, 2)})"


def locale_of(d: Dialect, lang: str, region: str, promoted: str) -> str:
    """The locale of a path's opening parts, null if they are none. promoted: the look-alike languages that the host's evidence lets through."""
    return (
        f"CASE WHEN coalesce({lang}, '') = '' THEN NULL WHEN NOT ({lang} IN ({d.strings(fixed.LANGUAGES)}) OR ({region} <> '' AND {region} = {lang})) THEN NULL "
        f"WHEN {region} = '' AND {lang} IN ({d.strings(fixed.LOOKALIKES)}) AND NOT coalesce({d.has(promoted, lang)}, false) THEN NULL "
        f"WHEN {region} = '' THEN {lang} ELSE concat({lang}, '-', {region}) END"
    )


def after_locale(d: Dialect, p: str) -> str:
    rest = d.sub(p, r"(?i)^/[a-z]{2}(?:[-_][a-z0-9]{2,3})?(/|\z)", d.group(1))
    return f"CASE WHEN {rest} = '' THEN '/' ELSE {rest} END"


def is_cruft(d: Dialect, p: str) -> str:
    words = d.filt(d.split(d.sub(f"lower({p})", r"[-_.]", "/"), "/"), "w", f"w IN ({d.strings(fixed.LOREM)})")
    return f"({d.rx(p, fixed.CRUFT)} OR {d.size(words)} >= 2)"


def rules() -> list[tuple[str, list[str]]]:
    """Sections in the order in which they are tried, with their patterns."""
    return [("blog", [fixed.DATED_POST]), ("author_tag_taxonomy", [fixed.DATED_ARCHIVE]), *fixed.SECTIONS, *fixed.FOREIGN_SECTIONS, *fixed.CATALOG_SECTIONS]


def spelled(pattern: str) -> list[str] | None:
    """All that a pattern of letters, groups of alternatives and optional parts can spell; None for any other pattern."""

    def alternatives(at: int) -> tuple[list[str], int]:
        found, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                found, now, at = found + now, [""], at + 1
                continue
            if c == "(":
                part, at = alternatives(at + 1)
            elif c.isalnum() or c in "-/":
                part = [c]
            else:
                raise ValueError(c)
            at += 1
            if at < len(pattern) and pattern[at] == "?":
                part, at = [*part, ""], at + 1
            now = [x + y for x in now for y in part]
        return found + now, at

    try:
        return alternatives(0)[0]
    except ValueError:
        return None


def first_words() -> tuple[dict[str, int], list[tuple[int, str]]]:
    """The rules as first segments of a path with the place of the first rule that has them, and the patterns that look at more than a first segment."""
    words: dict[str, int] = {}
    others: list[tuple[int, str]] = []
    for place, (_, patterns) in enumerate(rules()):
        for p in patterns:
            found = spelled(p[2:-6]) if p.startswith("^/") and p.endswith(r"(/|\z)") else None
            if found is None or any("/" in w for w in found):
                others.append((place, p))
            else:
                for w in found:
                    words.setdefault(w, place)
    return words, others


def section(d: Dialect, p: str) -> str:
    """The section of a path: the first rule that matches.

    Spark looks the first segment up, and tries the few other patterns only where one of them matches at all.
    DuckDB's form tries all rules in their order.
    """
    if not d.spark:
        cases = " ".join(f"WHEN {d.rx(p, '|'.join(f'(?:{x})' for x in patterns))} THEN {d.lit(name)}" for name, patterns in rules())
        return f"CASE WHEN {is_cruft(d, p)} THEN 'cms_cruft' {cases} ELSE 'unclassified' END"
    words, others = first_words()
    names = [name for name, _ in rules()] + ["unclassified"]
    last = len(names) - 1
    known = f"coalesce(try_element_at(map({', '.join(f'{d.lit(w)}, {k}' for w, k in words.items())}), substring_index(substring({p}, 2), '/', 1)), {last})"
    each = ", ".join(f"CASE WHEN {d.rx(p, x)} THEN {k} ELSE {last} END" for k, x in others)
    place = f"CASE WHEN {d.rx(p, '|'.join(f'(?:{x})' for _, x in others))} THEN least({known}, {each}) ELSE {known} END"
    lorem = f"lower({p}) RLIKE {d.lit('|'.join(fixed.LOREM))}"
    return f"CASE WHEN {d.rx(p, fixed.CRUFT)} OR ({lorem} AND {is_cruft(d, p)}) THEN 'cms_cruft' ELSE element_at({d.array(*map(d.lit, names))}, 1 + {place}) END"


def shareable(d: Dialect, s: str) -> str:
    return f"{s} IN ({d.strings(fixed.SHAREABLE)})"


def segments(d: Dialect, p: str) -> str:
    return d.filt(d.split(p, "/"), "s", "s <> ''")
