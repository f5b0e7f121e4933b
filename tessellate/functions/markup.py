"""Expressions over HTML text: tags, attributes, entities, visible text."""

from __future__ import annotations

from ..plans.dialect import Dialect
from . import urls


def attribute(d: Dialect, tag: str, name: str, dots: bool = True) -> str:
    """The last value of an attribute of a tag, quoted or bare; '' without one. dots: may attribute names hold dots?"""
    before = r"[^a-zA-Z:_.-]" if dots else r"[^a-zA-Z:_-]"
    p = rf"(?is)^.*{before}{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"
    return f"concat({d.ext(tag, p, 1)}, {d.ext(tag, p, 2)}, {d.ext(tag, p, 3)})"


def decoded(d: Dialect, x: str) -> str:
    e = x
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        e = f"replace({e}, {d.lit(a)}, {d.lit(b)})"
    e = f"replace({d.sub(e, '&#0?39;|&apos;', chr(39))}, '&nbsp;', ' ')"
    return d.trim(e)


def spaced(d: Dialect, x: str) -> str:
    return d.sub(x, r"\s+", " ")


def visible(d: Dialect, html: str) -> str:
    """Text without scripts, styles and tags, white space collapsed."""
    bare = d.sub(d.sub(html, r"(?is)<script.*?</script>"), r"(?is)<style.*?</style>")
    return d.trim(spaced(d, d.sub(bare, "<[^>]+>", " ")))


def text_of(d: Dialect, x: str) -> str:
    """Inner markup as a line of text."""
    return spaced(d, decoded(d, d.sub(x, "<[^>]+>", " ")))


def image_class(d: Dialect, u: str) -> str:
    """Of a preview image's address: broken, placeholder, relative, ok; null without one."""
    return (
        f"CASE WHEN coalesce({u}, '') = '' THEN NULL WHEN {d.rx(u, r'(?i)/(undefined|null)([?#]|\z)')} THEN 'broken' "
        f"WHEN {d.rx(u, r'(?i)placeholder[^/]*\.(png|jpe?g|webp|gif|svg)')} THEN 'placeholder' WHEN NOT {d.rx(u, '(?i)^https?://')} THEN 'relative' ELSE 'ok' END"
    )


def absolute(d: Dialect, href: str, base: str) -> str:
    """href against the page it stands on."""
    return urls.resolved(d, base, href)
