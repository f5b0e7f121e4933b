"""Main text of pages by site style trees.

The pages of a host are merged into one tree.  An element node is the chain of elements
from the root, each with its classes, id and role; on every page it has a style (the
sequence of its children) and contents (the texts directly in it).  Over the m pages that
hold a node, values that df_1, df_2, ... pages share have the importance

    1 - sum(df_i log df_i) / (sum(df_i) log m),

which is the entropy in base m if every page has one value: 1 where all pages differ, 0
where all are alike.  Of a node's styles this is its presentation importance, of its
contents, less what lies in links, its content importance.  A presentation counts with
weight 1 - GAMMA^styles, so one style alone says little.  The composite importance of a
branch is the average over its nodes, damped by GAMMA a level and weighted by pages.

What is removed is the branch, at the highest node that qualifies:

* a branch whose composite importance, and that of all nodes in it, is below LEAST;
* in an ``article`` or ``main``, a branch below LEAST_MAIN, if the rest of it varies from
  page to page (a host with copies of one article keeps it);
* an ``article`` or ``main`` that does not vary, where text outside it does.

Element names and class words are a prior, for branches that entropy cannot tell (an
advert that differs on every page, comments): branches of PLAIN_LOW or MARKED_LOW go
unless the host has hardly any text elsewhere, and then those that vary stay.

The tree is an aggregate: values are counted by (host, node, value) before any host's
rows meet, so a host with a third of all pages is no hot key.  What goes back to a page is
its host's list of removed nodes, each seen on LEAST_PAGES pages or more, by a join that
Spark may broadcast by size.  Of low prior, a host that keeps such branches lists those that
do not vary; one that is seen less often counts as varying.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, stored

# Fixed values of HTML: elements without content, elements whose content is no markup, elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object select".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# The prior: elements, and parts of a class, id or role, that seldom hold a page's own text. Parts after a layout word describe the page, not the element.
PLAIN_LOW = frozenset("nav footer aside form dialog menu button fieldset head".split())
MARKED_LOW = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments reply replies discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager copyright disclaimer complementary contentinfo".split()
)
LAYOUT = frozenset("has have with without no is layout page template single one two three".split())
MAIN = frozenset("article main".split())
#: GAMMA damps a level. An element tells its DEPTH nearest ancestors what it holds; to those further away that would count under 1 %.
GAMMA, DEPTH = 0.9, 48
LEAST, LEAST_MAIN, VARIES, LEAST_PAGES, ELSEWHERE = 0.3, 0.1, 0.5, 3, 0.1

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_SEPARATED = frozenset("p li dt dd tr td th option".split())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 0) - (1 << 63)


@dataclass(slots=True)
class Node:
    """An element node of a site: what its chain of elements tells."""

    name: str
    path: str
    id: int
    chain: tuple[int, ...]  # the nearest elements around this node, and itself
    main: int | None  # the outermost article or main around it
    low: bool  # of low prior, by itself or by what is around it
    cut: bool


class Element:
    """A node as it stands on a page."""

    __slots__ = ("node", "children", "name")

    def __init__(self, name: str, node: Node):
        self.name, self.node, self.children = name, node, []


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries, and how many of its characters are in links."""

    node: Node
    text: str
    linked: int


class Reader:
    """Reads pages of one host. Nodes are made once, with what is known to be removed there. turned: does a branch of low prior stay, unless it is one of ``alike``?"""

    def __init__(self, cut: frozenset[int] = frozenset(), turned: bool = False, alike: frozenset[int] = frozenset()):
        self.cut, self.turned, self.alike = cut, turned, alike
        self.root = Node("", "", 0, (), None, False, False)
        self.nodes: dict[tuple[int, str], Node] = {}

    def _node(self, parent: Node, name: str, attrs: str) -> Node:
        key = parent.id, f"{name} {attrs}"
        found = self.nodes.get(key)
        if found is not None:
            return found
        values = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
        tokens = [_PART.findall(x) for k in ("class", "id", "role") for x in values.get(k, "").lower().split()]
        hidden, role = bool(attrs and _HIDDEN.search(attrs)), values.get("role") == "main"
        label = f"/{name}" + "".join(f".{x}" for x in sorted({p for t in tokens for p in t})) + "!" * hidden + "@" * role
        deep = len(parent.chain) >= DEPTH  # a path is written out to DEPTH; below, a hash stands for what is between
        path = f"{parent.path.split('/~')[0]}/~{parent.id & 0xFFFFFFFF:x}{label}" if deep else parent.path + label
        number = _hash(f"{parent.id}{label}" if deep else path)
        marked = name not in ("html", "body") and any(p in MARKED_LOW for t in tokens if t and t[0] not in LAYOUT for p in t)
        low = parent.low and not (name == "main" or role) or name in PLAIN_LOW or (name == "header" and parent.main is None) or marked or hidden
        main = number if parent.main is None and (name in MAIN or role) else parent.main
        gone = number in self.cut or hidden or low and (not self.turned or number in self.alike)
        if not (name == "main" or role):  # no notice or menu holds the main part
            gone = gone or parent.cut
        found = Node(name, path, number, (*parent.chain[1 - DEPTH :], number), main, low, gone)
        if len(self.nodes) < 1 << 16:
            self.nodes[key] = found
        return found

    def read(self, page: str | None) -> tuple[list[Element], list[Block]]:
        """The elements of a page, and its blocks in their order: white space collapsed, character references decoded. Null and empty: none."""
        page = page or ""
        top = Element("", self.root)
        stack, elements, out, run = [top], [top], [], []
        link, linked, at = 0, 0, 0

        def close_block() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            if text:
                stack[-1].children.append("#")
                out.append(Block(stack[-1].node, text, min(linked, len(text))))
            run.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            text = html_.unescape(raw) if "&" in raw else raw
            run.append(text)
            if link:
                linked += len(text.strip())

        while True:
            m = _MARKUP.search(page, at)
            if m is None:
                add(page[at:])
                break
            if m.start() > at:
                add(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            closing = bool(m["close"])
            if name in RAW and not closing:
                if name in FOREIGN and m["attrs"].endswith("/"):
                    continue
                end = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in INLINE:
                if name == "a":
                    link = max(0, link - 1) if closing else link + 1
                continue
            close_block()
            if name in VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                link = 0
                continue
            if name in _SEPARATED and stack[-1].name == name:
                stack.pop()
            attrs = m["attrs"]  # a slash at their end closes nothing in HTML
            element = Element(name, self._node(stack[-1].node, name, attrs))
            stack[-1].children.append(element.node.path.rsplit("/", 1)[-1])
            stack.append(element), elements.append(element)
        close_block()
        return elements, out


def _host(url: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


_STYLE, _CONTENT, _PAGE = 0, 1, 2


def _counted(pages: DataFrame, html: str, url: str) -> DataFrame:
    """A row a batch, host, node and value: pages that have it, characters, characters in links. A node's own row also describes it."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, chars, linked, known, readers = Counter(), Counter(), Counter(), {}, {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = readers.setdefault(host, Reader())
                elements, blocks = reader.read(page)
                here = set()
                for e in elements:
                    known[host, e.node.id] = e.node
                    here.add((host, e.node.id, _PAGE, 0))
                    if e.children:
                        here.add((host, e.node.id, _STYLE, _hash(" ".join(e.children))))
                for x in blocks:
                    key = host, x.node.id, _CONTENT, _hash(x.text)
                    here.add(key)
                    chars[key] += len(x.text)
                    linked[key] += x.linked
                n.update(here)
            keys = list(n)
            nodes = [known[k[:2]] if k[2] == _PAGE else None for k in keys]
            cols = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.int8(), pa.int64()))]
            cols += [pa.array([c[k] for k in keys], pa.int64()) for c in (n, chars, linked)]
            cols += [pa.array([x and x.path for x in nodes], pa.string()), pa.array([x and list(x.chain) for x in nodes], pa.list_(pa.int64()))]
            cols += [pa.array([x and x.main for x in nodes], pa.int64()), pa.array([x and x.low for x in nodes], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["host", "node", "kind", "value", "n", "chars", "linked", "path", "chain", "main", "low"])

    rows = pages.select(_host(url).alias("host"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "host string, node long, kind byte, value long, n long, chars long, linked long, path string, chain array<long>, main long, low boolean")


def site_trees(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row a host and element node: (host, node, path, chain, main, low, pages, styles, presentation, contents, content, chars, importance, best).

    presentation and content are the importances of the node's styles and contents (null without any), importance is the
    composite of its branch, best the highest of its nodes alone. A node on one page has importances of 1: nothing speaks against it.
    """
    counted = stored(_counted(pages, html, url), "styles")
    described = counted.filter(F.col("kind") == _PAGE).groupBy("host", "node").agg(*(F.any_value(c).alias(c) for c in ("path", "chain", "main", "low")))
    each = counted.groupBy("host", "node", "kind", "value").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked")))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    bits = F.col("n") * F.log("n")
    tree = each.groupBy("host", "node").agg(
        of(_PAGE, F.col("n")).alias("pages"), F.count_if(F.col("kind") == _STYLE).alias("styles"), F.count_if(F.col("kind") == _CONTENT).alias("contents"),
        of(_STYLE, F.col("n")).alias("s"), of(_STYLE, bits).alias("sb"), of(_CONTENT, F.col("n")).alias("c"), of(_CONTENT, bits).alias("cb"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    entropy = lambda n, b: F.when(F.col(n) > 0, F.when(F.col("pages") > 1, 1 - F.col(b) / (F.col(n) * F.log("pages"))).otherwise(1.0))
    tree = tree.join(described, ["host", "node"]).select(
        "host", "node", "path", "chain", "main", "low", "pages", "styles", entropy("s", "sb").alias("presentation"), "contents",
        (entropy("c", "cb") * (1 - F.col("linked") / F.greatest("chars", F.lit(1)))).alias("content"), (F.col("chars") - F.col("linked")).alias("chars"),
    )
    tree = stored(tree, "nodes")
    # every node's evidence goes to all branches that hold it, damped by the levels between
    told = F.when(F.col("presentation").isNull(), 0.0).otherwise(1 - F.pow(F.lit(GAMMA), "styles"))
    said = F.when(F.col("content").isNull(), 0.0).otherwise(1.0)
    value = told * F.coalesce("presentation", F.lit(0.0)) + said * F.coalesce("content", F.lit(0.0))
    spread = tree.select("host", F.size("chain").alias("depth"), (F.col("pages") * (told + said)).alias("weight"), (F.col("pages") * value).alias("value"), F.posexplode("chain").alias("place", "branch"))
    damp = F.pow(F.lit(GAMMA), F.col("depth") - 1 - F.col("place"))
    branches = spread.groupBy("host", F.col("branch").alias("node")).agg(
        F.try_divide(F.sum(F.col("value") * damp), F.sum(F.col("weight") * damp)).alias("importance"), F.max(F.try_divide("value", "weight")).alias("best")
    )  # null: empty
    return tree.join(branches, ["host", "node"], "left").fillna(1.0, ["importance", "best"])


def verdicts(tree: DataFrame) -> DataFrame:
    """(host, cut array<long>, turned, alike array<long>): the branches that go, whether those of low prior stay, and which of them do not even so. Hosts where nothing differs from the prior have no row."""
    varied = F.col("importance") >= VARIES
    text = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("chars"))), F.lit(0))
    roots = tree.filter("node = main").select("host", "main", F.col("importance").alias("root_importance"))
    tree = tree.join(roots, ["host", "main"], "left")
    hosts = tree.groupBy("host").agg(
        text(~F.col("low") & (F.col("main").isNotNull() | (F.col("importance") >= LEAST))).alias("open"), text(F.col("low") & varied).alias("lowly"),
        text(~F.col("low") & F.col("main").isNull() & varied).alias("outside"), text(F.col("main").isNotNull()).alias("inside"),
    )
    tree = tree.join(hosts, "host").withColumn("turned", F.col("open") < ELSEWHERE * (F.col("open") + F.col("lowly")))
    seen = F.col("pages") >= LEAST_PAGES
    below = lambda least: F.greatest("importance", "best") < least
    alike = F.when(F.col("main").isNull(), below(LEAST)).when(
        F.col("node") == F.col("main"), below(LEAST_MAIN) & (F.col("outside") > F.col("inside"))
    ).otherwise(below(LEAST_MAIN) & (F.col("root_importance") >= VARIES))
    found = tree.filter(F.col("node") != 0).select(
        "host", "turned", F.when(~F.col("low") & seen & alike, F.col("node")).alias("cut"), F.when(F.col("low") & F.col("turned") & seen & ~varied, F.col("node")).alias("alike")
    ).filter("cut is not null or turned")
    return found.groupBy("host").agg(F.collect_set("cut").alias("cut"), F.first("turned").alias("turned"), F.collect_set("alike").alias("alike"))


def main_text(reader: Reader, page: str | None) -> str:
    """The text of a page without what its reader removes; of a page most of whose text is in an article or main part, of that part. A teaser in an article does not take the place of the story beside it."""
    found = [x for x in reader.read(page)[1] if not x.node.cut]
    part = [x for x in found if x.node.main is not None]
    size = lambda blocks: sum(len(x.text) for x in blocks)
    return " ".join(x.text for x in (part if 2 * size(part) >= size(found) else found))


def extracted(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, text): a row for each row of pages, repeated and null ids included.

    Null and empty pages: empty text. Pages without a host form one site. An empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    lists = stored(verdicts(site_trees(pages, html, url)), "verdicts")
    rows = pages.select(_host(url).alias("host"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    joined = rows.join(lists, "host", "left").select("page_id", "url", "html", "host", "cut", "turned", "alike")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            readers: dict[str, Reader] = {}
            texts, cut, turned, alike = [], b.column(4), b.column(5), b.column(6)
            for k, (page, host) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if host not in readers:
                    readers[host] = Reader(frozenset(cut[k].as_py() or ()), bool(turned[k].as_py()), frozenset(alike[k].as_py() or ()))
                texts.append(main_text(readers[host], page))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
