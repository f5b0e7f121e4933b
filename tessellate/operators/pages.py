"""Evidence of single pages: markup, authors, share controls, links, job boards and roles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed, markup, numbers
from ..plans.dialect import Dialect
from ..plans.registry import frame, query, relation


@relation
def meta_tag(d):
    tags = d.explode("page_id", "page_html", d.exta("substring(html, 1, 500000)", r"(?i)<meta\b[^>]*>", 0), "tag", "idx")
    key = f"lower(CASE WHEN p <> '' THEN p WHEN n <> '' THEN n ELSE i END)"
    return f"""
SELECT page_id, idx, {key} AS name, {markup.decoded(d, 'c')} AS content FROM (
  SELECT page_id, idx, {markup.attribute(d, 'tag', 'property')} AS p, {markup.attribute(d, 'tag', 'name')} AS n, {markup.attribute(d, 'tag', 'itemprop')} AS i, {markup.attribute(d, 'tag', 'content')} AS c FROM ({tags}))
WHERE {key} <> ''"""


@query
def meta_attrs(d):
    return "SELECT page_id, idx, name, content FROM meta_tag"


@relation
def page_meta(d):
    """The last content of each name that is read; empty is none."""
    names = {"og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "og_type": "og:type", "og_site_name": "og:site_name", "twitter_card": "twitter:card", "twitter_image": "twitter:image", "meta_author": "author", "meta_description": "description", "meta_published": "article:published_time", "meta_modified": "article:modified_time"}
    cols = ", ".join(f"nullif(max_by(content, CASE WHEN name = '{v}' THEN idx END), '') AS {k}" for k, v in names.items())
    return f"SELECT page_id, {cols} FROM meta_tag GROUP BY page_id"


@query
def open_graph(d):
    return "SELECT page_id, og_title, og_description, og_image, og_title IS NOT NULL AND og_description IS NOT NULL AND og_image IS NOT NULL AS og_complete, twitter_card FROM page_meta"


@query
def og_image_class(d):
    return f"SELECT page_id, og_image, {markup.image_class(d, 'og_image')} AS image_class FROM page_meta"


@relation
def link_tag(d):
    tags = d.explode("page_id, url", "page_html", d.exta("substring(html, 1, 500000)", r"(?i)<link\b[^>]*>", 0), "tag", "idx")
    return f"""
SELECT page_id, url, idx, lower({markup.attribute(d, 'tag', 'rel')}) AS rel, {markup.attribute(d, 'tag', 'href')} AS href, lower({markup.attribute(d, 'tag', 'hreflang')}) AS hreflang, lower({markup.attribute(d, 'tag', 'type')}) AS media, {markup.attribute(d, 'tag', 'title')} AS title FROM ({tags})"""


@query
def canonical_link(d):
    """A content page's last canonical link and a homepage's first."""
    return "SELECT page_id, max_by(href, idx) AS page_canonical, min_by(href, idx) AS home_canonical FROM link_tag WHERE rel = 'canonical' AND href <> '' GROUP BY page_id"


@query
def hreflang_alternates(d):
    return f"SELECT page_id, hreflang, href, nth FROM (SELECT page_id, hreflang, {markup.absolute(d, 'href', 'url')} AS href, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) AS INTEGER) AS nth FROM link_tag WHERE {d.contains('rel', d.lit('alternate'))} AND hreflang <> '' AND href <> '') WHERE nth <= 100"


@query
def feeds_declared(d):
    return f"SELECT page_id, {markup.absolute(d, 'href', 'url')} AS href, media, title FROM link_tag WHERE {d.contains('rel', d.lit('alternate'))} AND {d.rx('media', 'rss|atom|xml')} AND href <> ''"


@relation
def jsonld_block(d):
    inner = d.exta("substring(html, 1, 500000)", r"(?is)<script[^>]*type\s*=\s*[\x22\x27]application/ld\+json[\x22\x27][^>]*>(.*?)</script>", 1)
    source = "(SELECT * FROM page_html WHERE " + d.contains("html", d.lit("ld+json")) + ")"
    return d.explode("page_id", source, inner, "block", "idx")


JSONLD = "page_id long, idx int, place int, name string, said string"


def jsonld_facts(text: str) -> list[tuple[str, str]] | None:
    """What the nodes of a block say, in the order of a walk that takes a node before what it holds: types, authors, dates, headlines. None if it is no JSON."""
    try:
        todo = [json.loads(text.strip())]
    except (ValueError, RecursionError):
        return None
    found: list[tuple[str, str]] = []
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo.extend(reversed(node))
        elif isinstance(node, dict):
            listed = lambda x: x if isinstance(x, list) else [x]
            found += [("@type", t) for t in listed(node.get("@type")) if isinstance(t, str)]
            for a in listed(node.get("author")):
                name = a.get("name") if isinstance(a, dict) else a
                if isinstance(name, str) and name.strip():
                    found.append(("author", name.strip()))
            found += [(k, node[k]) for k in ("datePublished", "dateModified", "headline") if isinstance(node.get(k), str) and node[k]]
            todo.extend(reversed(node.values()))
    return found


@frame("jsonld_fact", "jsonld_block")
def jsonld_walked(blocks: DataFrame) -> DataFrame:
    """(page_id, idx, place, name, said) of blocks(page_id, idx, block), of any depth; a block that is no JSON has one row with a null name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, idx, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = jsonld_facts(text or "")
                rows += [(page, idx, k, *f) for k, f in enumerate(found)] if found is not None else [(page, idx, 0, None, None)]
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["page_id", "idx", "place", "name", "said"])

    return blocks.select("page_id", "idx", "block").mapInArrow(run, JSONLD)


@relation
def jsonld_fact(d):
    """DuckDB's form: every scalar of a block's tree with the key it stands under and the key around that; array places count as their array."""
    steps = "list_filter(string_split(regexp_replace(t.fullkey, '\\[[0-9]+\\]', '', 'g'), '.'), lambda x: x <> '$')"
    clean = "regexp_replace(coalesce(list_extract({0}, {1}), ''), '\"', '', 'g')"
    return f"""
SELECT page_id, idx, place, CASE WHEN key = 'name' AND around = 'author' THEN 'author' ELSE key END AS name, CASE WHEN key = 'author' OR around = 'author' THEN trim(said) ELSE said END AS said FROM (
  SELECT page_id, idx, t.id AS place, {clean.format(steps, -1)} AS key, {clean.format(steps, -2)} AS around, t.atom ->> '$' AS said
  FROM (SELECT page_id, idx, trim(block) AS block FROM jsonld_block WHERE json_valid(trim(block))) b, json_tree(b.block) t WHERE t.type = 'VARCHAR')
WHERE key IN ('@type', 'author', 'datePublished', 'dateModified', 'headline') OR key = 'name' AND around = 'author'
UNION ALL SELECT page_id, idx, 0 AS place, NULL AS name, NULL AS said FROM jsonld_block WHERE NOT json_valid(trim(block))"""


@relation
def page_jsonld(d):
    """Of each page with structured data: its types and authors in the order they come, and the first dates and headline."""
    at = "idx * 1000000 + place"
    once = lambda name, out, by: f"SELECT page_id, {d.join(d.lists('said', 'spot'), by)} AS {out}, max(CASE WHEN {d.rx('said', fixed.ARTICLE_TYPES)} THEN 1 ELSE 0 END) = 1 AS article, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, said, min({at}) AS spot FROM jsonld_fact WHERE name = '{name}' AND coalesce(said, '') <> '' GROUP BY page_id, said) GROUP BY page_id"
    first = lambda name: f"min_by(said, CASE WHEN name = '{name}' AND said <> '' THEN {at} END)"
    return f"""
SELECT b.page_id, b.blocks, coalesce(f.unparseable, 0) AS unparseable, t.types, coalesce(t.article, false) AS has_article, coalesce(t.n, 0) AS n_types, a.authors, f.published, f.modified, f.headline
FROM (SELECT page_id, CAST(count(*) AS BIGINT) AS blocks FROM jsonld_block GROUP BY page_id) b
LEFT JOIN ({once('@type', 'types', ' ')}) t ON b.page_id = t.page_id LEFT JOIN ({once('author', 'authors', ', ')}) a ON b.page_id = a.page_id
LEFT JOIN (SELECT page_id, {d.count_if('name IS NULL')} AS unparseable, {first('datePublished')} AS published, {first('dateModified')} AS modified, {first('headline')} AS headline FROM jsonld_fact GROUP BY page_id) f ON b.page_id = f.page_id"""


@query
def jsonld_walk(d):
    return "SELECT page_id, blocks, unparseable, types, has_article, authors, published, modified, headline FROM page_jsonld"


@relation
def page_byline(d):
    hits = d.explode("page_id", "page_html", d.exta("html", fixed.BYLINE, 1), "raw", "idx")
    return f"SELECT page_id, idx, who FROM (SELECT page_id, idx, {markup.text_of(d, 'raw')} AS who FROM ({hits})) WHERE length(who) > 1 AND length(who) < 80"


@query
def byline(d):
    return "SELECT page_id, idx, who FROM page_byline"


@relation
def page_authors(d):
    """Who wrote a page: structured data, else the meta tag, else the first two bylines."""
    return f"""
SELECT p.page_id, CASE WHEN j.authors IS NOT NULL THEN j.authors WHEN m.meta_author IS NOT NULL THEN m.meta_author ELSE b.names END AS authors,
  CASE WHEN j.authors IS NOT NULL THEN 'json-ld' WHEN m.meta_author IS NOT NULL THEN 'meta[name=author]' WHEN b.names IS NOT NULL THEN 'visible byline' END AS source
FROM page_html p LEFT JOIN page_jsonld j ON p.page_id = j.page_id LEFT JOIN page_meta m ON p.page_id = m.page_id
LEFT JOIN (SELECT page_id, {d.join(d.lists('who', 'idx'), ', ')} AS names FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS nth FROM page_byline) WHERE nth <= 2 GROUP BY page_id) b ON p.page_id = b.page_id"""


@query
def page_author(d):
    return "SELECT page_id, authors, source FROM page_authors"


def controls(d: Dialect) -> str:
    cases = d.array(*(f"CASE WHEN {d.rx('html', p)} THEN '{n}' ELSE '' END" for n, p in fixed.SHARE_CONTROLS))
    return d.join(d.filt(cases, "x", "x <> ''"), " ")


@query
def share_affordances(d):
    return f"SELECT page_id, {controls(d)} AS controls FROM page_html"


@relation
def page_text(d):
    """Visible text, its words, and whether there is hardly any."""
    return f"SELECT page_id, url, visible, {d.chars('visible')} AS chars, CASE WHEN visible = '' THEN 0 ELSE {d.size(d.split('visible', ' '))} END AS words, length(visible) < 800 AS looks_empty FROM (SELECT page_id, url, {markup.visible(d, 'html')} AS visible FROM page_html)"


@query
def page_text_stats(d):
    return "SELECT page_id, chars, words, looks_empty FROM page_text"


@query
def html_to_text(d):
    return f"SELECT page_id, {markup.text_of(d, d.ext('html', r'(?is)<h1[^>]*>(.*?)</h1>'))} AS h1, {markup.decoded(d, d.ext('html', r'(?is)<footer[^>]*>(.*?)</footer>'))} AS footer FROM page_html"


@relation
def page_record(d):
    return f"""
SELECT p.page_id, p.url, m.og_title, m.og_description, m.og_image, coalesce(m.og_title, '') <> '' AS has_og_title, coalesce(m.og_description, '') <> '' AS has_og_description, coalesce(m.og_image, '') <> '' AS has_og_image,
  m.twitter_card, m.twitter_card IS NOT NULL AS has_twitter_card, coalesce(m.twitter_image, m.og_image) IS NOT NULL AS has_twitter_image, c.page_canonical AS canonical, c.page_canonical IS NOT NULL AS has_canonical,
  coalesce(j.has_article, false) AS has_article_schema, j.types AS schema_types, coalesce(j.unparseable, 0) AS json_ld_unparseable, m.og_type, m.og_site_name, a.authors, a.source AS author_source, coalesce(l.rel_authors, 0) AS rel_author_links, coalesce(j.published, m.meta_published) AS published, coalesce(j.modified, m.meta_modified) AS modified,
  CASE WHEN j.published IS NOT NULL THEN 'json-ld' WHEN m.meta_published IS NOT NULL THEN 'meta[article:published_time]' END AS date_source, nullif(h.h1, '') AS h1, s.controls, s.controls <> '' AS has_share_affordance, t.words, t.looks_empty
FROM page_html p LEFT JOIN page_meta m ON p.page_id = m.page_id LEFT JOIN canonical_link c ON p.page_id = c.page_id LEFT JOIN page_jsonld j ON p.page_id = j.page_id
LEFT JOIN page_authors a ON p.page_id = a.page_id LEFT JOIN share_affordances s ON p.page_id = s.page_id LEFT JOIN page_text t ON p.page_id = t.page_id
LEFT JOIN (SELECT page_id, CAST(count(*) AS BIGINT) AS rel_authors FROM link_tag WHERE rel = 'author' AND href <> '' GROUP BY page_id) l ON p.page_id = l.page_id LEFT JOIN html_to_text h ON p.page_id = h.page_id"""


@query
def page_evidence(d):
    return "SELECT * FROM page_record"


@query
def homepage_evidence(d):
    """What a homepage tells: head, links to careers pages and job boards, feeds, structured data, and whether there is text without scripts."""
    title = d.trim(markup.spaced(d, d.ext("substring(html, 1, 400000)", r"(?is)<title[^>]*>(.*?)</title>")))
    generator = "SELECT page_id, nullif(max_by(content, CASE WHEN name = 'generator' THEN idx END), '') AS generator FROM meta_tag GROUP BY page_id"
    return f"""
SELECT p.page_id, nullif({title}, '') AS title, m.meta_description AS description, g.generator, nullif(lower({d.ext('html', r'(?i)<html[^>]*\slang\s*=\s*[\x22\x27]?([a-zA-Z][a-zA-Z0-9-]*)')}), '') AS lang, {d.size(d.exta('html', r'(?i)<a\b[^>]*href\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27)', 0))} AS links,
  c.home_canonical AS canonical, coalesce(j.n_types, 0) AS json_ld_types, k.careers AS career_links, b.boards AS board_hints, f.feeds, t.chars AS text_chars, t.looks_empty AS likely_js_rendered
FROM page_html p LEFT JOIN canonical_link c ON p.page_id = c.page_id LEFT JOIN page_jsonld j ON p.page_id = j.page_id LEFT JOIN page_text t ON p.page_id = t.page_id LEFT JOIN page_meta m ON p.page_id = m.page_id LEFT JOIN ({generator}) g ON p.page_id = g.page_id
LEFT JOIN (SELECT page_id, {d.join(d.lists('href', 'nth'), ' ')} AS careers FROM career_links GROUP BY page_id) k ON p.page_id = k.page_id
LEFT JOIN (SELECT page_id, {d.join(d.lists("concat(ats, ':', token)", "concat(ats, ':', token)"), ' ')} AS boards FROM ats_detect GROUP BY page_id) b ON p.page_id = b.page_id
LEFT JOIN (SELECT page_id, {d.join(d.lists('href', 'href'), ' ')} AS feeds FROM feeds_declared GROUP BY page_id) f ON p.page_id = f.page_id"""


@query
def page_aggregates(d):
    """Of the pages of each language path: how many carry what, and the share to a tenth of a per cent."""
    flags = ["has_og_title", "has_og_description", "has_og_image", "has_twitter_card", "has_canonical", "has_article_schema", "has_share_affordance"]
    cols = ", ".join(f"{d.count_if(f)} AS n_{f[4:]}, {numbers.pct(d, d.count_if(f), 'count(*)')} AS pct_{f[4:]}" for f in flags)
    return f"SELECT {d.ext('url', '^https?://[^/]+/([a-z]+)')} AS lang, CAST(count(*) AS BIGINT) AS pages, {cols}, {d.count_if('authors IS NOT NULL')} AS n_named_author, {numbers.pct(d, d.count_if('authors IS NOT NULL'), 'count(*)')} AS pct_named_author, {d.count_if('looks_empty')} AS n_looks_empty, {numbers.pct(d, d.count_if('looks_empty'), 'count(*)')} AS pct_looks_empty FROM page_record GROUP BY {d.ext('url', '^https?://[^/]+/([a-z]+)')}"


@relation
def page_link(d):
    tags = d.explode("page_id, url", "page_html", d.exta("html", r"(?i)<a\b[^>]*href\s*=\s*(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27)", 0), "tag", "idx")
    return f"SELECT page_id, idx, {markup.absolute(d, 'href', 'url')} AS href FROM (SELECT page_id, url, idx, {markup.attribute(d, 'tag', 'href')} AS href FROM ({tags}))"


@query
def career_links(d):
    return f"SELECT page_id, href, nth FROM (SELECT page_id, href, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_idx) AS INTEGER) AS nth FROM (SELECT page_id, href, min(idx) AS first_idx FROM page_link WHERE {d.rx('href', r'(?i)/(careers?|jobs?|join-us|work-with-us|life-at)(/|\z|\?)')} GROUP BY page_id, href)) WHERE nth <= 10"


@query
def ats_detect(d):
    """Job boards that a page names, by the board's token; of a tenant of Workday also the data centre and the board's name, which its address needs."""
    each = [f"SELECT page_id, '{name}' AS ats, lower(raw) AS token, NULL AS datacenter, NULL AS board, idx FROM ({d.explode('page_id', 'page_html', d.exta('html', pattern, 1), 'raw', 'idx')})" for name, pattern in fixed.JOB_BOARDS]
    part = lambda k: d.ext("raw", fixed.WORKDAY, k)
    each.append(f"SELECT page_id, 'workday' AS ats, lower({part(1)}) AS token, {part(2)} AS datacenter, nullif({part(3)}, '') AS board, idx FROM ({d.explode('page_id', 'page_html', d.exta('html', fixed.WORKDAY, 0), 'raw', 'idx')})")
    first = lambda c: f"min_by({c}, CASE WHEN ats = 'workday' THEN idx END)"
    return f"SELECT page_id, ats, token, {d.text('datacenter_')} AS datacenter, {d.text('board_')} AS board FROM (SELECT page_id, ats, token, {first('datacenter')} AS datacenter_, {first(f"coalesce(board, '')")} AS board_ FROM ({' UNION ALL '.join(each)}) WHERE token <> '' AND token NOT IN ({d.strings(fixed.BOARD_NOISE)}) GROUP BY page_id, ats, token)"


@query
def job_subdomains(d):
    """Links to a host of the page's own name that is for jobs, at most three."""
    hrefs = d.explode("page_id, url", "page_html", d.exta("html", r"(?i)href=[\x22\x27](https?://[^\x22\x27]+)[\x22\x27]", 1), "href", "idx")
    at = lambda h: f"lower({d.ext(h, '^https?://(?:[^/?#@]*@)?([^/?#:]+)')})"
    own, rest = d.ext(d.sub(at("url"), r"^www[.]"), "^([^.]*)"), d.sub(at("href"), "^[a-z]+[.]")
    link = d.sub(d.ext("href", "^(https?://[^?#]+)"), r"/\z")
    return f"""
SELECT page_id, link, nth FROM (SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(idx)) AS INTEGER) AS nth FROM (SELECT page_id, idx, {link} AS link FROM ({hrefs}) WHERE {d.rx(at('href'), r'^(jobs|careers|apply|talent|hiring|work)[.]')} AND {own} <> '' AND {d.starts(rest, own)}) GROUP BY page_id, link) WHERE nth <= 3"""


@relation
def role_candidate(d):
    """Titles on a careers page that could be open roles, from links, headings, marked elements, addresses and embedded data."""
    links = d.explode("page_id, 1 AS kind", "page_html", d.exta("html", r"(?is)<a\b[^>]*href=[\x22\x27][^\x22\x27]*(?:job|career|opening|position|vacanc|apply)[^>]*>(.{0,120}?)</a>", 1), "raw", "idx")
    heads = d.explode("page_id, 2 AS kind", "page_html", d.exta("html", r"(?is)<h[2-4][^>]*>(.{0,120}?)</h[2-4]>", 1), "raw", "idx")
    marked = d.explode("page_id, 3 AS kind", "page_html", d.exta("html", r"(?is)<[a-z]+[^>]*class=[\x22\x27][^\x22\x27]*\b(?:jb-)?(?:role|job|position|opening|vacancy)[-_]?(?:title|name)\b[^\x22\x27]*[\x22\x27][^>]*>(.{0,120}?)</[a-z]+>", 1), "raw", "idx")
    slugs = f"SELECT page_id, kind, initcap(replace(raw, '-', ' ')) AS raw, idx FROM ({d.explode('page_id, 4 AS kind', 'page_html', d.exta('html', r'(?i)href=[\x22\x27][^\x22\x27]*/(?:jobs?|careers?|openings?|positions?)/([a-z0-9][a-z0-9-]{4,60})/?[\x22\x27]', 1), 'raw', 'idx')})"
    if not d.spark:
        slugs = slugs.replace("initcap(replace(raw, '-', ' '))", "array_to_string(list_transform(string_split(replace(raw, '-', ' '), ' '), lambda w: concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), ' ')")
    data = d.explode("page_id, 5 AS kind", "page_html", d.exta("html", r"\x22(?:title|jobTitle|name|role)\x22\s*:\s*\x22([^\x22]{4,90})\x22", 1), "raw", "idx")
    sides = [links, heads, marked, slugs, data]
    return " UNION ALL ".join(f"SELECT page_id, kind, {markup.text_of(d, 'raw')} AS title, kind * 1000000 + idx AS ord FROM ({s})" for s in sides)


@relation
def self_hosted_role(d):
    keep = f"length(title) BETWEEN 4 AND 90 AND {d.rx('title', fixed.ROLE_WORDS)} AND NOT {d.rx('title', fixed.NOT_ROLES)} AND NOT {d.rx('title', r'(?i)^(view|apply|see|browse|learn|read)\b')} AND NOT {d.rx('title', r'[.!?](\s|\z)')} AND {d.size(d.split('title', ' '))} <= 8"
    return f"SELECT page_id, title, kind, ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(title) ORDER BY ord) AS again FROM role_candidate WHERE {keep}) WHERE again = 1"


@query
def self_hosted_roles(d):
    return "SELECT page_id, title, kind, nth FROM self_hosted_role WHERE nth <= 60"


@query
def careers_escalation(d):
    """Does a page's own markup name a job board or two roles, so that it need not be rendered?"""
    return """
SELECT p.page_id, coalesce(a.boards, 0) AS boards, coalesce(r.roles, 0) AS roles, coalesce(a.boards, 0) = 0 AND coalesce(r.roles, 0) < 2 AS needs_rendering
FROM page_html p LEFT JOIN (SELECT page_id, CAST(count(*) AS BIGINT) AS boards FROM ats_detect GROUP BY page_id) a ON p.page_id = a.page_id LEFT JOIN (SELECT page_id, CAST(count(*) AS BIGINT) AS roles FROM self_hosted_role GROUP BY page_id) r ON p.page_id = r.page_id"""


@query
def company_shorthands(d):
    """Company pages that a page links, the most linked first."""
    hits = d.explode("page_id", "page_html", d.exta("html", r"(?i)https?://(?:[a-z]{2,3}\.)?linkedin\.com/company/([A-Za-z0-9][A-Za-z0-9._%-]*?)(?:[/?#\x22\x27\s<]|\z)", 1), "raw", "idx")
    plain = f"CASE WHEN {d.rx('raw', '%(?![0-9A-Fa-f]{2})')} OR NOT {d.contains('raw', d.lit('%'))} THEN raw ELSE {d.percent_decoded('raw')} END" if d.spark else f"CASE WHEN {d.rx('raw', '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')} OR NOT {d.contains('raw', d.lit('%'))} THEN raw ELSE {d.percent_decoded('raw')} END"
    return f"SELECT page_id, shorthand, n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first_idx) AS INTEGER) AS nth FROM (SELECT page_id, shorthand, CAST(count(*) AS BIGINT) AS n, min(idx) AS first_idx FROM (SELECT page_id, idx, {d.sub(f'lower({plain})', r'[.]\z')} AS shorthand FROM ({hits})) WHERE shorthand NOT IN ('about', 'login', 'signup') GROUP BY page_id, shorthand)"


@query
def site_title(d):
    """A site's title, and the name that its head gives it, in either order of attributes."""
    t, one, two = d.ext("html", r"(?i)<title[^>]*>([^<]{1,300})</title>"), d.ext("html", r"(?i)property=[\x22\x27]og:site_name[\x22\x27][^>]*content=[\x22\x27]([^\x22\x27]{1,200})[\x22\x27]"), d.ext("html", r"(?i)content=[\x22\x27]([^\x22\x27]{1,200})[\x22\x27][^>]*property=[\x22\x27]og:site_name[\x22\x27]")
    s = f"CASE WHEN {one} <> '' THEN {one} ELSE {two} END"
    return f"SELECT page_id, {d.trim(f'concat({t}, {d.lit(chr(32))}, {s})')} AS site_title FROM page_html"


@query
def llms_txt(d):
    """The first lines of a text file that is asked for by convention; a page of markup in its place is none."""
    markup_ = d.rx("body", r"(?i)^\s*<(!doctype|html)")
    return f"SELECT page_id, body <> '' AND NOT {markup_} AS present, CASE WHEN body <> '' AND NOT {markup_} THEN {d.join(d.slice(d.split('body', chr(10)), 1, 8), ' | ')} END AS head FROM llms_reply"


@query
def author_concentration(d):
    """Bylines of the pages of a language path: how many people, how much the most frequent has."""
    who = d.explode("page_id, url", "(SELECT a.page_id, p.url, a.authors FROM page_authors a JOIN page_html p ON a.page_id = p.page_id WHERE a.authors IS NOT NULL)", d.split("authors", ", "), "person", "idx")
    path = d.ext("url", "^https?://[^/]+/([a-z]+)")
    return f"""
SELECT l.lang, l.pages, l.named, coalesce(c.people, 0) AS people, {d.big(f'CASE WHEN l.named > 0 THEN floor({d.dbl('c.top_n')} / l.named * 100 + 0.5) ELSE 0 END')} AS top_share FROM (
  SELECT {path} AS lang, CAST(count(*) AS BIGINT) AS pages, CAST(count(a.authors) AS BIGINT) AS named FROM page_html p LEFT JOIN page_authors a ON p.page_id = a.page_id GROUP BY {path}) l
LEFT JOIN (SELECT lang, CAST(count(*) AS BIGINT) AS people, max(n) AS top_n FROM (SELECT {path} AS lang, {d.sub('lower(person)', r'^author:\s*')} AS person, count(*) AS n FROM ({who}) GROUP BY {path}, {d.sub('lower(person)', r'^author:\s*')}) GROUP BY lang) c ON l.lang = c.lang"""
