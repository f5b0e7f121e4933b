"""Sitemaps: parsing, traversal, deduplication, and what their dates are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..plans.adapters import NOW_ORDERS
from ..plans.dialect import Dialect
from ..plans.registry import frame, query, relation, written
from ..sources.scratch import kept


def entries(d: Dialect, parts: str, also: str = "") -> str:
    """What the blocks of documents say: parts(site_host, url, doc_ord, is_index, block, idx), those without an address only if ``also`` holds."""
    raw = d.trim(d.ext("block", r"(?is)<loc>\s*(.*?)\s*</loc>"))
    plain = f"replace(replace(replace(replace(replace(raw, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', {d.lit(chr(39))})"
    return f"""
SELECT site_host, url, doc_ord, is_index, idx, {urls.resolved(d, 'url', 'plain')} AS loc, lastmod FROM (
  SELECT site_host, url, doc_ord, is_index, idx, {plain} AS plain, nullif(lastmod, '') AS lastmod FROM (
    SELECT site_host, url, doc_ord, is_index, idx, {raw} AS raw, {d.trim(d.ext('block', r'(?is)<lastmod>\s*(.*?)\s*</lastmod>'))} AS lastmod FROM ({parts})) WHERE {also}raw <> '')"""


def blocks(d: Dialect) -> tuple[str, str]:
    """Is a document an index, and the parts of it that name an address."""
    index = d.rx("xml", r"(?i)<sitemapindex[\s>]")
    return index, f"CASE WHEN {index} THEN {d.exta('xml', r'(?is)<sitemap[\s>].*?</sitemap>', 0)} WHEN {d.rx('xml', r'(?is)<url[\s>].*?</url>')} THEN {d.exta('xml', r'(?is)<url[\s>].*?</url>', 0)} ELSE {d.exta('xml', r'(?is)<loc>.*?</loc>', 0)} END"


@written
def sitemap_read(d):
    """Spark's form of all documents, read once: their entries, and of each document a row of place -1. What a document is is told before it is cut: told behind that it would be looked up in the whole document for every entry."""
    index, parts = blocks(d)
    documents = f"(SELECT site_host, url, doc_ord, xml, {index} AS is_index FROM sitemap_doc)"
    each = d.explode("site_host, url, doc_ord, is_index", documents, f"concat(array(CAST(NULL AS STRING)), coalesce({parts.replace(index, 'is_index', 1)}, CAST(array() AS ARRAY<STRING>)))", "block", "at")
    return entries(d, f"SELECT site_host, url, doc_ord, is_index, block, at - 1 AS idx FROM ({each})", "idx < 0 OR ")


@relation
def sitemap_entry(d):
    if d.spark:
        return "SELECT site_host, url, doc_ord, is_index, idx, loc, lastmod FROM sitemap_read WHERE idx >= 0"
    index, parts = blocks(d)
    return entries(d, d.explode(f"site_host, url, doc_ord, {index} AS is_index", "sitemap_doc", parts, "block", "idx"))


@query
def sitemap_parse(d):
    """Documents by what they are: an index, a set of URLs, or neither if nothing can be read from them."""
    index, documents = ("x.is_index", "(SELECT url, is_index FROM sitemap_read WHERE idx < 0)") if d.spark else (d.rx("x.xml", r"(?i)<sitemapindex[\s>]"), "sitemap_doc")
    return f"""
SELECT x.url, CASE WHEN {index} THEN 'index' WHEN e.entries > 0 THEN 'urlset' ELSE 'unknown' END AS kind, coalesce(e.entries, 0) AS entries, coalesce(e.entries_with_lastmod, 0) AS entries_with_lastmod
FROM {documents} x LEFT JOIN (SELECT url, CAST(count(*) AS BIGINT) AS entries, CAST(count(lastmod) AS BIGINT) AS entries_with_lastmod FROM sitemap_entry GROUP BY url) e ON x.url = e.url"""


MOST_DOCUMENTS, MOST_URLS = 60, 60_000


@frame("sitemap_walk", "sitemap_seed", "sitemap_parse", "sitemap_entry", "sitemap_denied")
def walked(seeds: DataFrame, documents: DataFrame, entries: DataFrame, denied: DataFrame, most: int = MOST_DOCUMENTS, most_urls: int = MOST_URLS) -> DataFrame:
    """Documents in the order of a breadth-first walk from each host's seeds: (site_host, url, place, kind, new_urls).

    seeds(site_host, url, ord), documents(url, kind), entries(url, is_index, idx, loc), denied(url). A document is visited
    once, however many indexes name it, so cycles end. One that robots rules deny is skipped and does not count; one without
    a body is an error. A host's walk ends after ``most`` documents or once it has ``most_urls`` URLs, which may be within a document; what is left has no row
    but the kind ``left``. Each level is a join of the level before and an anti-join with all that was seen; its size is that of the level.
    """
    kinds = documents.select("url", "kind").join(denied.select("url").distinct().withColumn("no", F.lit(True)), "url", "full").select("url", F.when(F.col("no"), "skipped").otherwise(F.col("kind")).alias("kind"))
    kinds = kept(kinds, "sitemap-kinds")
    links = entries.filter("is_index").select(F.col("url").alias("parent"), "loc", "idx")
    by = Window.partitionBy("site_host")
    level = seeds.groupBy("site_host", "url").agg(F.min(F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).alias("b"))).alias("key"))
    seen, base = None, None
    while True:
        numbered = level.withColumn("nth", F.row_number().over(by.orderBy("key")))
        if base is not None:
            numbered = numbered.join(base, "site_host", "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before")
        level = kept(numbered.join(kinds, "url", "left").select("site_host", "url", F.col("nth").cast("long").alias("place"), F.coalesce("kind", F.lit("error")).alias("kind")), "sitemaps")
        seen = level if seen is None else seen.unionByName(level)
        fetched = F.count_if(F.col("kind") != "skipped")
        base = seen.groupBy("site_host").agg(F.count("*").alias("before"), fetched.alias("fetched"))
        following = level.filter("kind = 'index'").join(base.filter(F.col("fetched") < most).select("site_host"), "site_host", "left_semi").join(links, F.col("url") == F.col("parent"))
        following = following.groupBy("site_host", F.col("loc").alias("url")).agg(F.min(F.struct(F.col("place").alias("a"), F.col("idx").alias("b"))).alias("key"))
        level = following.join(seen, ["site_host", "url"], "left_anti")
        base = base.drop("fetched")
        if level.isEmpty():
            break
    order = by.orderBy("place")
    nth = F.sum(F.when(F.col("kind") != "skipped", 1).otherwise(0)).over(order)
    inside = seen.withColumn("nth", nth).withColumn("kind", F.when(F.col("nth") <= most, F.col("kind")).otherwise("left")).drop("nth")
    first = inside.filter("kind = 'urlset'").join(entries.filter("not is_index").select("url", F.regexp_replace("loc", "#.*", "").alias("loc")), "url")
    fresh = first.groupBy("site_host", "loc").agg(F.min_by("url", "place").alias("url")).groupBy("site_host", "url").agg(F.count("*").alias("new_urls"))
    counted = inside.join(fresh, ["site_host", "url"], "left").withColumn("new_urls", F.coalesce("new_urls", F.lit(0)))
    so_far = F.coalesce(F.sum("new_urls").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.when(F.col("kind") == "left", 0).otherwise(F.least("new_urls", most_urls - F.col("so_far")))
    return counted.withColumn("so_far", so_far).withColumn("kind", F.when(F.col("so_far") < most_urls, F.col("kind")).otherwise("left")).select("site_host", "url", "place", "kind", taken.alias("new_urls"))


@frame("sitemap_collected", "sitemap_walk", "sitemap_entry")
def collected(walk: DataFrame, entries: DataFrame) -> DataFrame:
    """(site_host, loc, url): what a walk collects. Each address once, under the first document that names it; of the document at which a host reaches its cap, the first ones."""
    read = walk.filter("kind = 'urlset'").select("site_host", "url", "place", "new_urls")
    each = read.join(entries.filter("not is_index").select("url", "idx", F.regexp_replace("loc", "#.*", "").alias("loc")), "url")
    first = each.groupBy("site_host", "loc").agg(F.min(F.struct("place", "idx", "url", "new_urls")).alias("f")).select("site_host", "loc", "f.*")
    # Only a document at the cap has more addresses than it may give: its rows are numbered, no other's.
    sizes = first.groupBy("site_host", "url").agg(F.count("*").alias("n"))
    first = first.join(sizes, ["site_host", "url"])
    cut = first.filter("n > new_urls").withColumn("nth", F.row_number().over(Window.partitionBy("site_host", "url").orderBy("idx"))).filter("nth <= new_urls")
    return first.filter("n <= new_urls").select("site_host", "loc", "url").unionByName(cut.select("site_host", "loc", "url"))


@relation
def sitemap_walk(d):
    """DuckDB's form, for hosts whose one index names no further index: the index, then its documents as it names them."""
    return """
SELECT w.site_host, w.url, w.place, CASE WHEN n.url IS NOT NULL THEN 'skipped' ELSE coalesce(x.kind, 'error') END AS kind, CAST(CASE WHEN n.url IS NULL AND x.kind = 'urlset' THEN coalesce(u.new_urls, 0) ELSE 0 END AS BIGINT) AS new_urls FROM (
  SELECT site_host, url, CAST(1 AS BIGINT) AS place FROM sitemap_seed
  UNION ALL SELECT s.site_host, e.loc AS url, 1 + row_number() OVER (PARTITION BY s.site_host ORDER BY e.idx) AS place FROM sitemap_seed s JOIN sitemap_entry e ON e.url = s.url WHERE e.is_index) w
LEFT JOIN sitemap_parse x ON w.url = x.url LEFT JOIN sitemap_denied n ON w.url = n.url
LEFT JOIN (SELECT url, count(*) AS new_urls FROM (
  SELECT regexp_replace(e.loc, '#.*', '') AS loc, min_by(e.url, x.doc_ord) AS url FROM sitemap_entry e JOIN sitemap_doc x ON e.url = x.url
  WHERE NOT e.is_index AND e.url NOT IN (SELECT url FROM sitemap_denied) GROUP BY e.site_host, regexp_replace(e.loc, '#.*', '')) GROUP BY url) u ON w.url = u.url"""


@query
def sitemap_traverse(d):
    """The documents of each host's walk, in order."""
    return "SELECT site_host, url, place, kind, new_urls FROM sitemap_walk"


@relation
def sitemap_collected(d):
    return """
SELECT site_host, loc, url FROM (SELECT w.site_host, w.url, regexp_replace(e.loc, '#.*', '') AS loc, row_number() OVER (PARTITION BY w.site_host, regexp_replace(e.loc, '#.*', '') ORDER BY w.place, e.idx) AS nth
  FROM sitemap_walk w JOIN sitemap_entry e ON e.url = w.url WHERE w.kind = 'urlset' AND NOT e.is_index) WHERE nth = 1"""


@query
def sitemap_inventory(d):
    """Addresses that a host's walk collected, by its documents."""
    return "SELECT site_host, url, CAST(count(*) AS BIGINT) AS urls, min(loc) AS first_loc FROM sitemap_collected GROUP BY site_host, url"


@query
def sitemap_notes(d):
    """What a walk has to say of itself: documents read, skipped, failed and left, and the URLs that came of it."""
    return f"SELECT site_host, {d.count_if("kind NOT IN ('skipped', 'left')")} AS fetched, {d.count_if("kind = 'skipped'")} AS skipped, {d.count_if("kind = 'error'")} AS errors, {d.count_if("kind = 'left'")} AS left_unread, CAST(sum(new_urls) AS BIGINT) AS urls FROM sitemap_walk GROUP BY site_host"


@relation
def sitemap_unique(d):
    """Entries by location: the first document keeps it, a missing date is filled from later ones, the others are listed."""
    return f"""
SELECT site_host, loc, min_by(url, ord) AS first_in, min_by(lastmod, CASE WHEN lastmod IS NOT NULL THEN ord END) AS lastmod, CAST(count(*) - 1 AS BIGINT) AS repeats, {d.join(d.sorted('collect_set(url)') if d.spark else 'list_sort(list(DISTINCT url))', ' ')} AS found_in
FROM (SELECT site_host, url, lastmod, {d.sub('loc', '#.*')} AS loc, doc_ord * 1000000000 + idx AS ord FROM sitemap_entry WHERE NOT is_index) GROUP BY site_host, loc"""


@query
def sitemap_dedupe(d):
    return "SELECT loc, first_in, lastmod, repeats, found_in FROM sitemap_unique"


@written
def dated_host(d):
    """Spark's form counts by day first, in one pass."""
    if d.spark:
        age = f"{d.seconds(f"TIMESTAMP '{NOW_ORDERS}'")} - t"
        return f"""
SELECT host, urls_total, dated, newest, oldest, distinct_days, span_days, fresh_30d, fresh_90d, fresh_365d, CASE WHEN dated > 0 THEN top.day END AS top_day, CASE WHEN dated > 0 THEN top.n END AS top_n, {numbers.pct(d, 'CASE WHEN dated > 0 THEN top.n END', 'dated')} AS top_pct FROM (
  SELECT host, sum(n) AS urls_total, coalesce(sum(CASE WHEN day IS NOT NULL THEN n END), 0L) AS dated, max(day) AS newest, min(day) AS oldest, count(day) AS distinct_days, CAST(floor((max(latest) - min(earliest)) / 86400.0 + 0.5) AS BIGINT) AS span_days,
    sum(fresh_30d) AS fresh_30d, sum(fresh_90d) AS fresh_90d, sum(fresh_365d) AS fresh_365d, min_by(struct(day, n), CASE WHEN day IS NOT NULL THEN struct(-n AS fewer, first_pos) END) AS top FROM (
    SELECT host, {d.day('date')} AS day, n, latest, earliest, first_pos, fresh_30d, fresh_90d, fresh_365d FROM (
      SELECT host, date, count(*) AS n, max(t) AS latest, min(t) AS earliest, min(pos) AS first_pos, {d.count_if(f'{age} <= 30 * 86400')} AS fresh_30d, {d.count_if(f'{age} <= 90 * 86400')} AS fresh_90d, {d.count_if(f'{age} <= 365 * 86400')} AS fresh_365d
      FROM (SELECT site_host AS host, CAST(lastmod AS DATE) AS date, {d.seconds('lastmod')} AS t, pos FROM sitemap_url) GROUP BY host, date)) GROUP BY host)"""
    now = d.seconds(f"TIMESTAMP '{NOW_ORDERS}'")
    age = f"{now} - t"
    return f"""
SELECT host, urls_total, dated, newest, oldest, distinct_days, span_days, fresh_30d, fresh_90d, fresh_365d, top_day, top_n, {numbers.pct(d, 'top_n', 'dated')} AS top_pct FROM (
  SELECT host, CAST(count(*) AS BIGINT) AS urls_total, CAST(count(t) AS BIGINT) AS dated, max(day) AS newest, min(day) AS oldest, CAST(count(DISTINCT day) AS BIGINT) AS distinct_days,
    CAST(floor((max(t) - min(t)) / 86400.0 + 0.5) AS BIGINT) AS span_days, {d.count_if(f'{age} <= 30 * 86400')} AS fresh_30d, {d.count_if(f'{age} <= 90 * 86400')} AS fresh_90d, {d.count_if(f'{age} <= 365 * 86400')} AS fresh_365d
  FROM (SELECT site_host AS host, {d.seconds('lastmod')} AS t, {d.day('lastmod')} AS day FROM sitemap_url) GROUP BY host) s
LEFT JOIN (SELECT host AS k, day AS top_day, n AS top_n FROM (
  SELECT host, day, n, row_number() OVER (PARTITION BY host ORDER BY n DESC, first_pos) AS nth FROM (SELECT site_host AS host, {d.day('lastmod')} AS day, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos FROM sitemap_url WHERE lastmod IS NOT NULL GROUP BY site_host, {d.day('lastmod')})) WHERE nth = 1) m ON s.host = m.k"""


@query
def lastmod_stats(d):
    return f"SELECT host, urls_total, dated, {numbers.pct(d, 'dated', 'urls_total')} AS coverage_pct, newest, oldest, distinct_days, span_days, fresh_30d, fresh_90d, fresh_365d, top_day, top_n, top_pct FROM dated_host"


@query
def lastmod_credibility(d):
    """Signs that a host's dates come from rebuilds and not from edits; without one they measure recency."""
    one, short, few = "coalesce(top_pct >= 15, false)", "dated >= 300 AND span_days > 0 AND span_days < 550", "dated >= 300 AND span_days > 60 AND distinct_days < span_days * 0.05"
    return f"SELECT host, {one} AS one_day, {short} AS short_range, {few} AS few_days, dated > 0 AND NOT ({one} OR ({short}) OR ({few})) AS recency_measurable FROM dated_host"
