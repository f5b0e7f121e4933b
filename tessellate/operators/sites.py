"""Hosts and the URL inventory: normalising, locales, sections, samples and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, numbers, urls
from ..plans.dialect import Dialect
from ..plans.registry import frame, query, relation
from .ordered import running


@query
def normalize_domain(d):
    return f"SELECT id, {urls.normalized_domain(d, 'typed')} AS domain FROM typed_domain"


@query
def cache_key(d):
    return f"SELECT id, {urls.cache_key(d, 'typed')} AS cache_key FROM typed_domain"


@query
def registrable_domain(d):
    return f"SELECT id, {urls.registrable_domain(d, 'typed')} AS domain FROM typed_domain"


@query
def host_precheck(d):
    return f"""
SELECT id, {urls.host_check(d, 'h', 'bare', 'four')} AS reason FROM (
  SELECT id, h, bare, {urls.dotted_end(d, 'bare')} AS four FROM (SELECT id, h, {urls.without_brackets(d, 'h')} AS bare FROM (SELECT id, {urls.cleaned_host(d, 'typed')} AS h FROM typed_domain)))"""


@query
def ip_is_blocked(d):
    """May a socket be opened to an address? Not to one that is private, local or reserved, of either family, nor to what is none."""
    return f"SELECT id, ip, CASE WHEN {d.contains('ip', d.lit(':'))} THEN {urls.ipv6_blocked(d)} ELSE {urls.ipv4_blocked(d, 'ip')} END AS blocked FROM ({urls.with_ipv6_words(d, 'address', 'id, ip', 'ip')})"


@query
def url_resolution(d):
    """References of many kinds against the page that they stand on."""
    return f"SELECT id, base, href, {urls.resolved(d, 'base', 'href')} AS url FROM reference"


@query
def domain_list(d):
    """Lines of a domain file: comments go, names are normalised, the first of each cache key stays; what is no domain is among domain_rejects."""
    return f"""
SELECT cache_key, min(id) AS line, CAST(count(*) AS BIGINT) AS repeats FROM (
  SELECT id, {urls.cache_key(d, 'domain')} AS cache_key FROM (SELECT id, domain FROM listed_domain WHERE domain IS NOT NULL)) GROUP BY cache_key"""


@relation
def listed_domain(d):
    return f"SELECT id, line, {urls.normalized_domain(d, 'line')} AS domain FROM domain_line WHERE NOT {d.rx('line', r'^\s*#')} AND {d.trim('line')} <> ''"


@query
def domain_rejects(d):
    """Lines of a domain file that are no domain, as they stand."""
    return "SELECT id, line FROM listed_domain WHERE domain IS NULL"


@query
def candidate_paths(d):
    """Where a sitemap, a careers page or an English version is looked for by convention."""
    paths = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap1.xml", "/wp-sitemap.xml", "/en/", "/en-us/", "/en-gb/", "/careers", "/jobs"]
    return d.explode("id, domain", f"(SELECT id, {urls.normalized_domain(d, 'typed')} AS domain FROM typed_domain) WHERE domain IS NOT NULL" if not d.spark else f"(SELECT * FROM (SELECT id, {urls.normalized_domain(d, 'typed')} AS domain FROM typed_domain) WHERE domain IS NOT NULL)", d.array(*(d.lit(p) for p in paths)), "path", "ord")


@relation
def url_parsed(d):
    return f"SELECT pos, loc, lastmod, doc_no, site_host, {urls.host(d, 'loc')} AS host, {urls.path(d, 'loc')} AS path FROM sitemap_url"


@query
def promoted_locales(d):
    """Look-alike languages (it, no, ...) that a host's other paths or its country suffix prove to be locales. Addresses are first reduced to the locales of a host."""
    lang, region = urls.locale_lang(d, "path"), urls.locale_region(d, "path")
    iso = f"lang IN ({d.strings(fixed.LANGUAGES)})"
    alike = f"lang IN ({d.strings(fixed.LOOKALIKES)})"
    number = lambda cond: f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER (PARTITION BY host)"
    definite = number(f"region <> '' AND ({iso} OR region = lang) OR region = '' AND {iso} AND NOT {alike}")
    return f"""
SELECT host, lang FROM (SELECT host, lang, region, {definite} AS definite, {number(f"region = '' AND {iso}")} AS bare_langs FROM (
  SELECT host, lang, region FROM (SELECT host, {lang} AS lang, {region} AS region FROM url_parsed) WHERE lang <> '' GROUP BY host, lang, region))
WHERE region = '' AND {iso} AND {alike} AND (definite >= 2 OR bare_langs >= 3 OR {d.ext('host', r'([^.]+)\z')} = lang)"""


@relation
def url_paths(d):
    """Paths without suffix, and what follows a wrapping first segment. Built in steps, so that each expression reads columns and stays small."""
    return f"""
SELECT *, {urls.unwrapped(d, 'bare')} AS inner_path FROM (
  SELECT u.pos, u.site_host, u.loc, u.lastmod, u.host, u.path, {urls.bare_path(d, 'u.path')} AS bare, p.langs
  FROM url_parsed u LEFT JOIN (SELECT host, {d.lists('lang', 'lang')} AS langs FROM promoted_locales GROUP BY host) p ON u.host = p.host)"""


@relation
def url_located(d):
    return f"""
SELECT pos, site_host, loc, lastmod, host, path, coalesce(inner_locale, bare_locale) AS locale,
  CASE WHEN inner_locale IS NOT NULL THEN {urls.after_locale(d, 'inner_path')} WHEN bare_locale IS NOT NULL THEN {urls.after_locale(d, 'bare')} ELSE bare END AS norm_path
FROM (SELECT *, {urls.locale_of(d, 'inner_lang', 'inner_region', 'langs')} AS inner_locale, {urls.locale_of(d, 'bare_lang', 'bare_region', 'langs')} AS bare_locale FROM (
  SELECT *, {urls.locale_lang(d, 'inner_path')} AS inner_lang, {urls.locale_region(d, 'inner_path')} AS inner_region, {urls.locale_lang(d, 'bare')} AS bare_lang, {urls.locale_region(d, 'bare')} AS bare_region FROM url_paths))"""


@relation
def classified_url(d):
    """Located URLs with section and canonical key."""
    return f"SELECT pos, site_host, loc, lastmod, host, path, locale, norm_path, {urls.section(d, 'norm_path')} AS section, concat({d.sub('host', r'^www[.]')}, {d.sub('norm_path', r'/\z')}) AS canon_key FROM url_located"


@query
def path_normalize(d):
    return "SELECT pos, loc, norm_path, locale FROM url_located"


@query
def canon_key(d):
    return "SELECT pos, canon_key FROM classified_url"


@query
def classify_section(d):
    return "SELECT pos, loc, section FROM classified_url"


@query
def cms_cruft(d):
    return f"SELECT pos, norm_path, {urls.is_cruft(d, 'norm_path')} AS cruft FROM url_located"


@query
def path_depth_hist(d):
    return f"SELECT host, {d.size(urls.segments(d, 'norm_path'))} AS depth, CAST(count(*) AS BIGINT) AS urls FROM url_located GROUP BY host, {d.size(urls.segments(d, 'norm_path'))}"


@relation
def content(d):
    """One row a piece of content, from one pass over its URLs: its first-seen section, the URL that stands for it (an English one if there is one), and what a site's counts need."""
    n = d.count_if
    return f"""
SELECT canon_key, host, rep.url AS url, rep.path AS rep_path, section, locales, urls, unclassified, shareable_urls, localized_urls, sections FROM (
  SELECT canon_key, min({d.sub('host', r'^www[.]')}) AS host, min_by(struct(loc AS url, path), struct(CASE WHEN locale LIKE 'en%' THEN 0 ELSE 1 END AS foreign, pos)) AS rep, min_by(section, pos) AS section, collect_set(locale) AS locales, collect_set(section) AS sections,
    count(*) AS urls, {n("section = 'unclassified'")} AS unclassified, {n(urls.shareable(d, 'section'))} AS shareable_urls, count(locale) AS localized_urls FROM classified_url GROUP BY canon_key)"""


@relation
def canonical_content(d):
    """One row a piece of content: its first-seen section, and the URL that stands for it, an English one if there is one."""
    if d.spark:
        return "SELECT canon_key, host, url, section, CAST(size(locales) AS BIGINT) AS locale_count, rep_path FROM content"
    return f"""
SELECT canon_key, host, url, section, locale_count, rep_path FROM (
  SELECT canon_key, {d.sub('host', r'^www[.]')} AS host, loc AS url, path AS rep_path, first_value(section) OVER (PARTITION BY canon_key ORDER BY pos) AS section,
    row_number() OVER (PARTITION BY canon_key ORDER BY CASE WHEN locale LIKE 'en%' THEN 0 ELSE 1 END, pos) AS nth
  FROM classified_url) r
JOIN (SELECT canon_key AS k, CAST(count(DISTINCT locale) AS BIGINT) AS locale_count FROM classified_url GROUP BY canon_key) n ON r.canon_key = n.k
WHERE nth = 1"""


@query
def canonical_rep(d):
    return "SELECT canon_key, url, section, locale_count FROM canonical_content"


@query
def junk_filter(d):
    return f"SELECT canon_key, url, section FROM canonical_content WHERE NOT {d.rx('rep_path', fixed.NOT_SHARED)}"


@query
def shareable_count(d):
    n = d.count_if(urls.shareable(d, "section"))
    return f"SELECT host, CAST(count(*) AS BIGINT) AS canonical_urls, {n} AS shareable, {numbers.pct(d, n, 'count(*)')} AS shareable_pct FROM canonical_content GROUP BY host"


@query
def section_samples(d):
    return f"""
SELECT host, section, {d.join(d.lists('loc', 'pos'), ' ')} AS samples FROM (
  SELECT host, section, loc, pos, row_number() OVER (PARTITION BY host, section ORDER BY pos) AS nth FROM classified_url) WHERE nth <= 3 GROUP BY host, section"""


@frame("ordered_url", "url_parsed")
def ordered_urls(parsed: DataFrame) -> DataFrame:
    """(host, loc, nth, n): the place of each address among its host's, from 0, and how many there are. No task holds a host."""
    placed = running(parsed.select("host", "loc", "pos").withColumn("one", F.lit(1).cast("long")), "host", ["loc", "pos"], "one", "nth")
    return placed.join(parsed.groupBy("host").agg(F.count("*").alias("n")), "host").select("host", "loc", "nth", "n")


@relation
def ordered_url(d):
    return "SELECT host, loc, row_number() OVER (PARTITION BY host ORDER BY loc, pos) - 1 AS nth, count(*) OVER (PARTITION BY host) AS n FROM url_parsed"


@query
def stride_sample(d):
    """At most 20 URLs a host, at a fixed stride over their order."""
    return f"""
SELECT host, loc FROM ordered_url
WHERE nth % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0 AND {d.idiv('nth', 'greatest(1, CAST(ceil(n / 20.0) AS BIGINT))')} < 20"""


@query
def prefix_hist(d):
    """The 15 most frequent first segments of unclassified paths of each host, in order of first appearance among equals."""
    prefix = f"concat('/', coalesce({d.at(urls.segments(d, 'norm_path'), 1)}, ''))"
    return f"""
SELECT host, prefix, n, nth FROM (
  SELECT host, prefix, n, CAST(row_number() OVER (PARTITION BY host ORDER BY n DESC, first_pos) AS INTEGER) AS nth FROM (
    SELECT host, {prefix} AS prefix, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos FROM classified_url WHERE section = 'unclassified' GROUP BY host, {prefix})) WHERE nth <= 15"""


@query
def path_prefixes(d):
    """Histograms of raw paths to depth 1 and 2, at most 1000 entries a depth and host, with the number there are."""
    one, two = d.at(urls.segments(d, "path"), 1), d.at(urls.segments(d, "path"), 2)
    each = lambda depth, prefix, cond: f"SELECT host, {depth} AS depth, {prefix} AS prefix, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos FROM url_parsed WHERE {cond} GROUP BY host, {prefix}"
    first, second = f"concat('/', coalesce({one}, ''))", f"concat('/', {one}, '/', {two})"
    return f"""
SELECT host, depth, prefix, n, n_distinct, n_distinct > 1000 AS truncated FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY host, depth ORDER BY n DESC, first_pos) AS INTEGER) AS nth, CAST(count(*) OVER (PARTITION BY host, depth) AS BIGINT) AS n_distinct FROM (
    {each(1, first, 'true')} UNION ALL {each(2, second, f'{two} IS NOT NULL')})) WHERE nth <= 1000"""


@relation
def inventory(d):
    """Counts of a host: raw URLs, pieces of content, and the pool that is left of the shareable ones without pages nobody would share."""
    n = d.count_if(urls.shareable(d, "section"))
    pool = d.count_if(f"{urls.shareable(d, 'section')} AND NOT {d.rx('rep_path', fixed.NOT_SHARED)}")
    if d.spark:
        return f"""
SELECT host, sum(urls) AS total_urls, sum(unclassified) AS unclassified, sum(shareable_urls) AS shareable_urls, sum(localized_urls) AS localized_urls, CAST(size(array_distinct(flatten(collect_set(locales)))) AS BIGINT) AS distinct_locales,
  CAST(size(array_remove(array_distinct(flatten(collect_set(sections))), 'unclassified')) AS BIGINT) AS sections_present, count(*) AS canonical_urls, {n} AS canonical_shareable, count(DISTINCT CASE WHEN section <> 'unclassified' THEN section END) AS canonical_sections, {pool} AS shareable_pool
FROM content GROUP BY host"""
    return f"""
SELECT r.host, r.total_urls, r.unclassified, r.shareable_urls, r.localized_urls, r.distinct_locales, r.sections_present, c.canonical_urls, c.canonical_shareable, c.canonical_sections, c.shareable_pool
FROM (SELECT {d.sub('host', r'^www[.]')} AS host, CAST(count(*) AS BIGINT) AS total_urls, {d.count_if("section = 'unclassified'")} AS unclassified, {n} AS shareable_urls, CAST(count(locale) AS BIGINT) AS localized_urls,
  CAST(count(DISTINCT locale) AS BIGINT) AS distinct_locales, CAST(count(DISTINCT CASE WHEN section <> 'unclassified' THEN section END) AS BIGINT) AS sections_present FROM classified_url GROUP BY {d.sub('host', r'^www[.]')}) r
JOIN (SELECT host, CAST(count(*) AS BIGINT) AS canonical_urls, {n} AS canonical_shareable, CAST(count(DISTINCT CASE WHEN section <> 'unclassified' THEN section END) AS BIGINT) AS canonical_sections, {pool} AS shareable_pool FROM canonical_content GROUP BY host) c ON r.host = c.host"""


@query
def inventory_rollup(d):
    return f"SELECT *, total_urls - canonical_urls AS collapsed_by_localization, {numbers.pct(d, 'canonical_shareable', 'canonical_urls')} AS shareable_share_pct FROM inventory"


@query
def section_counts(d):
    """Raw and canonical counts of every section of a host."""
    return f"""
SELECT r.host, r.section, r.urls, coalesce(c.n, 0) AS canonical FROM (SELECT {d.sub('host', r'^www[.]')} AS host, section, CAST(count(*) AS BIGINT) AS urls FROM classified_url GROUP BY {d.sub('host', r'^www[.]')}, section) r
LEFT JOIN (SELECT host, section, CAST(count(*) AS BIGINT) AS n FROM canonical_content GROUP BY host, section) c ON r.host = c.host AND r.section = c.section"""


@query
def locale_hist(d):
    """Raw URLs and pieces of content of every locale of a host."""
    return f"SELECT {d.sub('host', r'^www[.]')} AS host, locale, CAST(count(*) AS BIGINT) AS urls, CAST(count(DISTINCT canon_key) AS BIGINT) AS contents FROM classified_url WHERE locale IS NOT NULL GROUP BY {d.sub('host', r'^www[.]')}, locale"


@query
def cross_host(d):
    """Of each site, the host most of its URLs are on, and the number on others."""
    return f"""
SELECT site, host AS primary_host, n, total - n AS elsewhere FROM (
  SELECT site, host, n, CAST(sum(n) OVER (PARTITION BY site) AS BIGINT) AS total, row_number() OVER (PARTITION BY site ORDER BY n DESC, first_pos) AS nth FROM (
    SELECT {urls.registrable_domain(d, 'host')} AS site, host, CAST(count(*) AS BIGINT) AS n, min(pos) AS first_pos FROM url_parsed GROUP BY {urls.registrable_domain(d, 'host')}, host)) WHERE nth = 1"""


@query
def coverage_gate(d):
    """Can a site's structure be read? Not if half its URLs, or of a small pool three tenths, are unclassified."""
    share = numbers.pct(d, "unclassified", "total_urls")
    return f"SELECT host, total_urls, shareable_pool, unclassified_pct, unclassified_pct >= 50 OR (shareable_pool < {fixed.LEAST_POOL} AND unclassified_pct >= 30) AS insufficient FROM (SELECT *, {share} AS unclassified_pct FROM inventory)"


def quotas(d: Dialect, strata: str, size: int) -> str:
    """Slots of each stratum of a host: one each by size, then by share, then by largest remainder, then to the largest."""
    w = "PARTITION BY host"
    by_size = "ORDER BY n DESC, section"
    return f"""
SELECT host, section, n, CAST(given + least(n - given, greatest(0, left_over - coalesce(before, 0))) AS BIGINT) AS quota FROM (
  SELECT *, sum(n - given) OVER ({w} {by_size} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, {size} - sum(given) OVER ({w}) AS left_over FROM (
    SELECT host, section, n, CASE WHEN after_share > 0 AND frac_rank <= after_share AND base < n THEN base + 1 ELSE base END AS given FROM (
      SELECT *, {size} - sum(base) OVER ({w}) AS after_share, row_number() OVER ({w} ORDER BY CASE WHEN base < n THEN 0 ELSE 1 END, frac DESC, section) AS frac_rank FROM (
        SELECT host, section, n, 1 + least(CAST(floor(exact) AS BIGINT), n - 1) AS base, exact - floor(exact) AS frac FROM (
          SELECT host, section, n, {d.dbl('n')} / sum(n) OVER ({w}) * greatest(0, {size} - count(*) OVER ({w})) AS exact FROM (
            SELECT host, section, n, row_number() OVER ({w} {by_size}) AS nth FROM {strata}) WHERE nth <= {size})))))"""


@relation
def stratum(d):
    if d.spark:
        return f"SELECT host, section, count(*) AS n FROM content WHERE NOT {d.rx('rep_path', fixed.NOT_SHARED)} AND {urls.shareable(d, 'section')} GROUP BY host, section"
    return f"SELECT host, section, CAST(count(*) AS BIGINT) AS n FROM junk_filter JOIN (SELECT canon_key AS k, host FROM canonical_content) ON canon_key = k WHERE {urls.shareable(d, 'section')} GROUP BY host, section"


@query
def quota_alloc(d):
    return quotas(d, "stratum", 8)


@query
def fnv1a(d):
    return f"SELECT c_custkey AS id, {numbers.fnv1a(d, 'c_name')} AS seed FROM customer"


@query
def xorshift32(d):
    seed = f"(SELECT c_custkey AS id, {numbers.fnv1a(d, 'c_name')} AS s0 FROM customer)"
    return f"SELECT id, s1, {numbers.xorshift32(d, 's1')} AS s2 FROM (SELECT id, {numbers.xorshift32(d, 's0')} AS s1 FROM {seed})"


@relation
def sample_pool(d):
    """Shareable content, numbered within host and section by its key."""
    return f"""
SELECT host, section, url, row_number() OVER (PARTITION BY host, section ORDER BY canon_key) AS place FROM (
  SELECT host, section, url, canon_key FROM canonical_content WHERE NOT {d.rx('rep_path', fixed.NOT_SHARED)} AND {urls.shareable(d, 'section')})"""
