"""Evidence of a site, put together from what was read there.

Eight relations meet, each reduced to a row a site before it is joined: the inventory of its sitemaps, their dates, the
sampled pages, the homepage, the careers pages, the job board, the employees' posts and the robots file.  What was not
observed is null, column by column; zero is only what was looked at and not found.  A site whose robots file keeps our
own agent from the root has nothing but that.

Scores and findings read ``evidence``; put this relation in its place (registry.ASSEMBLED) and they grade a site
from its raw inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed, markup, numbers, urls
from ..plans.adapters import hosts
from ..plans.dialect import Dialect
from ..plans.registry import VARIANTS, frame, relation, written
from .hiring import triggers
from .robots import allowed, by_file
from .sampling import drawn_places
from .sites import quotas

OWN_AGENT, SLOTS = "tessellatebot", 8


@written
def site_list(d):
    """The sites to grade: those whose robots file was asked for, and those that only a sitemap names (their number is made from the host's name)."""
    key = lambda h: urls.cache_key(d, h)
    return f"""
SELECT site, host, {key('host')} AS key FROM robots_txt
UNION ALL
SELECT {d.number('u.key')} AS site, u.host, u.key FROM (SELECT {key('site_host')} AS key, min(site_host) AS host FROM {hosts(d)} GROUP BY {key('site_host')}) u LEFT JOIN (SELECT DISTINCT {key('host')} AS key FROM robots_txt) r ON u.key = r.key WHERE r.key IS NULL"""


@frame("site_blocked", "robots_txt")
def blocked(files: DataFrame) -> DataFrame:
    return by_file(files, "robots_blocked")


@relation
def site_blocked(d):
    return robots_blocked(d)


@relation
def robots_blocked(d):
    """Sites that keep our own agent from the root: by its own group, else by everyone's."""
    named = f"a.token <> '*' AND {d.contains(d.lit(OWN_AGENT), 'a.token')}"
    own = f"""
SELECT a.site, a.grp, '/' AS path FROM robots_agent a JOIN (
  SELECT a.site, max(CASE WHEN {named} THEN length(a.token) ELSE 0 END) AS longest, min_by(a.grp, CASE WHEN {named} THEN a.grp - length(a.token) * 1000000 END) AS grp FROM robots_agent a GROUP BY a.site) o ON a.site = o.site
WHERE CASE WHEN o.longest > 0 THEN a.grp = o.grp ELSE a.token = '*' END"""
    return f"SELECT site FROM ({allowed(d, f'({own}) c', 'c.site', 'c.path')}) WHERE NOT allowed"


@written
def site_url(d):
    """Located and classified addresses, with the key of the site whose sitemap names them."""
    return f"SELECT {urls.cache_key(d, 'site_host')} AS key, pos, loc, path, locale, section, canon_key FROM classified_url"


@written
def site_content(d):
    """One row a site and piece of content: its first-seen section and the address that stands for it, an English one if there is one."""
    return f"""
SELECT s.site, s.key AS host, c.canon_key, c.url, c.section, c.section IN ({d.strings(fixed.SHAREABLE)}) AS shareable, NOT {d.rx('c.rep_path', fixed.NOT_SHARED)} AS fit FROM (
  SELECT key, canon_key, min_by(loc, preferred) AS url, min_by(path, preferred) AS rep_path, min_by(section, pos) AS section FROM (
    SELECT *, CASE WHEN locale LIKE 'en%' THEN 0 ELSE 1 END * 1000000000000000 + pos AS preferred FROM site_url) GROUP BY key, canon_key) c
JOIN site_list s ON c.key = s.key"""


@relation
def site_inventory(d):
    n = d.count_if
    return f"""
SELECT c.site, c.canonical_urls, c.shareable, c.pool, c.sections, c.culture_urls, c.careers_urls, c.author_urls, r.total_urls, r.unclassified, r.distinct_locales, coalesce(p.story_urls, 0) AS story_urls FROM (
  SELECT site, host, CAST(count(*) AS BIGINT) AS canonical_urls, {n('shareable')} AS shareable, {n('shareable AND fit')} AS pool, CAST(count(DISTINCT CASE WHEN shareable THEN section END) AS BIGINT) AS sections,
    {n("section = 'culture'")} AS culture_urls, {n("section = 'careers'")} AS careers_urls, {n("section = 'author_tag_taxonomy'")} AS author_urls FROM site_content GROUP BY site, host) c
JOIN (SELECT key, CAST(count(*) AS BIGINT) AS total_urls, {n("section = 'unclassified'")} AS unclassified, CAST(count(DISTINCT locale) AS BIGINT) AS distinct_locales FROM site_url GROUP BY key) r ON c.host = r.key
LEFT JOIN (SELECT key, {n(d.rx('loc', fixed.STORY_PATHS))} AS story_urls FROM (
  SELECT key, loc, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth FROM site_url WHERE section = 'culture') WHERE nth <= 3 GROUP BY key) p ON c.host = p.key"""


@relation
def site_dates(d):
    return f"SELECT {urls.cache_key(d, 'h.host')} AS key, CAST(sum(h.dated) AS BIGINT) AS dated, CAST(sum(h.fresh_365d) AS BIGINT) AS dated_fresh, max(CASE WHEN c.recency_measurable THEN 1 ELSE 0 END) = 1 AS recency_measurable FROM dated_host h JOIN lastmod_credibility c ON h.host = c.host GROUP BY {urls.cache_key(d, 'h.host')}"


@relation
def site_quota(d):
    strata = "(SELECT host, section, CAST(count(*) AS BIGINT) AS n FROM site_content WHERE shareable AND fit GROUP BY host, section)"
    return quotas(d, strata, SLOTS)


@frame("site_place", "site_quota")
def site_places(quota: DataFrame) -> DataFrame:
    return drawn_places(quota)


@relation
def site_place(d):
    return draw_sql(d, "site_quota")


def draw_sql(d: Dialect, quota: str) -> str:
    """DuckDB's form of the draw: the whole shuffle, a swap a step, for all strata of quota(host, section, n, quota) at once."""
    name = "concat(host, '::', section)"
    step = numbers.xorshift32(d, "x")
    j = "1 + CAST(floor(y * (i + 1) / 4294967296) AS BIGINT)"
    swapped = "list_transform(range(1, len(places) + 1), lambda k: CASE WHEN k = i + 1 THEN places[j] WHEN k = j THEN places[i + 1] ELSE places[k] END)"
    return f"""
WITH RECURSIVE shuffle AS (
  SELECT host, section, quota, n - 1 AS i, {numbers.fnv1a(d, name)} AS x, range(1, n + 1) AS places FROM {quota} WHERE quota > 0
  UNION ALL
  SELECT host, section, quota, i - 1 AS i, y AS x, {swapped} AS places FROM (SELECT *, {j} AS j FROM (SELECT *, {step} AS y FROM shuffle WHERE i > 0)))
SELECT host, section, unnest(places[1:quota]) AS place FROM shuffle WHERE i <= 0"""


@written
def site_sample(d):
    """The addresses to read of each site: drawn within sections under a seed of the site's name, the same ones on every run."""
    return """
SELECT p.site, p.host, p.section, p.url FROM (SELECT site, host, section, url, row_number() OVER (PARTITION BY host, section ORDER BY canon_key) AS nth FROM site_content WHERE shareable AND fit) p
JOIN site_place d ON p.host = d.host AND p.section = d.section AND p.nth = d.place"""


@written
def sampled_page(d):
    """What became of each sampled address; without a page it was not retrieved."""
    return """
SELECT s.site, s.url, r.page_id, r.has_og_image, r.has_og_title, r.has_og_description, r.has_share_affordance, r.has_twitter_card, r.has_canonical, r.has_article_schema, r.authors, r.og_image FROM site_sample s
LEFT JOIN (SELECT url, min(page_id) AS page_id FROM page_html WHERE html IS NOT NULL GROUP BY url) f ON s.url = f.url LEFT JOIN page_record r ON f.page_id = r.page_id"""


@relation
def site_pages(d):
    share = lambda cond: numbers.pct(d, d.count_if(cond), "count(page_id)")
    kind = markup.image_class(d, "og_image")
    flags = ["og_image", "og_title", "og_description", "share_affordance", "twitter_card", "canonical", "article_schema"]
    return f"""
SELECT site, CAST(count(*) AS BIGINT) AS attempted, CAST(count(page_id) AS BIGINT) AS retrieved, {', '.join(f'{share(f"has_{f}")} AS {f}' for f in flags)}, {share('authors IS NOT NULL')} AS named_author,
  CASE WHEN {d.count_if("kind IN ('broken', 'placeholder')")} > 0 THEN 'broken' WHEN {d.count_if("kind = 'relative'")} > 0 THEN 'relative' WHEN {d.count_if("kind = 'ok'")} > 0 THEN 'ok' END AS sampled_image
FROM (SELECT *, {kind} AS kind FROM sampled_page) GROUP BY site"""


@relation
def site_byline(d):
    """How many people a site's sampled pages name, and the share of the named pages that the most frequent one has."""
    people = d.explode("site, page_id", "(SELECT * FROM sampled_page WHERE authors IS NOT NULL)", d.split("authors", ", "), "person", "idx")
    name = d.sub("lower(person)", r"^author:\s*")
    return f"""
SELECT c.site, c.people, {d.big(f'floor({d.dbl("c.top_n")} / n.named * 100 + 0.5)')} AS top_share FROM (SELECT site, CAST(count(*) AS BIGINT) AS people, max(n) AS top_n FROM (SELECT site, {name} AS person, count(*) AS n FROM ({people}) GROUP BY site, {name}) GROUP BY site) c
JOIN (SELECT site, count(*) AS named FROM sampled_page WHERE authors IS NOT NULL GROUP BY site) n ON c.site = n.site"""


@relation
def site_page(d):
    """Pages on a site's own host, with their paths."""
    return f"SELECT s.site, p.page_id, p.path, p.read FROM (SELECT page_id, {urls.cache_key(d, urls.host(d, 'url'))} AS key, {urls.path(d, 'url')} AS path, html IS NOT NULL AS read FROM page_html) p JOIN site_list s ON p.key = s.key"


@relation
def site_home(d):
    return f"""
SELECT h.site, m.og_title IS NOT NULL AS home_title, m.og_description IS NOT NULL AS home_description, {markup.image_class(d, 'm.og_image')} AS home_image, coalesce(j.n_types, 0) AS home_types, t.looks_empty AS js_rendered
FROM (SELECT site, min(page_id) AS page_id FROM site_page WHERE read AND path = '/' GROUP BY site) h LEFT JOIN page_meta m ON h.page_id = m.page_id LEFT JOIN page_jsonld j ON h.page_id = j.page_id LEFT JOIN page_text t ON h.page_id = t.page_id"""


@relation
def site_careers(d):
    """A site's careers pages: asked for, read, all of them in need of rendering, and the roles that they name themselves."""
    roles = f"SELECT page_id, CAST(count(*) AS BIGINT) AS roles, {d.count_if(triggers(d, 'title') + " <> ''")} AS buyers FROM self_hosted_role WHERE nth <= 60 GROUP BY page_id"
    return f"""
SELECT c.site, CAST(count(*) AS BIGINT) AS tried, {d.count_if('c.read')} > 0 AS ok, {d.count_if('c.read')} > 0 AND {d.count_if('c.read AND NOT e.needs_rendering')} = 0 AS js_only,
  min_by(coalesce(r.roles, 0), CASE WHEN c.read THEN c.page_id END) AS roles, min_by(coalesce(r.buyers, 0), CASE WHEN c.read THEN c.page_id END) AS buyers
FROM (SELECT * FROM site_page WHERE {d.rx('path', r'(?i)^/(careers?|jobs?|join-us|work-with-us)(/|\z)')}) c LEFT JOIN careers_escalation e ON c.page_id = e.page_id LEFT JOIN ({roles}) r ON c.page_id = r.page_id GROUP BY c.site"""


@relation
def assembled_evidence(d):
    inventory = ["canonical_urls", "sections", "culture_urls", "careers_urls", "author_urls", "story_urls", "distinct_locales"]
    pages = ["og_image", "og_title", "og_description", "share_affordance", "twitter_card", "canonical", "named_author", "article_schema", "sampled_image"]
    return f"""
SELECT s.site, s.host, b.site IS NOT NULL AS blocked_at_root, {', '.join(f'i.{c}' for c in inventory)}, coalesce(i.total_urls, 0) AS total_urls, {d.dbl('coalesce(i.unclassified, 0)')} AS unclassified_raw, {d.dbl('i.shareable')} AS shareable_raw, i.pool AS sampler_pool, i.sections AS content_sections,
  coalesce(t.recency_measurable, false) AS recency_measurable, t.dated, t.dated_fresh, coalesce(p.attempted, 0) AS pages_attempted_raw, coalesce(p.retrieved, 0) AS pages_retrieved, {', '.join(f'p.{c}' for c in pages)},
  y.people AS byline_people, y.top_share AS byline_top_share, h.site IS NOT NULL AS home, h.home_title, h.home_description, h.home_image, h.home_types, h.js_rendered, coalesce(k.tried, 0) AS careers_tried, k.ok AS careers_ok, k.js_only AS careers_js_only,
  r.site IS NOT NULL AS robots_fetched, false AS llms_checked, CASE WHEN a.company IS NULL THEN 'not_looked_up' ELSE 'resolved' END AS index_status, a.employees_indexed, a.employees_posted, a.makers_posted, a.company_posts,
  j.open_reqs AS ats_reqs, CASE WHEN j.site IS NULL AND k.ok THEN k.roles END AS board_reqs, j.posted_30d, CASE WHEN j.site IS NULL AND k.ok THEN k.buyers ELSE coalesce(j.buyer_roles, 0) END AS buyer_roles, CASE WHEN j.site IS NOT NULL THEN c.site IS NOT NULL END AS competitor_mentioned
FROM site_list s LEFT JOIN site_blocked b ON s.site = b.site LEFT JOIN (SELECT DISTINCT site FROM robots_txt) r ON s.site = r.site
LEFT JOIN site_inventory i ON s.site = i.site AND b.site IS NULL LEFT JOIN site_dates t ON s.key = t.key AND i.site IS NOT NULL LEFT JOIN site_pages p ON s.site = p.site AND b.site IS NULL LEFT JOIN site_byline y ON p.site = y.site
LEFT JOIN site_home h ON s.site = h.site AND b.site IS NULL LEFT JOIN site_careers k ON s.site = k.site AND b.site IS NULL LEFT JOIN jobs_analysis j ON s.site = j.site AND b.site IS NULL
LEFT JOIN company_counts a ON s.site = a.company AND b.site IS NULL LEFT JOIN (SELECT DISTINCT site FROM competitor_mentions) c ON s.site = c.site"""


#: The test tables' pages belong to no site, so what was read of the sites is made for them.
VARIANTS.update({
    "site_evidence": ("assembled_evidence", {"page_html": "site_page_html"}),
    "site_grades": ("overall_grade", {"evidence": "assembled_evidence", "page_html": "site_page_html"}),
    "site_leads": ("lead_score", {"evidence": "assembled_evidence", "page_html": "site_page_html"}),
    "site_findings": ("findings", {"evidence": "assembled_evidence", "page_html": "site_page_html"}),
})
