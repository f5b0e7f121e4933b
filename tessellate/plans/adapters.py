"""Deterministic relations that give the test tables the shapes that the engine reads.

The tables hold no sitemaps, robots files, job postings or vendor claims; each relation here
derives one from keys and dates, by the same text in both engines.
"""

from __future__ import annotations

from ..functions import urls
from .dialect import Dialect
from .registry import relation, written

WORDS = (
    "blog/ customers/ recipes/r library/ guides/ news/ about/news/ events/ podcasts/ careers/ life-at-acme team about-us docs/ locations product/ solutions pricing integrations legal tag/ contact "
    "2021/11/18/launch 2020/05 presse/ veranstaltungen/ referenzen karriere ueber-uns impressum kontakt produkte loesungen hilfe preise filialen blogg store/ p/ copy-of-home lorem-ipsum unknown-topic/ data/ blog/terms events/agenda "
    "guides/start.html index.html shows/page/3 it no"
).split()
LOCALES = ["", "en-us/", "de/", "fr/", "it/", "corp/en/", "cz-cz/", "se/"]
NOW_ORDERS, NOW_EVENTS, NOW_ACTIVITY = "2001-08-02 00:00:00", "2024-01-31 00:00:00", "2024-04-15 12:00:00"


def picked(d: Dialect, items: list[str], index: str) -> str:
    """items[index] as text."""
    return d.at(d.array(*(d.lit(x) for x in items)), f"CAST(({index}) + 1 AS INT)")


def host_name(d: Dialect, n: str) -> str:
    number = d.text(n)
    return f"CASE ({n}) % 4 WHEN 0 THEN concat('www.site', {number}, '.com') WHEN 1 THEN concat('site', {number}, '.it') WHEN 2 THEN concat('shop.site', {number}, '.co.uk') ELSE concat('site', {number}, '.com') END"


@relation
def sitemap_url(d):
    m = d.idiv("o_orderkey", 40)
    word = picked(d, WORDS, f"{m} % {len(WORDS)}")
    return f"""
SELECT o_orderkey AS pos, {host_name(d, 'o_orderkey % 40')} AS site_host,
  concat('https://', {host_name(d, 'o_orderkey % 40')}, '/', {picked(d, LOCALES, f"{d.idiv(m, len(WORDS))} % {len(LOCALES)}")},
    {word}, CASE WHEN {d.rx(word, '/$')} THEN {d.text(d.idiv(m, len(WORDS) * len(LOCALES)))} ELSE '' END) AS loc,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS lastmod,
  o_orderkey % 3 AS doc_no
FROM orders"""


@written
def sitemap_host(d):
    """Spark's form of the hosts that have sitemaps: all that is made a host is made of these few rows, not of every address."""
    return "SELECT DISTINCT site_host FROM sitemap_url"


def hosts(d: Dialect) -> str:
    return "sitemap_host" if d.spark else "sitemap_url"


def marked_up(d: Dialect, source: str) -> str:
    """Pages (page_id, url, html) with share, author and structured markup put in after the head opens."""
    k = "page_id"
    parts = [
        f"CASE WHEN {k} % 3 <> 0 THEN concat('<meta property=\"og:title\" content=\"Page &amp; ', {d.text(k)}, '\">') ELSE '' END",
        f"CASE WHEN {k} % 4 = 0 THEN '<meta property=\"og:title\" content=\"Second\">' ELSE '' END",
        f"CASE WHEN {k} % 5 < 3 THEN '<meta name=\"og:description\" content=\"About it\">' ELSE '' END",
        f"CASE {k} % 7 WHEN 0 THEN '<meta property=\"og:image\" content=\"https://cdn.site.com/a.png\">' WHEN 1 THEN '<meta property=\"og:image\" content=\"https://cdn.site.com/undefined\">' WHEN 2 THEN '<meta property=\"og:image\" content=\"https://cdn.site.com/placeholder-1.png\">' WHEN 3 THEN '<meta property=\"og:image\" content=\"/img/b.jpg\">' ELSE '' END",
        f"CASE WHEN {k} % 2 = 0 THEN '<meta name=\"twitter:card\" content=\"summary\">' ELSE '' END",
        f"CASE WHEN {k} % 6 = 1 THEN concat('<meta name=\"author\" content=\"Author ', {d.text(k + ' % 5')}, '\">') ELSE '' END",
        f"CASE WHEN {k} % 3 = 0 THEN concat('<link rel=\"canonical\" href=\"', url, '\"><link rel=\"canonical\" href=\"/second\">') ELSE '' END",
        f"CASE WHEN {k} % 4 = 1 THEN '<link rel=\"alternate\" hreflang=\"de\" href=\"/de/x\"><link rel=\"alternate\" type=\"application/rss+xml\" title=\"Feed\" href=\"https://feeds.site.com/rss\">' ELSE '' END",
        f"CASE {k} % 5 WHEN 0 THEN concat('<script type=\"application/ld+json\">{{\"@type\":\"Article\",\"headline\":\"H\",\"datePublished\":\"2024-01-0', {d.text(k + ' % 9 + 1')}, '\",\"author\":{{\"@type\":\"Person\",\"name\":\"Person ', {d.text(k + ' % 3')}, '\"}}}}</script>') WHEN 1 THEN '<script type=\"application/ld+json\">{{\"@type\":[\"Organization\",\"Brand\"],\"author\":\"Team\"}}</script>' WHEN 2 THEN '<script type=\"application/ld+json\">{{bad</script>' ELSE '' END",
        f"CASE WHEN {k} % 5 = 0 THEN '<span class=\"byline\">By Jane Doe</span>' ELSE '' END",
        f"CASE {k} % 8 WHEN 0 THEN '<a href=\"https://twitter.com/intent/tweet?x\">t</a>' WHEN 1 THEN '<a href=\"https://www.linkedin.com/sharing/share-offsite/?u\">l</a>' WHEN 2 THEN '<div class=\"box share\"></div>' WHEN 3 THEN '<a href=\"mailto:?subject=hi\">m</a>' ELSE '' END",
        f"CASE WHEN {k} % 3 = 1 THEN '<a href=\"/careers/open\">Careers</a><a href=\"https://jobs.lever.co/acme\">Jobs</a><a href=\"https://boards.greenhouse.io/embed/job_board?for=acme\">G</a>' ELSE '' END",
        f"CASE WHEN {k} % 4 = 2 THEN concat('<a href=\"https://www.linkedin.com/company/acme-', {d.text(k + ' % 3')}, '/\">in</a><a href=\"https://www.linkedin.com/company/acme-0/about\">in</a><a href=\"https://jobs.site.com/x/\">j</a><a href=\"https://careers.', {d.sub(d.ext('url', '^https?://([^/?#:]+)'), '^www[.]')}, '/open/\">c</a>') ELSE '' END",
        f"CASE WHEN {k} % 8 = 5 THEN '<a href=\"https://Acme.wd5.myworkdayjobs.com/External\">w</a><a href=\"https://acme.wd3.myworkdayjobs.com/Other\">w</a><a href=\"https://www.linkedin.com/company/caf%C3%A9-co%20x/\">in</a><meta content=\"Site Name\" property=\"og:site_name\">' ELSE '' END",
        f"CASE WHEN {k} % 6 = 0 THEN '<h2>Senior Software Engineer</h2><h3>Head of Employer Brand</h3><a href=\"/jobs/social-media-manager\">Social Media Manager</a><h3>Our privacy manager policy</h3>' ELSE '' END",
    ]
    fragment = "concat(" + ", ".join(p.replace("{{", "{").replace("}}", "}") for p in parts) + ")"
    return f"""
SELECT page_id, url, concat(substring(html, 1, {d.at_head()}), {fragment}, substring(html, {d.at_head()} + 1)) AS html FROM {source}"""


@relation
def page_html(d):
    return marked_up(d, "pages")


@written
def site_page_html(d):
    """What was read of the sites that have sitemaps: most of the sampled addresses, their homepages and careers pages, each with the text of one of the pages."""
    own = " UNION ALL ".join(f"SELECT DISTINCT concat('https://', site_host, '{path}') AS url FROM {hosts(d)}" for path in ("/", "/careers"))
    return marked_up(d, f"(SELECT u.page_id, u.url, p.html FROM (SELECT {d.number('url')} AS page_id, url FROM (SELECT url FROM site_sample UNION ALL {own})) u JOIN pages p ON p.page_id = u.page_id % 50 WHERE u.page_id % 9 <> 0)")


ROBOTS = [
    "User-agent: *\nDisallow: /private/\nAllow: /private/open\nSitemap: https://x.com/sitemap.xml\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nContent-Signal: search=yes, ai-train=no\nAllow: /\n",
    "# nothing\n",
    "User-agent: *\nDisallow: /\nCrawl-delay: 5\n",
    "User-agent: *\nDisallow: /*.pdf$\nDisallow: /search\nAllow: /search/about\nUser-agent: Googlebot\nUser-agent: Bingbot\nUser-agent: OAI-SearchBot\nDisallow: /\nContent-Signal: search=yes,ai-input=yes\n",
    "User-agent: Amazonbot\nUser-agent: Applebot-Extended\nUser-agent: Bytespider\nUser-agent: CCBot\nUser-agent: ClaudeBot\nUser-agent: CloudflareBrowserRenderingCrawler\nUser-agent: Google-Extended\nUser-agent: GPTBot\nUser-agent: meta-externalagent\nDisallow: /\nUser-agent: *\nContent-signal: use=reference\nDisallow:\n",
    "Disallow: /tmp\nUser-agent: *\nCrawl-delay: 1\nUser-agent: *\nDisallow: /a\nCrawl-delay: 9\nNoindex: /b\n",
    "user-agent: claude\nDisallow: /x # all\nUSER-AGENT: *\nSitemap: https://x.com/s.xml\nUser-agent: bot\nDisallow: /y\n",
]


@relation
def robots_txt(d):
    """A robots file a customer key; every ninth is missing."""
    return f"SELECT c_custkey AS site, concat('site', {d.text('c_custkey')}, '.com') AS host, CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE {picked(d, ROBOTS, f'c_custkey % {len(ROBOTS)}')} END AS body FROM customer"


@relation
def ai_agent(d):
    from ..functions.fixed import AGENTS

    rows = ", ".join(f"({k}, {d.lit(a)}, {d.lit(kind)})" for k, (a, kind) in enumerate(AGENTS))
    return f"SELECT * FROM (VALUES {rows}) AS _a(ord, agent, kind)"


@relation
def job(d):
    titles = ["Software Engineer", "Head of Internal Communications", "Social Media Manager", "Employer Brand Lead", "Data Analyst", "VP, Corporate Communications", "Recruiter", "Talent-Brand Specialist", "Employee Advocacy Manager", "Accountant"]
    text = d.lit("We use Supplier#000000001 and other tools. ")
    return f"""
SELECT o_custkey AS site, o_orderkey AS ord, {picked(d, titles, f'o_orderkey % {len(titles)}')} AS title, c_mktsegment AS department,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('City ', {d.text('c_nationkey')}) END AS location,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS posted_at,
  concat(CASE WHEN o_orderkey % 4 = 0 THEN repeat({text}, 6) ELSE 'Short text about supplier#000000002.' END, ' ', o_orderpriority) AS description,
  {picked(d, ['greenhouse', 'lever', 'ashby', 'workday'], 'o_custkey % 4')} AS ats
FROM orders JOIN customer ON o_custkey = c_custkey"""


@relation
def claim(d):
    """What a vendor says of a customer, from line items: a row a line."""
    return f"""
SELECT l_orderkey * 8 + l_linenumber AS claim_id, concat('v', {d.text('l_suppkey')}) AS vendor_key, s_name AS vendor_name,
  {picked(d, ['advocacy', 'comms', 'social'], 's_suppkey % 3')} AS vendor_tier, s_suppkey % 10 = 0 AS is_client_vendor,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE concat('site', {d.text('o_custkey')}, '.com') END AS domain, c_name AS customer_name,
  CASE WHEN l_partkey % 13 = 0 THEN 'named_unresolved' ELSE {picked(d, ['confirmed', 'probable', 'possible'], 'l_partkey % 3')} END AS confidence,
  {picked(d, ['app store', 'play store', 'logo wall', 'case study'], 'l_partkey % 4')} AS source,
  l_returnflag = 'R' AS historical, l_shipdate AS last_updated, l_partkey AS part
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


@relation
def company_post(d):
    """Posts of a company's employees and of its page; a company is a block of users."""
    return f"SELECT {d.idiv('user_id', 10)} AS company, user_id AS employee, event_id AS post_id, CASE event_type WHEN 'purchase' THEN 'company' WHEN 'click' THEN 'reshare' ELSE 'own' END AS kind, ts, user_id % 7 = 0 AS is_decision_maker, event_type IN ('view', 'click', 'purchase') AS is_post FROM events"


@relation
def evidence(d):
    """One row a site of what was observed there, for the scores."""
    k = "c_custkey"
    return f"""
SELECT {k} AS site, concat('site', {d.text(k)}, '.com') AS host, {k} % 17 = 3 AS blocked_at_root,
  CASE WHEN {k} % 23 = 5 THEN NULL ELSE ({k} * 37) % 6100 END AS canonical_urls,
  ({k} * 37) % 6100 + ({k} * 13) % 900 AS total_urls, (({k} * 37) % 6100 + ({k} * 13) % 900) * (({k} * 7) % 67) / 100e0 AS unclassified_raw,
  ({k} * 37) % 6100 * (({k} * 11) % 101) / 100e0 AS shareable_raw, CASE WHEN {k} % 6 = 0 THEN NULL ELSE ({k} * 29) % 5200 END AS sampler_pool,
  {k} % 9 AS sections, {k} % 5 <> 1 AS recency_measurable, 50 + {k} % 400 AS dated, ({k} * 3) % 50 AS dated_fresh,
  {k} % 24 AS pages_attempted_raw, CASE WHEN {k} % 19 = 7 THEN 0 ELSE {d.idiv(f'({k} % 24) * (3 + {k} % 2)', 4)} END AS pages_retrieved,
  CASE WHEN {k} % 10 = 0 THEN NULL ELSE ({k} * 17) % 101 END AS og_image, ({k} * 19) % 101 AS og_title, ({k} * 23) % 101 AS og_description, ({k} * 31) % 101 AS share_affordance,
  ({k} * 41) % 101 AS twitter_card, ({k} * 43) % 101 AS canonical, CASE WHEN {k} % 8 = 2 THEN NULL ELSE ({k} * 47) % 101 END AS named_author, CASE WHEN {k} % 9 = 4 THEN NULL ELSE ({k} * 53) % 101 END AS article_schema,
  {k} % 34 AS culture_urls, {k} % 22 AS careers_urls, {k} % 3 <> 0 AS careers_ok, {k} % 4 AS story_urls, {k} % 60 AS author_urls,
  {picked(d, ['resolved', 'unresolved', 'disabled', 'resolved'], f'{k} % 4')} AS index_status, CASE WHEN {k} % 14 = 3 THEN NULL ELSE {k} % 300 END AS employees_indexed,
  CASE WHEN {k} % 15 = 2 THEN NULL ELSE {d.idiv(f'({k} % 300) * ({k} % 30)', 100)} END AS employees_posted, CASE WHEN {k} % 16 = 1 THEN NULL ELSE {d.idiv(f'{k} % 300', 40)} END AS makers_posted, CASE WHEN {k} % 18 = 3 THEN NULL ELSE {k} % 230 END AS company_posts,
  {k} % 4 <> 3 AS robots_fetched, {k} % 3 = 0 AS llms_checked, {k} % 11 <> 10 AS home, {k} % 5 <> 2 AS home_title, {k} % 7 <> 3 AS home_description, {k} % 13 = 1 AS js_rendered, {k} % 6 AS distinct_locales, {k} % 6 AS content_sections,
  nullif({picked(d, ['ok', 'ok', 'broken', 'relative', 'placeholder', 'none'], f'{k} % 6')}, 'none') AS home_image, {picked(d, ['ok', 'broken', 'ok', 'relative', 'ok', 'ok'], f'({k} + 1) % 6')} AS sampled_image,
  CASE WHEN {k} % 2 = 0 THEN 3 ELSE 0 END AS careers_tried, {k} % 7 = 6 AS careers_js_only, {k} % 26 AS byline_people, CASE WHEN {k} % 26 = 0 THEN 0 ELSE 100 / (1 + {k} % 5) END AS byline_top_share, {k} % 12 AS home_types,
  CASE WHEN {k} % 4 = 0 THEN NULL ELSE ({k} * 5) % 420 END AS ats_reqs, CASE WHEN {k} % 8 = 0 THEN ({k} * 3) % 60 END AS board_reqs, CASE WHEN {k} % 4 IN (0, 1) THEN NULL ELSE ({k} * 3) % 90 END AS posted_30d, {k} % 4 AS buyer_roles, {k} % 5 = 0 AS competitor_mentioned,
  c_acctbal AS balance, c_mktsegment AS segment
FROM customer"""


TYPED = [
    " HTTPS://WWW.Site{n}.com./path?q=1 ", "site{n}.co.uk", "{n}", "foo..com", "x{n}.test", "a.b{n}.example.org", "10.0.{n}.5", "0x7f0000{n}", "localhost", "my{n}.local", "nodot{n}", "www2.shop{n}.de/", "http://user@sub.site{n}.com.au:8080/x", "", "8.8.{n}.8", "::ffff:10.0.0.{n}",
]


ADDRESSES = ["10.1.2.{n}", "8.8.8.{n}", "172.20.0.{n}", "172.40.0.{n}", "192.168.{n}.1", "100.64.0.{n}", "169.254.0.{n}", "203.0.113.{n}", "198.51.100.{n}", "224.0.0.{n}", "1.2.3", "999.1.1.{n}", "192.0.2.{n}", "198.18.1.{n}", "text{n}", "0.0.0.{n}", "::", "::1", "::ffff:10.0.0.{n}", "::ffff:8.8.8.{n}", "FE80::{n}", "febf:1::{n}", "fec0::{n}", "fd00::{n}:1", "ff02::{n}", "2001:db8:{n}::1", "2001:0DB8::8.8.8.{n}", "2001:4860:4860::{n}", "::10.0.0.{n}", "::8.8.4.{n}", "1:2:3:4:5:6:7:{n}", "1:2:3:4:5:6:7", "1::2::{n}", "0:0:0:0:0:0:0:1", "0:0:0:0:0:ffff:a00:{n}", "64:ff9b::8.8.8.{n}", ":1:2", "12345::{n}"]
REFERENCES = ["/a/../b/{n}", "../x/{n}", "../../../{n}", "?q={n}", "#s{n}", "", "./y/{n}", ".", "..", "g;x=1/../{n}", "//cdn.example.com/i/{n}.png", "//cdn.example.com?{n}", "https://other.example/{n}/./z/..", "mailto:a{n}@b.co", "javascript:void(0)", "tel:{n}", "page-{n}.html#top", "HTTP://Other.example", "a//b/../{n}", "/?x=../{n}"]


def _filled(d: Dialect, items: list[str], key: str) -> str:
    return f"replace({picked(d, items, f'{key} % {len(items)}')}, '{{n}}', {d.text(key + ' % 250')})"


@relation
def typed_domain(d):
    return f"SELECT c_custkey AS id, {_filled(d, TYPED, 'c_custkey')} AS typed FROM customer"


@relation
def address(d):
    return f"SELECT c_custkey AS id, {_filled(d, ADDRESSES, 'c_custkey')} AS ip FROM customer"


@relation
def reference(d):
    return f"SELECT page_id AS id, url AS base, {_filled(d, REFERENCES, 'page_id')} AS href FROM pages"


@relation
def domain_line(d):
    """Lines of a domain file, some of them comments."""
    return "SELECT id, CASE WHEN id % 10 = 9 THEN concat('# ', typed) ELSE typed END AS line FROM typed_domain"


@relation
def wanted_page(d):
    """Pages that a crawl is about to ask for, each under the robots file of its own site."""
    return "SELECT page_id, page_id AS site, CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/private/x' ELSE '/search' END AS path FROM pages"


@relation
def sitemap_doc(d):
    """Documents of each host: an index, and its children with entries of several spellings."""
    lastmod = f"CASE WHEN lastmod IS NULL THEN '' ELSE concat('<lastmod> ', {d.day('lastmod')}, ' </lastmod>') END"
    loc = "CASE WHEN pos % 7 = 0 THEN concat(replace(loc, concat('https://', site_host), ''), '?a=1&amp;b=2') WHEN pos % 7 = 1 THEN concat(loc, '#top') ELSE loc END"
    entry = f"CASE WHEN doc_no = 2 THEN concat('<loc>', {loc}, '</loc>') ELSE concat('<url><loc> ', {loc}, ' </loc>', {lastmod}, '</url>') END"
    return f"""
SELECT site_host, concat('https://', site_host, '/sitemap-', {d.text('doc_no')}, '.xml') AS url, doc_no + 1 AS doc_ord, concat('<urlset>', {d.join(d.lists(entry, 'pos'), '')}, '</urlset>') AS xml
FROM (SELECT * FROM sitemap_url UNION ALL SELECT pos, site_host, loc, NULL AS lastmod, (doc_no + 1) % 3 AS doc_no FROM sitemap_url WHERE pos % 10 = 3) GROUP BY site_host, doc_no
UNION ALL
SELECT DISTINCT site_host, concat('https://', site_host, '/sitemap.xml') AS url, 0 AS doc_ord,
  concat('<sitemapindex><sitemap><loc>https://', site_host, '/sitemap-0.xml</loc></sitemap><sitemap><loc>/sitemap-1.xml</loc></sitemap><sitemap><loc>https://', site_host, '/sitemap-2.xml</loc></sitemap><sitemap><loc>https://', site_host, '/gone.xml</loc></sitemap><sitemap><loc>/empty.xml</loc></sitemap></sitemapindex>') AS xml
FROM {hosts(d)}
UNION ALL SELECT DISTINCT site_host, concat('https://', site_host, '/empty.xml') AS url, 9 AS doc_ord, '<urlset></urlset>' AS xml FROM {hosts(d)}"""


@relation
def sitemap_seed(d):
    return f"SELECT DISTINCT site_host, concat('https://', site_host, '/sitemap.xml') AS url, 0 AS ord FROM {hosts(d)}"


@relation
def sitemap_denied(d):
    """Documents that a host's robots rules deny to our agent."""
    return f"SELECT DISTINCT concat('https://', site_host, '/sitemap-1.xml') AS url FROM {hosts(d)} WHERE {d.rx('site_host', '[.]it$')}"


@relation
def board_reply(d):
    """Replies of three job-board interfaces as they come: JSON of three shapes."""
    day, ms, url = f"coalesce({d.day('posted_at')}, '')", f"coalesce({d.text(d.seconds('posted_at') + ' * 1000')}, 'null')", f"concat('https://board.example/', {d.text('ord')})"
    place = "coalesce(location, '')"
    green = f"concat('{{\"title\":\"', title, '\",\"location\":{{\"name\":\"', {place}, '\"}},\"departments\":[{{\"name\":\"', department, '\"}},{{\"name\":\"\"}},{{\"name\":\"All\"}}],\"first_published\":\"', CASE WHEN ord % 2 = 0 THEN {day} ELSE '' END, '\",\"updated_at\":\"', {day}, '\",\"absolute_url\":\"', {url}, '\"}}')"
    lever = f"concat('{{\"text\":\"', title, '\",\"categories\":{{\"location\":\"', {place}, '\",\"department\":\"', CASE WHEN ord % 3 = 0 THEN '' ELSE department END, '\",\"team\":\"', CASE WHEN ord % 5 = 0 THEN '' ELSE 'Team' END, '\"}},\"createdAt\":', {ms}, ',\"hostedUrl\":\"', {url}, '\"}}')"
    ashby = f"concat('{{\"title\":\"', title, '\",\"isRemote\":', CASE WHEN location IS NULL THEN 'true' ELSE 'false' END, ',\"location\":\"', {place}, '\",\"department\":\"', department, '\",\"publishedAt\":\"', {day}, '\",\"jobUrl\":\"', {url}, '\"}}')"
    return f"SELECT site, ord, ats, CASE ats WHEN 'greenhouse' THEN {green} WHEN 'lever' THEN {lever} ELSE {ashby} END AS reply FROM job WHERE ats <> 'workday'".replace("{{", "{").replace("}}", "}")


@relation
def board_hint(d):
    """Boards that a site's pages point to, in order; a board answers with some jobs or none."""
    return f"""
SELECT c_custkey AS site, idx AS ord, {picked(d, ['greenhouse', 'lever', 'ashby', 'workday', 'icims'], '(c_custkey + idx % 3) % 5')} AS ats, concat('board', {d.text('c_custkey + idx % 3')}) AS token, CASE WHEN (c_custkey + idx) % 3 = 0 THEN 0 ELSE (c_custkey * 7 + idx) % 40 END AS jobs
FROM ({d.explode('c_custkey', 'customer', d.array("'a'", "'b'", "'c'", "'a'"), 'hint', 'idx')})"""


@relation
def company_candidate(d):
    k = "c_custkey"
    return f"""
SELECT {k} AS site, {k} % 3 <> 1 AS looked_up, concat('site', {d.text(k)}, '.com') AS domain, CASE WHEN {k} % 13 = 0 THEN NULL ELSE {k} END AS record_id, CASE {k} % 4 WHEN 0 THEN concat('https://www.site', {d.text(k)}, '.com/') WHEN 1 THEN 'other.de' ELSE concat('http://site', {d.text(k)}, '.com') END AS website,
  CASE WHEN {k} % 6 = 5 THEN 0 ELSE {k} % 700 END AS headcount, CASE WHEN {k} % 3 = 0 THEN NULL ELSE '501-1000' END AS size_range, CASE WHEN {k} % 8 = 7 THEN NULL ELSE {k} % 40 END AS indexed, CASE WHEN {k} % 2 = 0 THEN 'enrich_by_website' ELSE 'homepage_link' END AS method,
  concat(CASE WHEN {k} % 5 = 0 THEN 'Global Services ' ELSE 'Acme ' END, 'Site', {d.text(k)}) AS company_name, concat('Welcome to ', CASE WHEN {k} % 3 = 1 THEN 'Acme' ELSE 'us' END) AS title FROM customer"""


NAMES = [
    "Acme Corp logo", "acme-industries_300x86.png", "The Story of Beta", "Beta &amp; Sons", "How Gamma improved reach", "Delta case study", "star", "J. Smith", "Epsilon Employee App", "Zeta 2012", "microsoft", "eta holding gmbh", "2560px-Theta-logo", "Iota with", "Kappa Customer Story", "one two three four five six seven", "404", "lambda", "G2", "Xi Logo White",
]


BUNDLES = ["com.vendor{v}.customer.acme{n}.engage", "com.vendor{v}.app", "de.other.vendor{v}.beta{n}", "com.vendor{v}.customer.gamma{n}.ios", "org.unrelated.thing{n}", "com.vendor{v}.delta{n}.appstore.v2"]


@relation
def raw_name(d):
    return f"SELECT p_partkey AS id, {picked(d, NAMES, f'p_partkey % {len(NAMES)}')} AS raw FROM part"


@relation
def app(d):
    """Apps of vendors as several storefronts list them."""
    bundle = f"replace(replace({picked(d, BUNDLES, 'l_partkey % 6')}, '{{v}}', {d.text('l_suppkey')}), '{{n}}', {d.text('l_partkey % 50')})"
    return f"SELECT l_suppkey AS vendor, l_orderkey % 12 AS store, {bundle} AS bundle, concat('Seller ', {d.text('l_suppkey')}) AS seller, concat('https://www.site', {d.text('l_partkey % 300')}, '.com') AS seller_url, l_orderkey AS row_id FROM lineitem"


@relation
def story(d):
    """Story pages that an archive knows, and whether the live site still lists them."""
    slug = picked(d, ["case-study-acme-corp", "how-beta-grew", "gamma-employee-advocacy", "page", "delta-success-story-2020", "category"], "p_partkey % 6")
    return f"SELECT p_partkey AS id, concat('https://vendor.com/customers/', {slug}, '-', {d.text('p_partkey % 40')}, CASE WHEN p_partkey % 5 = 0 THEN '.html' ELSE '/' END) AS url, p_partkey % 3 = 0 AS live FROM part"


@relation
def probe(d):
    """What a candidate address answered."""
    k = "p_partkey"
    return f"""
SELECT {k} AS id, {picked(d, ['social', 'acmecorp', 'betaworks', 'gammatools', 'deltagroup', 'zeta'], f'{k} % 6')} AS token, {picked(d, ['Acme App', 'Beta Works', 'Gamma', 'Other'], f'{k} % 4')} AS app_name, {k} % 11 <> 3 AS robots_ok,
  CASE {k} % 7 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS status, ({k} * 997) % 9000 AS body_len, {picked(d, ['Acmecorp home', 'This domain is for sale', 'Beta Works - welcome', 'Something'], f'{k} % 4')} AS title, {picked(d, ['', 'hugedomains.com', 'owner.de'], f'{k} % 3')} AS redirected,
  {picked(d, ['.com', '.de', '.io', '.fr'], f'{k} % 4')} AS suffix, {k} % 20 AS name_id, {k} AS ord FROM part"""


@relation
def request(d):
    """One request a row: who, when, what it cost and how it went."""
    return f"""
SELECT event_id AS id, ts, {d.seconds('ts')} AS t, user_id AS client, concat('site', {d.text('user_id % 40')}, '.com') AS host, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'signup' THEN 10 ELSE 20 END AS cost,
  CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, CAST(floor(value * 100) AS BIGINT) AS bytes, (event_id * 37) % 4000 AS ms, event_type FROM events"""


@relation
def budget_call(d):
    """Requests as calls that cost credits: a run is a client's day; what a call is expected to cost is no less than it does."""
    return f"SELECT {d.month('ts')} AS month, concat({d.text('client')}, ' ', {d.day('ts')}) AS run, id, t, CASE cost WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 25 END AS projected, cost FROM request"


@relation
def job_event(d):
    """What became of a host's run, as it was told: asked for, ended, failed; and the state that a poll shows."""
    return "SELECT id, host, t, ts, CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'error' ELSE 'request' END AS kind, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'ready' ELSE 'error' END AS state FROM request"


@relation
def lead_form(d):
    """Forms that visitors sent, and the challenge that let them in."""
    return f"SELECT id, host, concat('Visitor ', {d.text('client')}) AS name, ts, event_type AS challenge FROM request WHERE event_type IN ('signup', 'purchase')"


@relation
def cache_entry(d):
    """Evidence files: a writable cache (0) and seeds (1, 2), written at some time, some of them failures."""
    return f"SELECT id, {urls.cache_key(d, "host")} AS cache_key, id % 3 AS source_ord, t AS started, status <> 200 AS failure FROM request"


@relation
def origin_attempt(d):
    return f"SELECT id, host, client, CASE WHEN id % 2 = 0 THEN concat('https://', host) ELSE concat('https://www.', host) END AS origin, status = 200 AS ok, t FROM request"


@relation
def evidence_bundle(d):
    """Evidence with the scores that somebody stored next to it."""
    return "SELECT *, concat('score of ', host) AS scoring, c.site * 2 AS lead_score FROM evidence c"


@relation
def evidence_note(d):
    """What a run could not observe of a site, as it noted it: with no, one or two notes on activity, some twice."""
    note = lambda *texts: d.array(*map(d.lit, texts))
    cases = [note("Homepage HTML: not retrievable.", "ATS: none."), note("ATS: none.", "Employee posting activity: not looked up.", "ATS: none.", "Sitemap: none."), note("Employee posting activity: error.", "Homepage HTML: not retrievable.", "Employee posting activity: not looked up."), note("Employee posting activity: error.")]
    return f"SELECT c_custkey AS site, CASE c_custkey % 5 {' '.join(f'WHEN {k} THEN {c}' for k, c in enumerate(cases))} ELSE {d.filt(cases[0], 'x', 'false')} END AS not_observed FROM customer"


@relation
def evidence_file(d):
    """Files of a folder of evidence: JSON documents, now and then one that was cut off, is empty, or is no object."""
    notes = f"concat('[', {d.join(d.each('n.not_observed', 'x', "concat('" + chr(34) + "', x, '" + chr(34) + "')"), ',')}, ']')"
    urls_ = f"CASE WHEN e.canonical_urls IS NULL THEN 'null' ELSE {d.text('e.canonical_urls')} END"
    body = f"concat('{{\"meta\":{{\"site\":', {d.text('e.site')}, ',\"normalized_host\":\"', e.host, '\"}},\"canonical_urls\":', {urls_}, ',\"robots\":{{\"present\":', CASE WHEN e.robots_fetched THEN 'true' ELSE 'false' END, '}},\"not_observed\":', {notes}, '}}')".replace("{{", "{").replace("}}", "}")
    return f"SELECT concat('calib/', e.host, '.json') AS path, CASE WHEN e.site % 13 = 5 THEN substring({body}, 1, 40) WHEN e.site % 101 = 7 THEN '' WHEN e.site % 103 = 8 THEN '[1]' ELSE {body} END AS body FROM evidence e JOIN evidence_note n ON e.site = n.site"


@relation
def narration(d):
    """Sentences of findings, and how a model retold them."""
    return f"SELECT site, 'llms_txt' AS finding, concat('Of 506 pages, ', {d.text('site % 50')}, ' had 1,200 links') AS source, concat('Only ', {d.text('site % 60')}, ' of 506 pages had 1,200 links', CASE WHEN site % 17 = 3 THEN ', by hiring_pressure' ELSE '' END) AS rewrite FROM evidence"


@relation
def band_probe(d):
    """Values at and between the points of bands."""
    return "SELECT o_orderkey AS id, o_orderkey % 6000 AS pages, o_orderkey % 101 AS share, o_orderkey % 70 / 10.0 AS rate FROM orders"


@relation
def captured_lead(d):
    return f"SELECT c_custkey AS site, concat('site', {d.text('c_custkey')}, '.com') AS domain, c_custkey % 5 <> 4 AS has_evidence FROM customer"


@relation
def contact_form(d):
    return "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'a@b.co' WHEN 1 THEN 'bad@' WHEN 2 THEN ' x@y.com ' WHEN 3 THEN '' ELSE 'no at.com' END AS mail, repeat(c_name, 2) AS name FROM customer"


@relation
def challenge(d):
    """Challenges as they were answered: set up or not, the visitor's token, the service's reply."""
    return "SELECT c_custkey AS id, c_custkey % 7 <> 0 AS configured, CASE WHEN c_custkey % 5 <> 1 THEN c_name END AS token, c_custkey % 6 <> 2 AS reachable, c_custkey % 4 <> 3 AS verified FROM customer"


@relation
def competitor(d):
    """Vendors that compete with the client."""
    return "SELECT s_name AS name FROM supplier"


@relation
def asked_domain(d):
    """Domains that somebody asks the index for."""
    return f"SELECT concat('site', {d.text('c_custkey')}, '.com') AS domain FROM customer"


@relation
def rival(d):
    """The competitors that a company's record names, in order."""
    return f"SELECT site, ord, concat('Rival ', {d.text('ord')}) AS name FROM ({d.explode('c_custkey AS site', 'customer', d.seq('1', '1 + c_custkey % 12'), 'n', 'ord')})"


@relation
def store_page(d):
    """A vendor's page in an app store."""
    return f"SELECT l_suppkey AS vendor, concat('<a href=\"/store/apps/details?id=com.vendor', {d.text('l_suppkey')}, '.app', {d.text('l_partkey % 9')}, '\">x</a><a href=\"/store/apps/details?id=org.x', {d.text('l_partkey % 7')}, '&hl=en\">') AS html FROM lineitem"


@relation
def vendor_prefix(d):
    """Prefixes of app ids that a vendor uses, of several lengths."""
    each = lambda x: f"SELECT s_suppkey AS vendor, {x} AS prefix FROM supplier"
    n = d.text("s_suppkey")
    return " UNION ALL ".join(each(x) for x in (f"concat('com.vendor', {n}, '.customer.')", f"concat('com.vendor', {n}, '.')", f"concat('vendor', {n}, '.')"))


@relation
def vendor_rule(d):
    """By what a vendor's apps are known: the prefix of their ids, for some also a part of the seller's name."""
    n = d.text("s_suppkey")
    return f"SELECT s_suppkey AS vendor, concat('vendor', {n}) AS vendor_key, concat('com.vendor', {n}, '.') AS prefix, CASE WHEN s_suppkey % 3 = 0 THEN concat('seller', {n}) END AS seller_part FROM supplier"


@relation
def vendor_name(d):
    """Names of vendors, with what some of them add in brackets."""
    return f"SELECT s_suppkey AS vendor, {picked(d, ['Delta', 'Gamma Improved (by Acme)', 'Lambda', 'G2', 'Kappa'], 's_suppkey % 5')} AS name FROM supplier"


@relation
def logo_page(d):
    return f"SELECT id, concat('<img src=\"https://cdn.refs.com/Company.logo/', {d.sub('lower(raw)', '[^a-z0-9]+', '-')}, '_12.png\" class=\"l\" alt=\"', raw, '\"><img src=\"/x.png\">') AS html FROM raw_name"


@relation
def resolved_cache(d):
    """Names that were resolved before."""
    return "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0"


@relation
def wanted_site(d):
    return f"SELECT concat('site', {d.text('c_custkey % 60')}, '.com') AS host FROM customer"


@relation
def language_try(d):
    """Tries for an English page: declared alternates, then paths by convention."""
    return f"SELECT id, host, status, CASE WHEN event_type = 'view' THEN 'hreflang' ELSE 'path' END AS how, {picked(d, ['/en/', '/en-us/', '/en-gb/'], 'id % 3')} AS candidate FROM request"


@relation
def llms_reply(d):
    """What a text file that is asked for by convention answers: a page, the file, nothing."""
    return "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN concat('# Site ', url, chr(10), 'line', chr(10), chr(10), 'more') ELSE '' END AS body FROM pages"
