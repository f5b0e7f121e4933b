"""A site graded from its raw inputs: one hand-made site, and what is missing from its evidence when an input is."""

import pytest

from tessellate.operators import assembly  # noqa: F401  registers the relations
from tessellate.plans import registry

SECTIONS = ["blog", "guides", "news", "customers", "events", "podcasts", "recipes"]


def page(title=True, image="https://cdn.acme.com/a.png", author="Ann", share=True, types='"Article"'):
    head = f'<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="{image}"><meta name="twitter:card" content="summary"><link rel="canonical" href="https://acme.com/x">' if title else ""
    data = f'<script type="application/ld+json">{{"@type":[{types}],"author":{{"name":"{author}"}}}}</script>' if author else ""
    return f"<html><head>{head}{data}</head><body>{'<a href=https://twitter.com/intent/tweet?x>t</a>' if share else ''}<p>{'word ' * 300}</p></body></html>"


def inputs(spark):
    urls = [f"https://www.acme.com/{SECTIONS[k % 7]}/entry-{k}" for k in range(70)] + ["https://www.acme.com/life-at-acme/day", "https://www.acme.com/culture/inside-acme", "https://www.acme.com/careers/all", "https://www.acme.com/odd/thing"]
    maps = [(k, "www.acme.com", u, f"2001-0{1 + k % 7}-11 10:00:00", 0) for k, u in enumerate(urls)]
    sample = [u for k, u in enumerate(urls) if k < 72]
    pages = [(k, u, page(author=None if k % 2 else f"Ann {k % 4}")) for k, u in enumerate(sample)]
    pages += [(900, "https://acme.com/", page(types='"Organization","WebSite","Brand"')), (901, "https://www.acme.com/careers", "<html><h2>Head of Employer Brand</h2><h2>Software Engineer</h2></html>"), (902, "https://other.com/", page())]
    posts = [(1, e, 100 * e + k, "own" if k else "company", "2024-04-01 00:00:00", e % 3 == 0, k > 0) for e in range(40) for k in range(3)]
    stamp = lambda df, c: df.selectExpr(f"* except({c})", f"cast({c} as timestamp_ntz) as {c}")
    return {
        "sitemap_url": stamp(spark.createDataFrame(maps, "pos long, site_host string, loc string, lastmod string, doc_no long"), "lastmod"),
        "page_html": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "robots_txt": spark.createDataFrame([(1, "acme.com", "User-agent: *\nAllow: /\nUser-agent: GPTBot\nDisallow: /\n")], "site long, host string, body string"),
        "job": stamp(spark.createDataFrame([(1, k, "Social Media Manager" if k < 2 else "Accountant", "Ops", "Rome", "2001-07-30 00:00:00", "We use Vendoro here", "lever") for k in range(5)], "site long, ord long, title string, department string, location string, posted_at string, description string, ats string"), "posted_at"),
        "company_post": stamp(spark.createDataFrame(posts, "company long, employee long, post_id long, kind string, ts string, is_decision_maker boolean, is_post boolean"), "ts"),
        "competitor": spark.createDataFrame([("Vendoro",)], "name string"),
    }


@pytest.fixture(scope="module")
def tables(spark):
    return inputs(spark)


def evidence(spark, tables, *without, **changed):
    given = {k: v for k, v in (tables | changed).items() if k not in without}
    (row,) = registry.over(spark, "assembled_evidence", **given).collect()
    return row


@pytest.fixture(scope="module")
def whole(spark, tables):
    return evidence(spark, tables)


def test_all_inputs(spark, tables, whole):
    assert (whole.site, whole.host, whole.blocked_at_root) == (1, "acme.com", False)
    assert (whole.canonical_urls, whole.total_urls, whole.unclassified_raw, whole.shareable_raw, whole.sampler_pool) == (74, 74, 1, 72, 72)
    assert (whole.sections, whole.culture_urls, whole.careers_urls, whole.story_urls) == (8, 2, 1, 2)
    assert (whole.pages_attempted_raw, whole.pages_retrieved, whole.og_image, whole.share_affordance, whole.sampled_image) == (8, 8, 100, 100, "ok")
    assert (whole.home, whole.home_title, whole.home_image, whole.home_types) == (True, True, "ok", 3)
    assert (whole.careers_tried, whole.careers_ok, whole.careers_js_only) == (1, True, False)
    assert (whole.ats_reqs, whole.board_reqs, whole.posted_30d, whole.buyer_roles, whole.competitor_mentioned) == (5, None, 5, 2, True)
    assert (whole.index_status, whole.employees_indexed, whole.employees_posted, whole.makers_posted, whole.company_posts) == ("resolved", 40, 40, 14, 40)
    (grade,) = registry.over(spark, "overall_grade", **tables).collect()
    assert grade.gradeable and grade.withheld_reason is None
    # Supply: 72 pages of 8 sections; 97.3 % of the site; all dates within a year.
    assert grade.content_supply == pytest.approx(10 + 42 / 70 * 8 + 30 + 30 + 8)
    assert grade.shareability == 100
    (lead,) = registry.over(spark, "lead_score", **tables).collect()
    assert lead.tier is not None and lead.pressure > 0
    assert {r.finding for r in registry.over(spark, "findings", **tables).collect()} >= {"ai_agents_blocked", "homepage_og_ok"}


def differs(a, b):
    return {c for c in a.asDict() if a[c] != b[c]}


def test_without_sitemaps(spark, tables, whole):
    got = evidence(spark, tables, "sitemap_url")
    nulls = ["canonical_urls", "sections", "culture_urls", "careers_urls", "story_urls", "author_urls", "distinct_locales", "shareable_raw", "sampler_pool", "dated", "og_image", "named_author", "byline_people"]
    assert all(got[c] is None for c in nulls) and (got.total_urls, got.pages_attempted_raw, got.recency_measurable) == (0, 0, False)
    assert got.home and got.ats_reqs == 5 and got.employees_indexed == 40
    (grade,) = registry.over(spark, "overall_grade", **{k: v for k, v in tables.items() if k != "sitemap_url"}).collect()
    assert not grade.gradeable and grade.withheld_reason == "categories not observed" and grade.content_supply is None and grade.ai_discoverability is not None


def test_without_pages(spark, tables, whole):
    got = evidence(spark, tables, "page_html")
    assert (got.pages_attempted_raw, got.pages_retrieved, got.home, got.careers_tried) == (8, 0, False, 0)
    assert all(got[c] is None for c in ("og_image", "canonical", "named_author", "article_schema", "sampled_image", "home_title", "home_types", "careers_ok", "byline_people"))
    assert differs(got, whole) == {"pages_retrieved", "og_image", "og_title", "og_description", "share_affordance", "twitter_card", "canonical", "named_author", "article_schema", "sampled_image", "byline_people", "byline_top_share", "home", "home_title", "home_description", "home_image", "home_types", "js_rendered", "careers_tried", "careers_ok", "careers_js_only"}


def test_without_a_robots_file(spark, tables, whole):
    sites = spark.createDataFrame([(1, "acme.com", "acme.com")], "site long, host string, key string")
    got = evidence(spark, tables, "robots_txt", site_list=sites)
    assert differs(got, whole) == {"robots_fetched"} and not got.robots_fetched
    (grade,) = registry.over(spark, "overall_grade", site_list=sites, **{k: v for k, v in tables.items() if k != "robots_txt"}).collect()
    assert grade.ai_discoverability is None and not grade.gradeable
    named = registry.over(spark, "site_list", **{k: v for k, v in tables.items() if k != "robots_txt"}).collect()
    assert [(r.host, r.key) for r in named] == [("www.acme.com", "acme.com")] and named[0].site > 0


def test_without_jobs_the_careers_page_is_counted(spark, tables, whole):
    got = evidence(spark, tables, "job")
    assert differs(got, whole) == {"ats_reqs", "board_reqs", "posted_30d", "buyer_roles", "competitor_mentioned"}
    assert (got.ats_reqs, got.board_reqs, got.posted_30d, got.buyer_roles, got.competitor_mentioned) == (None, 2, None, 1, None)


def test_without_posts(spark, tables, whole):
    got = evidence(spark, tables, "company_post")
    assert differs(got, whole) == {"index_status", "employees_indexed", "employees_posted", "makers_posted", "company_posts"}
    assert got.index_status == "not_looked_up" and got.employees_indexed is None


def test_a_blocked_site_has_only_its_robots_file(spark, tables):
    for body in ("User-agent: *\nDisallow: /", f"User-agent: *\nAllow: /\nUser-agent: {assembly.OWN_AGENT}\nDisallow: /\n"):
        blocked = spark.createDataFrame([(1, "acme.com", body)], "site long, host string, body string")
        got = evidence(spark, tables, robots_txt=blocked)
        assert got.blocked_at_root and got.canonical_urls is None and not got.home and got.ats_reqs is None and got.employees_indexed is None and got.pages_attempted_raw == 0
    freed = spark.createDataFrame([(1, "acme.com", "User-agent: *\nDisallow: /\nUser-agent: tessellate\nAllow: /\n")], "site long, host string, body string")
    assert not evidence(spark, tables, robots_txt=freed).blocked_at_root


def test_files_are_not_mixed_in(spark, tables):
    with pytest.raises(ValueError, match="customer"):
        registry.over(spark, "overall_grade", evidence_bundle=tables["job"])
