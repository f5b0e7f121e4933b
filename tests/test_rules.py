"""Rules on hand-made tables: the caller's DataFrames in place of the test tables."""

import json
import random

import pytest

from tessellate.functions import fixed, urls
from tessellate.operators import hiring, pages, sitemaps
from tessellate.plans import registry
from tessellate.plans.dialect import SPARK


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_relations_read_what_is_given_and_leave_the_session_alone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    spark.range(3).createOrReplaceTempView("orders")
    try:
        typed = spark.createDataFrame([(1, " HTTPS://WWW.Acme.com./x "), (2, "12345")], "id long, typed string")
        assert rows(registry.over(spark, "normalize_domain", typed_domain=typed)) == [(1, "www.acme.com"), (2, None)]
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo" and spark.table("orders").count() == 3
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("_")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.catalog.dropTempView("orders")
    with pytest.raises(ValueError, match="typed_domain|customer"):
        registry.over(spark, "normalize_domain")


def robots(spark, *bodies):
    return spark.createDataFrame([(k, f"h{k}.com", b) for k, b in enumerate(bodies)], "site long, host string, body string")


def test_agents_are_weighed(spark):
    blocked = "User-agent: GPTBot\nDisallow: /\nUser-agent: Googlebot\nDisallow: /\n"
    got = {r.site: r for r in registry.over(spark, "robots_facts", robots_txt=robots(spark, "User-agent: *\nAllow: /", blocked, "User-agent: *\nDisallow: /")).collect()}
    weights = [fixed.ACCESS_WEIGHTS[kind] for _, kind in fixed.AGENTS]
    assert got[0].access == 1 and got[2].access == 0 and got[2].agents_blocked == len(fixed.AGENTS)
    assert got[1].access == pytest.approx(1 - (1 + 3) / sum(weights)) and got[1].agents_blocked == 2


def test_contradicted_signals_name_the_agents(spark):
    body = "User-agent: OAI-SearchBot\nDisallow: /\n\nUser-agent: *\nContent-Signal: search=yes, ai-train=no\nAllow: /\n"
    (found,) = registry.over(spark, "signal_contradictions", robots_txt=robots(spark, body)).collect()
    assert (found.n_blocked, found.blocked_agents) == (1, "OAI-SearchBot")
    parsed = registry.over(spark, "robots_parse", robots_txt=robots(spark, "User-agent: *\nDisallow: /a\nAllow: /a/b\nNoindex: /c")).collect()
    assert [r.rule_list for r in parsed] == ["disallow: /a | allow: /a/b"]
    assert [(r.field, r.value) for r in registry.over(spark, "robots_unknown", robots_txt=robots(spark, "User-agent: *\nNoindex: /c")).collect()] == [("noindex", "/c")]


def test_activity_window_is_ninety_days(spark):
    posts = [(1, 10, "2024-01-14 23:59:59"), (1, 11, "2024-01-16 00:00:00"), (1, 12, "2024-04-01 00:00:00"), (1, 13, "2023-01-01 00:00:00")]
    table = spark.createDataFrame([(c, e, k, "own", t, True, True) for k, (c, e, t) in enumerate(posts)], "company long, employee long, post_id long, kind string, ts string, is_decision_maker boolean, is_post boolean").selectExpr("* except(ts)", "cast(ts as timestamp_ntz) as ts")
    (r,) = registry.over(spark, "company_counts", company_post=table).collect()
    assert (r.employees_indexed, r.employees_posted, r.makers_posted) == (4, 2, 2)
    assert "- 30 * 86400" in hiring.counts_since(SPARK, days=30)


def test_board_replies_of_three_interfaces(spark):
    green = {"title": "A", "location": {"name": "Rome"}, "departments": [{"name": "Ops"}, {"name": ""}, {"name": "IT"}], "first_published": "2024-02-03T04:05:06Z", "updated_at": "2024-03-01", "absolute_url": "u1"}
    lever = {"text": "B", "categories": {"location": "Oslo", "department": "Eng", "team": "Web"}, "createdAt": 1706918400000, "hostedUrl": "u2"}
    ashby = [{"title": "C", "isRemote": True, "department": "Law", "publishedAt": "2024-05-06"}, {"title": "D", "location": "Bern", "isRemote": True, "team": "X", "jobUrl": "u4"}]
    replies = [(1, 1, "greenhouse", green), (1, 2, "lever", lever), (1, 3, "ashby", ashby[0]), (1, 4, "ashby", ashby[1])]
    table = spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in replies], "site long, ord long, ats string, reply string")
    got = [tuple(r)[3:] for r in registry.over(spark, "jobs_normalize", board_reply=table).orderBy("ord").collect()]
    assert got == [("A", "Rome", "Ops, IT", "2024-02-03", "u1"), ("B", "Oslo", "Eng / Web", "2024-02-03", "u2"), ("C", "Remote", "Law", "2024-05-06", None), ("D", "Bern", "X", None, "u4")]


def test_job_hosts_of_the_pages_own_name(spark):
    html = "".join(f'<a href="https://{h}/x/">j</a>' for h in ("jobs.acme.com", "careers.other.com", "acme.com", "jobs.acmecareers.net", "www.acme.com"))
    table = spark.createDataFrame([(1, "https://www.acme.com/about", html)], "page_id long, url string, html string")
    assert [r.link for r in registry.over(spark, "job_subdomains", page_html=table).orderBy("nth").collect()] == ["https://jobs.acme.com/x", "https://jobs.acmecareers.net/x"]


def test_departments_by_site(spark):
    jobs = [(1, k, "t", d, p, None, "", "lever") for k, (d, p) in enumerate([("Ops", "Rome"), ("Eng", None), ("Eng", "Rome")])] + [(2, 9, "t", None, "Bern", None, "", "lever")]
    table = spark.createDataFrame(jobs, "site long, ord long, title string, department string, location string, posted_at timestamp_ntz, description string, ats string")
    got = rows(registry.over(spark, "jobs_departments", job=table).select("site", "kind", "name", "n", "nth"))
    assert got == [(1, "department", "Eng", 2, 1), (1, "department", "Ops", 1, 2), (1, "location", "Rome", 2, 1), (1, "location", "unspecified", 1, 2), (2, "department", "unspecified", 1, 1), (2, "location", "Bern", 1, 1)]


def test_vendor_names_inside_longer_ones_are_dropped(spark):
    names = spark.createDataFrame(list(enumerate(["DSMN8 Website", "Dropline Vendoro Kit", "Vendoro", "Acme Corp", "Ven", "microsoft teams", "Erik van Dyk", "4.5 stars", "E.ON", "Barry Callebaut customer story"])), "id long, raw string")
    vendors = spark.createDataFrame([(1, "Vendoro (EMEA)"), (2, "Ven")], "vendor long, name string")
    got = {r.name for r in registry.over(spark, "drop_vendor_names", raw_name=names, vendor_name=vendors).collect()}
    assert got == {"Acme Corp", "E.ON", "Barry Callebaut"}


def test_competitors_in_titles_and_texts(spark):
    jobs = [(1, 1, "Engineer", "We use Acme Hub daily"), (1, 2, "Acme Hub admin", "none"), (1, 3, "x", "AcmeHub Acme Hubs"), (2, 4, "x", "acme hub"), (2, 5, "y", "C++ (beta)")]
    table = spark.createDataFrame(jobs, "site long, ord long, title string, description string")
    vendors = spark.createDataFrame([("Acme Hub",), ("Beta)",), ("Zed",)], "name string")
    assert rows(registry.over(spark, "competitor_mentions", job=table, competitor=vendors)) == [(1, "Acme Hub", 2, "Engineer | Acme Hub admin"), (2, "Acme Hub", 1, "x"), (2, "Beta)", 1, "y")]


def test_structured_data_of_any_depth():
    deep = {"@type": "Article", "author": [{"name": " Ann "}, "Bob"], "datePublished": "2024"}
    for _ in range(200):
        deep = {"x": [1, {"y": deep}]}
    assert pages.jsonld_facts(json.dumps(deep)) == [("@type", "Article"), ("author", "Ann"), ("author", "Bob"), ("datePublished", "2024")]
    assert pages.jsonld_facts("{bad") is None and pages.jsonld_facts("[" * 100000) is None and pages.jsonld_facts("3") == []
    own_first = {"part": {"headline": "inner", "dateModified": "1"}, "headline": "outer"}
    assert [v for k, v in pages.jsonld_facts(json.dumps(own_first)) if k == "headline"] == ["outer", "inner"]


def walk(documents, links, seeds, denied, most):
    """The walk as a queue."""
    out = []
    for host, seed in seeds:
        queue, seen, fetched = [seed], set(), 0
        while queue and fetched < most:
            url = queue.pop(0)
            if url in seen:
                continue
            seen.add(url)
            kind = "skipped" if url in denied else documents.get(url, "error")
            fetched += kind != "skipped"
            out.append((host, url, kind))
            if kind == "index":
                queue += [x for x in links.get(url, []) if x not in seen]
    return sorted(out)


def test_sitemap_walks_end_and_keep_their_order(spark):
    rnd = random.Random(3)
    for most in (60, 7):
        names = [f"d{k}" for k in range(25)]
        documents = {n: rnd.choice(["index", "index", "urlset", "unknown"]) for n in names[:22]}
        documents["d0"] = "index"
        links = {n: rnd.choices(names, k=4) for n in names if documents.get(n) == "index"}  # cycles and diamonds
        denied = {"d5"}
        entries = [(n, True, k, x) for n, v in links.items() for k, x in enumerate(v)] + [(n, False, k, f"u{rnd.randrange(30)}") for n in names if documents.get(n) == "urlset" for k in range(5)]
        frames = [
            spark.createDataFrame([("h", "d0", 0)], "site_host string, url string, ord int"), spark.createDataFrame(list(documents.items()), "url string, kind string"),
            spark.createDataFrame(entries, "url string, is_index boolean, idx int, loc string"), spark.createDataFrame([(x,) for x in denied], "url string"),
        ]
        got = sitemaps.walked(*frames, most=most).collect()
        assert sorted((r.site_host, r.url, r.kind) for r in got if r.kind != "left") == walk(documents, links, [("h", "d0")], denied, most)
        read = {r.url for r in got if r.kind == "urlset"}
        assert sum(r.new_urls for r in got) == len({x for n, index, _, x in entries if not index and n in read})
    capped = sitemaps.walked(*frames, most_urls=1).collect()
    assert sum(r.kind == "urlset" for r in capped) <= 1


def test_first_words_are_the_patterns():
    assert sorted(urls.spelled("case-?stud(y|ies)")) == ["case-studies", "case-study", "casestudies", "casestudy"]
    assert urls.spelled("a[0-9]") is None
    words, others = urls.first_words()
    assert words["blog"] == words["insights"] and words["store"] > words["stores"] and len(others) < 20


def test_a_site_is_scored_from_its_evidence(spark):
    base = registry.over(spark, "evidence", "/root/testdata/sf0.001").limit(1)
    site = base.selectExpr("* except(blocked_at_root, canonical_urls, total_urls, unclassified_raw, shareable_raw, sampler_pool)", "false as blocked_at_root", "500L as canonical_urls", "600L as total_urls", "400e0 as unclassified_raw", "200e0 as shareable_raw", "CAST(NULL AS BIGINT) as sampler_pool")
    (r,) = registry.over(spark, "overall_grade", evidence=site, robots_txt=robots(spark, "User-agent: *\nAllow: /").selectExpr("site + (select 0) as site", "host", "body")).collect()
    assert not r.gradeable and r.withheld_reason == "structure not readable" and r.confidence == "reduced"
