"""More rules on hand-made tables: addresses, notes, vendors, pages, caps."""

import re

import pytest

from tessellate.functions import urls
from tessellate.operators import incumbents, sampling, sitemaps
from tessellate.plans import registry
from tessellate.plans.dialect import SPARK

# The reference resolution examples of RFC 3986, 5.4, for the base http://a/b/c/d;p?q.
NORMAL = "g:h=g:h g=http://a/b/c/g ./g=http://a/b/c/g g/=http://a/b/c/g/ /g=http://a/g //g=http://g/ ?y=http://a/b/c/d;p?y g?y=http://a/b/c/g?y #s=http://a/b/c/d;p?q#s g#s=http://a/b/c/g#s g?y#s=http://a/b/c/g?y#s ;x=http://a/b/c/;x g;x=http://a/b/c/g;x g;x?y#s=http://a/b/c/g;x?y#s =http://a/b/c/d;p?q .=http://a/b/c/ ./=http://a/b/c/ ..=http://a/b/ ../=http://a/b/ ../g=http://a/b/g ../..=http://a/ ../../=http://a/ ../../g=http://a/g"
ABNORMAL = "../../../g=http://a/g ../../../../g=http://a/g /./g=http://a/g /../g=http://a/g g.=http://a/b/c/g. .g=http://a/b/c/.g g..=http://a/b/c/g.. ..g=http://a/b/c/..g ./../g=http://a/b/g ./g/.=http://a/b/c/g/ g/./h=http://a/b/c/g/h g/../h=http://a/b/c/h http:g=http:g g?y/./x=http://a/b/c/g?y/./x g?y/../x=http://a/b/c/g?y/../x g#s/./x=http://a/b/c/g#s/./x g#s/../x=http://a/b/c/g#s/../x"
PARAMETERS = [("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y")]


def test_references_of_the_rfc(spark):
    cases = [tuple(x.split("=", 1)) for x in f"{NORMAL} {ABNORMAL}".split(" ")] + PARAMETERS
    assert len(cases) == 42
    refs = spark.createDataFrame([(k, "http://a/b/c/d;p?q", r) for k, (r, _) in enumerate(cases)], "id long, base string, href string")
    got = {r.id: r.url for r in registry.over(spark, "url_resolution", reference=refs).collect()}
    # //g: a web address without a path gets one.
    assert [got[k] for k in range(42)] == [w for _, w in cases]


def test_references_on_pages(spark):
    cases = [("https://x.com", "y", "https://x.com/y"), ("https://x.com?q", "?z", "https://x.com/?z"), ("https://x.com/a", "mailto:b@c.d", "mailto:b@c.d"), ("https://x.com/a", "HTTPS://Y.com", "HTTPS://Y.com/"), ("https://x.com/a/b", "https://y.com/c/../d", "https://y.com/d"), ("https://x.com/a/b", "https://y.com/c/.d", "https://y.com/c/.d"), ("https://x.com/é/b", "../ü", "https://x.com/ü")]
    refs = spark.createDataFrame([(k, b, h) for k, (b, h, _) in enumerate(cases)], "id long, base string, href string")
    assert [r.url for r in registry.over(spark, "url_resolution", reference=refs).orderBy("id").collect()] == [w for _, _, w in cases]
    page = spark.createDataFrame([(1, "https://x.com/a/b.html", '<link rel="alternate" hreflang="de" href="../de/?x#y">')], "page_id long, url string, html string")
    assert [r.href for r in registry.over(spark, "hreflang_alternates", page_html=page).collect()] == ["https://x.com/de/?x#y"]


def test_addresses_of_both_families(spark):
    blocked = ["::", "::1", "0:0:0:0:0:0:0:1", "fe80::1", "FEBF::", "fc00::", "fdff::1", "ff02::1", "2001:db8::", "::ffff:10.0.0.1", "::ffff:a00:1", "::127.0.0.1", "1:2:3", "1::2::3", ":::", "g::", "12345::", "1:2:3:4:5:6:7:8:9", "::256.1.1.1", "10.0.0.1", "1.2.3", ""]
    free = ["2001:4860:4860::8888", "fec0::1", "2001:db9::1", "::ffff:8.8.8.8", "::8.8.8.8", "1:2:3:4:5:6:7:8", "1::", "64:ff9b::8.8.8.8", "fb00::", "8.8.8.8"]
    table = spark.createDataFrame(list(enumerate(blocked + free)), "id long, ip string")
    got = {r.ip: r.blocked for r in registry.over(spark, "ip_is_blocked", address=table).collect()}
    assert [x for x in blocked if not got[x]] == [] and [x for x in free if got[x]] == []
    words = spark.sql(urls.with_ipv6_words(SPARK, "(SELECT '1:2::ffff:1.2.3.4' AS ip)", "ip", "ip")).first()
    assert tuple(words)[1:] == (0x10002, 0, 0xFFFF, 0x01020304)


def test_notes_are_replaced_by_prefix(spark):
    a = "Employee posting activity:"
    notes = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["x", f"{a} old", "y"]), (3, [f"{a} old", f"{a} older"]), (4, [f"{a} old", "z"]), (5, [])], "site long, not_observed array<string>")
    status = spark.createDataFrame([(1, "high"), (2, "not_looked_up"), (3, "low"), (4, "medium"), (5, "not_looked_up")], "site long, status string")
    why = spark.createDataFrame([(3, "no headcount")], "site long, reason string")
    got = {r.site: r.notes for r in registry.over(spark, "noted_evidence", evidence_note=notes, attach_activity=status, rejection_reason=why).collect()}
    unread = f"{a} not looked up, so the category rests on the website alone."
    assert got == {1: ["x", "y"], 2: ["x", "y", unread], 3: [f"{a} no company matched (no headcount)."], 4: ["z"], 5: [unread]}


def test_vendors_are_found_without_being_told(spark):
    apps = spark.createDataFrame([("com.acme.app", "X"), ("COM.Acme.Pro", "X"), ("org.z", "The Vend-Oro GmbH"), ("org.y", "abcd co"), ("com.acm", "x")], "bundle string, seller string")
    rules = spark.createDataFrame([(1, "com.acme.", None), (2, "com.", "vendoro"), (3, "nl.", "abcd"), (4, "Com.ACME.p", "")], "vendor long, prefix string, seller_part string")
    df = registry.over(spark, "vendor_match", app=apps, vendor_rule=rules)
    assert {(r.bundle, r.vendor) for r in df.collect()} == {("com.acme.app", 1), ("COM.Acme.Pro", 1), ("com.acme.app", 2), ("COM.Acme.Pro", 2), ("com.acm", 2), ("COM.Acme.Pro", 4), ("org.z", 2)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and "Contains" not in plan


def test_capitals_after_any_sign(spark):
    names = ["o'neil", "e.on energy", "at&t", "ben-jerry's", "3m co"]
    got = [spark.sql(f"SELECT {incumbents.title_cased(SPARK, 'x')} AS y FROM (SELECT \"{n}\" AS x)").first().y for n in names]
    assert got == ["O'Neil", "E.On Energy", "At&T", "Ben-Jerry'S", "3m Co"]


def test_boards_names_and_titles_of_pages(spark):
    html = '<a href="https://Acme.wd5.myworkdayjobs.com/Ext_1"></a><a href="https://acme.wd3.myworkdayjobs.com/B"></a><a href="https://solo.wd1.myworkdayjobs.com/"></a><a href="https://linkedin.com/company/caf%C3%A9%20x/"></a><a href="https://linkedin.com/company/100%/"></a><title>T</title><meta content="Name" property="og:site_name">'
    page = spark.createDataFrame([(1, "https://x.com/", html)], "page_id long, url string, html string")
    assert sorted((r.token, r.datacenter, r.board or None) for r in registry.over(spark, "ats_detect", page_html=page).collect()) == [("acme", "wd5", "Ext_1"), ("solo", "wd1", None)]
    assert {r.shorthand for r in registry.over(spark, "company_shorthands", page_html=page).collect()} == {"café x", "100%"}
    assert registry.over(spark, "site_title", page_html=page).first().site_title == "T Name"


def test_an_index_that_is_not_loaded_is_no_answer(spark):
    sf = "/root/testdata/sf0.001"
    empty = registry.over(spark, "claim", sf).limit(0)
    got = {r.incumbent_status for r in registry.over(spark, "lead_intel_row", sf, claim=empty).collect()}
    assert got == {"no_index_loaded", None}


def test_a_walk_is_cut_within_a_document(spark):
    entries = [("root", True, 0, "a"), ("root", True, 1, "b"), ("root", True, 2, "c")] + [(u, False, k, f"{u}{k % 4}") for u in "abc" for k in range(6)] + [("b", False, 9, "a1#x")]
    frames = [spark.createDataFrame([("h", "root", 0)], "site_host string, url string, ord int"), spark.createDataFrame([("root", "index"), ("a", "urlset"), ("b", "urlset"), ("c", "urlset")], "url string, kind string"), spark.createDataFrame(entries, "url string, is_index boolean, idx int, loc string"), spark.createDataFrame([], "url string")]
    walk = sitemaps.walked(*frames, most_urls=6)
    assert {r.url: (r.kind, r.new_urls) for r in walk.collect()} == {"root": ("index", 0), "a": ("urlset", 4), "b": ("urlset", 2), "c": ("left", 0)}
    assert sorted((r.url, r.loc) for r in sitemaps.collected(walk, frames[2]).collect()) == [("a", "a0"), ("a", "a1"), ("a", "a2"), ("a", "a3"), ("b", "b0"), ("b", "b1")]


def shuffled(n, k, name):
    x, order = sampling.seed(name), list(range(n))
    for i in range(n - 1, 0, -1):
        x = sampling.stepped(x)
        j = x * (i + 1) >> 32
        order[i], order[j] = order[j], order[i]
    return sorted(order[:k])


@pytest.mark.parametrize("lanes,depth,few", [(1024, 1024, 1 << 14), (8, 4, 0)])
def test_draws_are_those_of_the_whole_shuffle(monkeypatch, lanes, depth, few):
    monkeypatch.setattr(sampling, "LANES", lanes), monkeypatch.setattr(sampling, "DEPTH", depth), monkeypatch.setattr(sampling, "FEW", few)
    for n in [*range(1, 70), 500, 2049]:
        for k in (0, 1, 8, n):
            assert sampling.drawn(n, k, f"site{n}.com::blog") == shuffled(n, k, f"site{n}.com::blog")


def test_a_draw_of_many_places_needs_little_memory():
    assert sampling.drawn(3_000_000, 8, "big.com::news") == shuffled(3_000_000, 8, "big.com::news")


def test_no_window_over_a_whole_host(spark):
    located = spark.createDataFrame([("h", f"u{k:03}", k) for k in range(100)], "host string, loc string, pos long")
    df = registry.over(spark, "stride_sample", url_parsed=located)
    assert sorted(r.loc for r in df.collect()) == [f"u{k:03}" for k in range(0, 100, 5)]
    windows = re.findall(r"windowspecdefinition\([^)]*", df._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all(w.startswith("windowspecdefinition(_range#") for w in windows if "loc#" in w)  # the other one is over a row a range


def test_a_board_counts_once(spark):
    hints = spark.createDataFrame([(1, 0, "icims", "a", 9), (1, 1, "lever", "x", 0), (1, 2, "icims", "a", 9), (1, 3, "lever", "x", 7), (1, 4, "lever", "y", 3)], "site long, ord int, ats string, token string, jobs int")
    assert [tuple(r) for r in registry.over(spark, "jobs_first_source", board_hint=hints).collect()] == [(1, "lever", 3, 3, 1)]


def test_broken_evidence_files_are_named(spark):
    files = spark.createDataFrame([("a", '{"meta":{"site":1,"normalized_host":"x.com"},"robots":{"present":true},"not_observed":["n"]}'), ("b", '{"meta":{"si'), ("c", ""), ("d", None)], "path string, body string")
    assert [(r.site, r.host, r.canonical_urls, r.robots_fetched, r.notes) for r in registry.over(spark, "evidence_scan", evidence_file=files).collect()] == [(1, "x.com", None, True, 1)]
    assert {r.path for r in registry.over(spark, "evidence_rejects", evidence_file=files).collect()} == {"b", "c", "d"}
