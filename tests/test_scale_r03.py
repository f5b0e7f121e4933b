"""Steps that grew faster than their input: what they shuffle, hold and repeat."""

from __future__ import annotations

import pandas as pd

from tessellate import operators  # noqa: F401  registers the relations
from tessellate.operators import robots, scores
from tessellate.plans import registry
from tessellate.sources import archives
from tessellate.sources.scratch import kept
from tessellate.streaming import budget, job_queue


SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_robots_verdicts_are_not_shuffled(spark):
    # sites were multiplied by agents and paths, then joined with rules and grouped again.
    text = plan(registry.run("robots_allowed", spark, SMALL))
    assert text.index("Generate explode") < text.index("Aggregate") and "Join LeftOuter" not in text


def test_robots_facts_stay_a_row_a_site(spark):
    body = "User-agent: GPTBot\nUser-agent: bot\nDisallow: /\nContent-Signal: search=yes\nUser-agent: *\nDisallow: /a\nAllow: /a\nUser-agent:\nDisallow: /*z$\n"
    files = spark.createDataFrame([(1, "a.com", body), (2, "b.com", "# none"), (3, "c.com", None), (4, "d.com", "Disallow: /"), (4, "d.com", "Disallow: /")], "site long, host string, body string")
    wide = registry.over(spark, "agent_access", robots_txt=files)
    facts = {r.site: r for r in registry.over(spark, "robots_facts", robots_txt=files).collect()}
    assert facts.keys() == {1, 2, 4}
    for site, n in wide.filter("NOT root_allowed").groupBy("site").count().collect():
        assert facts[site].agents_blocked == n
    assert facts[2].access == 1 and facts[4].access == 0 and facts[1].signals == 1 and facts[1].contradicted


def test_an_address_of_a_seller_is_read_once(spark):
    # the patterns of a domain ran on every line, several times over.
    assert "regexp" not in plan(registry.run("customer_rows", spark, SMALL))


def test_rows_leave_by_their_bytes():
    # a batch of files was held whole, with all that was made of it.
    taken = []
    rows = (taken.append(k) or (str(k), b"x" * 100) for k in range(1000))
    first = next(archives.by_bytes(rows, 1000))
    assert len(first) == len(taken) == 10 and sum(len(x) for x in archives.by_bytes(rows, 1000)) == 990


def test_rounds_of_a_budget_are_few(spark, monkeypatch):
    # each call that a full month still made was a round over all that follows.
    tables = []
    monkeypatch.setattr(budget, "kept", lambda df, label: (tables.append(label), kept(df, label))[1])
    rows = [("m", "a", 0, 0, 90, 80)] + [("m", f"r{k}", k, k, 5, 1) for k in range(1, 40)] + [("m", "a", 50, 50, 30, 30)]
    calls = spark.createDataFrame(rows, "month string, run string, id long, t long, projected long, cost long")
    got = {r.id: (r.made, r.used) for r in budget.within_budgets(calls, 95, 100).collect()}
    spent, want = 0, {}
    for _, _, k, _, projected, cost in rows:
        made = spent + projected <= 100 and (k != 50 or 80 + projected <= 95)
        spent += cost if made else 0
        want[k] = (made, spent)
    assert got == want and "budget-possible" in tables


def test_documents_of_a_sitemap_are_read_once(spark, monkeypatch):
    # every level of a walk put all documents together and cut them again, and whether one is an index was looked up in the whole document for every entry.
    written = []
    monkeypatch.setattr(registry, "kept", lambda df, label: (written.append(label), kept(df, label))[1])
    assert registry.run("sitemap_inventory", spark, SMALL).count() > 0 and written.count("sitemap_read") == 1
    documents = spark.createDataFrame(
        [("a.com", "https://a.com/s.xml", 0, "<sitemapindex><sitemap><loc>/u.xml</loc></sitemap></sitemapindex>"), ("a.com", "https://a.com/u.xml", 1, "<urlset><url><loc> </loc></url><url><loc>x</loc></url></urlset>"), ("a.com", "https://a.com/e.xml", 2, "<urlset/>"), ("a.com", "https://a.com/n.xml", 3, None)],
        "site_host string, url string, doc_ord int, xml string",
    )
    kinds = {r.url[14:-4]: (r.kind, r.entries) for r in registry.over(spark, "sitemap_parse", sitemap_doc=documents).collect()}
    assert kinds == {"s": ("index", 1), "u": ("urlset", 1), "e": ("unknown", 0), "n": ("unknown", 0)}
    assert [(r.idx, r.loc, r.is_index) for r in registry.over(spark, "sitemap_entry", sitemap_doc=documents).orderBy("loc").collect()] == [(0, "https://a.com/u.xml", True), (1, "https://a.com/x", False)]


def test_equal_robots_files_are_read_once(spark, monkeypatch):
    # F5, F6, F10 to F13, F15, F16: what a file says was found anew for every site.
    read = []
    monkeypatch.setattr(robots, "over", lambda s, name, **tables: (read.append(sorted((r.site, r.body) for r in tables["robots_txt"].collect())), registry.over(s, name, **tables))[1])
    shut, half = "User-agent: *\nDisallow: /", "User-agent: GPTBot\nDisallow: /"
    rows = [(1, shut), (2, half), (3, shut), (4, None), (5, shut), (5, half), (6, half)]
    files = spark.createDataFrame([(k, f"{k}.com", b) for k, b in rows], "site long, host string, body string")
    facts = {r.site: (r.access, r.agents_blocked) for r in registry.over(spark, "robots_facts", robots_txt=files).collect()}
    assert read == [[(1, shut), (2, half), (5, shut), (5, half)]] and facts.keys() == {1, 2, 3, 5, 6}
    assert facts[1] == facts[3] and facts[2] == facts[6] and facts[1][0] == 0 and facts[2][1] == 1
    assert sorted(r.site for r in registry.over(spark, "site_blocked", robots_txt=files).collect()) == [1, 3, 5]


def test_evidence_is_dealt_before_it_is_graded(spark):
    # A table of few bytes is one task, however many sites it has.
    evidence = scores.dealt(spark.range(100).coalesce(1).withColumnRenamed("id", "site"))
    assert evidence.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_events_of_a_pool_are_held_as_numbers():
    # F8: all events of a pool stood as objects, three times over, and all that changed left in one frame.
    rows = [(k * 7919 % 1000, k % 3, f"h{k % 5}", ("request", "ready")[k % 2]) for k in range(400)]
    frames = [pd.DataFrame(rows[k : k + 90], columns=["ms", "id", "host", "kind"]) for k in range(0, 400, 90)]
    want = pd.concat(frames).sort_values(["ms", "id"])
    assert list(job_queue.in_order(iter(frames), chunk=7)) == list(zip(want["host"], want["kind"], want["ms"]))
    assert list(job_queue.in_order(iter([]))) == []
    pool, touched = job_queue.Pool(), {}
    pool.event("a", "request", 5)
    (frame,) = job_queue.QueueProcessor._changed(("p",), pool, touched)
    assert frame["state"].tolist() == ["queued", "running"] and touched == {"a": None} and pool.changes == []


def test_claims_are_ranked_before_they_meet_the_domains(spark):
    # joined rows were sorted again for their ranks, beside the sorts of the join, in the same task.
    text = plan(registry.run("incumbent_lookup", spark, SMALL))
    assert text.index("Join LeftOuter") < text.index("Window")
    asked = spark.createDataFrame([("a.com",), ("a.com",), ("b.com",), ("b.com",), (None,), (None,)], "domain string")
    rows = [(1, "B", "comms", "possible", "a.com", False), (2, "A", "comms", "confirmed", "a.com", False), (3, "A", "social", "odd", "a.com", False), (4, "A", "social", "confirmed", "a.com", True), (5, "A", "social", "confirmed", None, False), (6, "C", "social", "confirmed", "c.com", False)]
    claims = spark.createDataFrame(rows, "claim_id long, vendor_name string, vendor_tier string, confidence string, domain string, is_client_vendor boolean")
    got = sorted((r.domain or "", r.nth, r.vendor_name, r.confidence, r.found) for r in registry.over(spark, "incumbent_lookup", asked_domain=asked, claim=claims).collect())
    best = [("A", "confirmed"), ("B", "possible"), ("A", "odd")]
    want = [(x, k, None, None, False) for x in ("", "b.com") for k in (1, 2)] + [("a.com", 2 * n + k, *best[n], True) for n in range(3) for k in (1, 2)]
    assert got == sorted(want, key=lambda r: r[:2])
