"""Findings: a table of rules over a site's evidence, evaluated in one pass, and their ranking."""

from __future__ import annotations

from ..plans.registry import query, relation

SHARED = [("og_image", 5, 1), ("og_description", 2, 1), ("share_affordance", 3, 2), ("article_schema", 3, 2)]

# Finding, predicate, severity, impact, effort, tier; in the order in which they are reported.
RULES = [
    ("blocked_at_root", "blocked_at_root", "limitation", 5, 1, "fast"),
    ("robots_unreadable", "robots_fetched AND NOT robots_present", "limitation", 3, 1, "fast"),
    ("content_signal_contradiction", "robots_present AND contradicted", "issue", 4, 1, "fast"),
    ("ai_agents_blocked", "robots_present AND agents_blocked > 0", "opportunity", 3, 1, "fast"),
    ("ai_agents_open", "robots_present AND agents_blocked = 0", "positive", 2, 5, "fast"),
    ("llms_txt", "llms_checked", "info", 1, 1, "fast"),
    ("homepage_og_image_broken", "home AND home_image IN ('broken', 'placeholder', 'relative')", "critical", 5, 1, "fast"),
    ("homepage_og_incomplete", "home AND coalesce(home_image, 'ok') = 'ok' AND (NOT home_title OR NOT home_description OR home_image IS NULL)", "issue", 4, 1, "fast"),
    ("homepage_og_ok", "home AND home_image = 'ok' AND home_title AND home_description", "positive", 2, 5, "fast"),
    ("homepage_no_schema", "home AND home_types = 0", "opportunity", 3, 2, "fast"),
    ("homepage_js_rendered", "home AND js_rendered", "issue", 3, 4, "fast"),
    ("homepage_unreachable", "NOT home AND NOT blocked_at_root", "limitation", 4, 2, "fast"),
    ("no_sitemap_urls", "canonical_urls IS NULL", "limitation", 4, 2, "full"),
    ("classification_coverage", "mapped AND insufficient", "limitation", 5, 1, "full"),
    ("content_below_floor", "mapped AND NOT insufficient AND pool < 30", "issue", 4, 5, "full"),
    ("content_monoculture", "mapped AND NOT insufficient AND pool >= 30 AND content_sections <= 2", "opportunity", 3, 4, "full"),
    ("recency_unobservable", "mapped AND NOT recency_measurable", "limitation", 2, 2, "full"),
    ("content_stale", "mapped AND recency_measurable AND dated > 0 AND dated_fresh * 100 < dated * 25", "issue", 3, 4, "full"),
    ("localization_spread", "mapped AND distinct_locales >= 3", "positive", 2, 5, "full"),
    ("pages_unretrievable", "pages_attempted > 0 AND pages_retrieved = 0", "limitation", 4, 2, "full"),
    ("broken_og_images", "read AND sampled_image IN ('broken', 'placeholder')", "critical", 5, 1, "full"),
    ("relative_og_images", "read AND sampled_image = 'relative'", "issue", 4, 1, "full"),
    *((f"no_{k}", f"read AND {k} = 0", "critical" if i >= 5 else "issue", i, e, "full") for k, i, e in SHARED),
    *((f"low_{k}", f"read AND {k} > 0 AND {k} < 60", "issue", max(2, i - 1), e, "full") for k, i, e in SHARED),
    ("no_named_authors", "read AND named_author = 0", "issue", 4, 3, "full"),
    ("named_authors_present", "read AND named_author >= 60", "positive", 3, 5, "full"),
    ("share_affordance_present", "read AND share_affordance >= 80", "positive", 2, 5, "full"),
    ("partial_sample", "read AND pages_retrieved < pages_attempted", "limitation", 2, 3, "full"),
    ("no_culture_pages", "mapped AND NOT insufficient AND culture_urls = 0", "opportunity", 3, 4, "full"),
    ("careers_unreachable", "careers_tried > 0 AND NOT careers_ok", "issue", 3, 2, "full"),
    ("careers_js_only", "careers_tried > 0 AND careers_ok AND careers_js_only", "opportunity", 3, 3, "full"),
    ("employees_quiet", "index_status = 'resolved' AND employees_indexed >= 25 AND posting_rate < 3", "opportunity", 4, 3, "full"),
    ("company_page_quiet", "index_status = 'resolved' AND employees_indexed IS NOT NULL AND employees_posted IS NOT NULL AND company_posts = 0", "info", 2, 2, "full"),
]


@relation
def finding_input(d):
    if d.spark:
        return "SELECT *, canonical_urls IS NOT NULL AS mapped, pages_retrieved > 0 AS read FROM graded_evidence"
    return """
SELECT e.*, coalesce(g.insufficient, false) AS insufficient, e.canonical_urls IS NOT NULL AS mapped, e.pages_retrieved > 0 AS read
FROM evidence_wide e JOIN graded g ON e.site = g.site"""


@relation
def finding(d):
    """A row a site and finding. All rules are tried on a row at once; a site with evidence is read once."""
    cases = d.array(*(f"CASE WHEN {p} THEN '{i}|{s}|{imp}|{eff}|{tier}' ELSE '' END" for i, p, s, imp, eff, tier in RULES))
    rows = d.explode("site", "finding_input", d.filt(cases, "x", "x <> ''"), "f", "ord")
    part = lambda k: d.at(d.split("f", "|"), k)
    return f"SELECT site, ord, {part(1)} AS finding, {part(2)} AS severity, CAST({part(3)} AS INTEGER) AS impact, CAST({part(4)} AS INTEGER) AS effort, CAST({part(3)} AS INTEGER) * (6 - CAST({part(4)} AS INTEGER)) AS priority, {part(5)} AS tier FROM ({rows})"


@query
def findings(d):
    return "SELECT site, ord, finding, severity, impact, effort, priority, tier FROM finding"


@query
def findings_by_severity(d):
    return "SELECT severity, finding, CAST(count(*) AS BIGINT) AS sites FROM finding GROUP BY severity, finding"


@relation
def ranked_finding(d):
    """Actions by priority, severity, effort; positives and limitations by impact; the order of the rules decides what is left."""
    kind = "CASE WHEN severity = 'positive' THEN 'positive' WHEN severity = 'limitation' THEN 'limitation' WHEN severity = 'info' THEN 'info' ELSE 'action' END"
    key = "CASE severity WHEN 'critical' THEN 0 WHEN 'issue' THEN 1 WHEN 'opportunity' THEN 2 ELSE 3 END"
    return f"""
SELECT site, kind, finding, severity, priority, tier, CAST(row_number() OVER (PARTITION BY site, kind ORDER BY CASE WHEN kind = 'action' THEN -priority ELSE -impact END, CASE WHEN kind = 'action' THEN {key} ELSE 0 END, CASE WHEN kind = 'action' THEN effort ELSE 0 END, ord) AS INTEGER) AS nth
FROM (SELECT *, {kind} AS kind FROM finding)"""


@query
def rank_findings(d):
    return "SELECT site, kind, finding, nth FROM ranked_finding"


@query
def top_fix(d):
    return "SELECT site, finding, severity, priority FROM ranked_finding WHERE kind = 'action' AND nth = 1"


@query
def fast_tier(d):
    """What the first answer shows: of every kind, in its order, the findings that need no crawl."""
    return "SELECT site, kind, finding, severity, CAST(row_number() OVER (PARTITION BY site, kind ORDER BY nth) AS INTEGER) AS nth FROM ranked_finding WHERE tier = 'fast'"


@query
def findings_client(d):
    """What a client gets to see: the rewritten text where there is one that may stand, else the finding's own."""
    return "SELECT f.site, f.finding, coalesce(n.rewrite, f.finding) AS shown FROM finding f LEFT JOIN (SELECT site, finding, rewrite FROM rewritten WHERE stands) n ON f.site = n.site AND f.finding = n.finding"


@relation
def rewritten(d):
    """Rewritten sentences with the source that they retell: one may stand only if each number in it is, whole, one of the source's."""
    number = r"[0-9]+(?:[.,][0-9]+)*"
    foreign = d.filt(d.exta("rewrite", number, 0), "n", f"NOT {d.has(d.exta('source', number, 0), 'n')}")
    return f"SELECT site, finding, rewrite, {d.size(foreign)} = 0 AS stands FROM narration"


@query
def number_guard(d):
    return "SELECT site, finding, stands FROM rewritten"
