"""The rubric: category scores, the overall grade, the private lead score, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed, numbers
from ..functions.numbers import piecewise
from ..plans.dialect import Dialect
from ..plans.registry import frame, query, relation, written
from .robots import GRANTS, by_file


WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in fixed.ACCESS_WEIGHTS.items()) + " END"


@relation
def robots_fact(d):
    """Spark's form of robots_facts for the files that it is given, a row a site all the way."""
    sums = lambda x, of: f"aggregate({of}, 0L, (n, a) -> n + {x})"
    weigh = WEIGHT.replace("CASE kind", "CASE a.kind")
    return f"""
SELECT a.site, {d.dbl(sums(weigh, "filter(a.agents, a -> a.allowed)"))} / {d.dbl(sums(weigh, "a.agents"))} AS access, CAST(size(filter(a.agents, a -> NOT a.allowed)) * a.files AS BIGINT) AS agents_blocked, coalesce(s.signals, 0) AS signals,
  coalesce(exists(a.agents, x -> NOT x.allowed AND array_contains(g.kinds, x.kind)), false) AS contradicted FROM robots_access a
LEFT JOIN (SELECT site, CAST(count(*) AS BIGINT) AS signals FROM robots_signal WHERE content_signal <> '' GROUP BY site) s ON a.site = s.site
LEFT JOIN (SELECT site, collect_set(kind) AS kinds FROM ({GRANTS}) GROUP BY site) g ON a.site = g.site"""


@frame("robots_facts", "robots_txt")
def facts(files: DataFrame) -> DataFrame:
    return by_file(files, "robots_fact")


@written
def robots_facts(d):
    """What a site's robots file says to agents, for the scores: the weighted share let in, agents kept out, signals, and whether they contradict that."""
    weight = WEIGHT
    return f"""
SELECT a.site, a.access, a.agents_blocked, coalesce(s.signals, 0) AS signals, c.site IS NOT NULL AS contradicted
FROM (SELECT site, {d.dbl(f'sum(CASE WHEN root_allowed THEN {weight} ELSE 0 END)')} / {d.dbl(f'sum({weight})')} AS access, {d.count_if('NOT root_allowed')} AS agents_blocked FROM agent_access GROUP BY site) a
LEFT JOIN (SELECT site, CAST(count(*) AS BIGINT) AS signals FROM robots_group WHERE content_signal IS NOT NULL AND content_signal <> '' GROUP BY site) s ON a.site = s.site
LEFT JOIN (SELECT DISTINCT site FROM signal_contradictions) c ON a.site = c.site"""


@frame("evidence_dealt", "evidence")
def dealt(evidence: DataFrame) -> DataFrame:
    """Evidence dealt out by site: few bytes of a table may be many sites, and grading one takes long."""
    return evidence.repartition(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site")


@relation
def evidence_dealt(d):
    return "SELECT * FROM evidence"


@relation
def evidence_wide(d):
    """evidence with its counts made consistent, and what the robots file adds; without one, robots_present is false."""
    return f"""
SELECT w.*, r.site IS NOT NULL AS robots_present, r.access, r.agents_blocked, r.signals, coalesce(r.contradicted, false) AS contradicted FROM (
SELECT *, CASE WHEN sampler_pool IS NULL THEN shareable ELSE least(shareable, sampler_pool) END AS pool, {numbers.pct(d, 'shareable', 'canonical_urls')} AS share_pct, {numbers.pct(d, 'unclassified', 'total_urls')} AS unclassified_pct,
  {numbers.pct(d, 'employees_posted', 'employees_indexed')} AS posting_rate, {numbers.pct(d, 'makers_posted', 'employees_indexed')} AS maker_rate, CASE WHEN pages_retrieved > pages_attempted_raw THEN pages_retrieved ELSE pages_attempted_raw END AS pages_attempted,
  coalesce(ats_reqs, board_reqs) AS reqs FROM (
  SELECT *, CASE WHEN canonical_urls IS NULL THEN NULL ELSE least(CAST(floor(shareable_raw) AS BIGINT), canonical_urls) END AS shareable, CAST(floor(unclassified_raw) AS BIGINT) AS unclassified FROM {'evidence_dealt' if d.spark else 'evidence'})) w LEFT JOIN robots_facts r ON w.site = r.site"""


@query
def piecewise_scale(d):
    """Bands at and between their points."""
    return f"SELECT id, {piecewise(d, 'pages', fixed.VOLUME)} AS volume, {piecewise(d, 'share', fixed.RECENCY)} AS recency, {piecewise(d, 'rate', fixed.DECISION_MAKERS)} AS makers FROM band_probe"


def supply_score(d: Dialect) -> dict[str, str]:
    fresh = f"CASE WHEN recency_measurable AND dated > 0 THEN {d.dbl('dated_fresh')} / dated * 100 END"
    base = numbers.clamp(f"{piecewise(d, 'pool', fixed.VOLUME)} + {piecewise(d, 'sections', fixed.DIVERSITY)} + {piecewise(d, 'share_pct', fixed.SHARE)} + coalesce({piecewise(d, fresh, fixed.RECENCY)}, 0)")
    score = f"CASE WHEN canonical_urls IS NULL THEN NULL WHEN pool < {fixed.LEAST_POOL} THEN {d.r1(f'least(25, {base})')} ELSE {d.r1(base)} END"
    return {"score": score, "floor_failed": f"coalesce(pool < {fixed.LEAST_POOL}, false)", "confidence": "CASE WHEN recency_measurable THEN 'full' ELSE 'reduced' END"}


def sharing_score(d: Dialect) -> dict[str, str]:
    total = " + ".join(f"{d.dbl(f'coalesce({k}, 0)')} / 100 * {w}" for k, w in fixed.SHARE_WEIGHTS.items())
    return {"score": f"CASE WHEN pages_retrieved > 0 AND canonical_urls IS NOT NULL THEN {d.r1(numbers.clamp(total))} END", "confidence": "CASE WHEN pages_retrieved < pages_attempted THEN 'reduced' ELSE 'full' END"}


def website_points(d: Dialect) -> str:
    parts = [piecewise(d, "culture_urls", fixed.CULTURE), "CASE WHEN careers_ok THEN 15 ELSE 0 END", piecewise(d, "careers_urls", fixed.CAREERS_DEPTH), f"coalesce({d.dbl('named_author')}, 0) / 100 * 25", piecewise(d, "story_urls", fixed.STORIES)]
    return d.dbl(numbers.clamp(" + ".join(parts)))


def activity_score(d: Dialect) -> dict[str, str]:
    usable = f"(index_status = 'resolved' AND employees_indexed IS NOT NULL AND employees_posted IS NOT NULL AND employees_indexed >= {fixed.LEAST_INDEXED})"
    why = f"CASE WHEN index_status <> 'resolved' THEN 'no record' WHEN employees_indexed IS NULL OR employees_posted IS NULL THEN 'not answered' WHEN employees_indexed < {fixed.LEAST_INDEXED} THEN 'too few indexed' END"
    points = f"{piecewise(d, 'coalesce(posting_rate, 0)', fixed.POSTING_RATE)} + coalesce({piecewise(d, 'maker_rate', fixed.DECISION_MAKERS)}, 0) + coalesce({piecewise(d, 'company_posts', fixed.CADENCE)}, 0)"
    return {"usable": usable, "why": why, "points": f"CASE WHEN {usable} THEN {points} END"}


def ai_score(d: Dialect) -> dict[str, str]:
    total = f"access * 45 + CASE WHEN signals = 0 THEN 9 WHEN contradicted THEN 3 ELSE 15 END + {piecewise(d, 'coalesce(home_types, 0)', fixed.HOME_SCHEMA)} + coalesce({d.dbl('article_schema')}, 0) / 100 * 25"
    return {"score": f"CASE WHEN robots_present THEN {d.r1(numbers.clamp(total))} END", "confidence": "CASE WHEN article_schema IS NULL THEN 'reduced' ELSE 'full' END"}


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


INSUFFICIENT = f"(total_urls > 0 AND (unclassified_pct >= 50 OR (coalesce(pool, 0) < {fixed.LEAST_POOL} AND unclassified_pct >= 30)))"


@written
def graded_evidence(d):
    """Evidence with everything of a site's score, in one pass. Scores are derived on reading, never stored with evidence."""
    w = fixed.CATEGORY_WEIGHTS
    each = {f"supply_{k}": v for k, v in supply_score(d).items()} | {f"sharing_{k}": v for k, v in sharing_score(d).items()} | {f"activity_{k}": v for k, v in activity_score(d).items()} | {f"ai_{k}": v for k, v in ai_score(d).items()}
    each |= {"website_points": website_points(d), "insufficient": INSUFFICIENT, "culture_confidence": "CASE WHEN named_author IS NULL THEN 'reduced' ELSE 'full' END"}
    culture = f"CASE WHEN canonical_urls IS NOT NULL THEN {d.r1(numbers.clamp('CASE WHEN activity_usable THEN website_points / 2 + activity_points ELSE website_points END'))} END"
    scores = ["supply_score", "sharing_score", "culture_score", "ai_score"]
    reduced = " OR ".join(f"{c}_confidence = 'reduced'" for c in ("supply", "sharing", "culture", "ai"))
    total = f"supply_score * {w['content_supply']}e0 + sharing_score * {w['shareability']}e0 + culture_score * {w['employee_culture']}e0 + ai_score * {w['ai_discoverability']}e0"
    return f"""
SELECT *, CASE WHEN gradeable THEN {d.r1('total')} END AS overall, {numbers.grade(f'CASE WHEN gradeable THEN {d.r1("total")} END', fixed.GRADES)} AS grade FROM (
  SELECT *, NOT blocked_at_root AND NOT insufficient AND scorable = 4 AS gradeable, CASE WHEN blocked_at_root THEN 'blocked at the root' WHEN insufficient THEN 'structure not readable' WHEN scorable < 4 THEN 'categories not observed' END AS withheld_reason FROM (
    SELECT *, {' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE 1 END' for x in scores)} AS scorable, CASE WHEN insufficient OR {reduced} THEN 'reduced' ELSE 'full' END AS confidence, {total} AS total FROM (
      SELECT *, {culture} AS culture_score FROM (SELECT *, {_named(each)} FROM evidence_wide))))"""


@relation
def scored_supply(d):
    return f"SELECT site, {_named(supply_score(d))} FROM evidence_wide"


@query
def score_content_supply(d):
    return "SELECT * FROM scored_supply"


@relation
def scored_sharing(d):
    return f"SELECT site, {_named(sharing_score(d))} FROM evidence_wide"


@query
def score_shareability(d):
    return "SELECT * FROM scored_sharing"


@relation
def website_culture(d):
    return f"SELECT site, canonical_urls IS NOT NULL AS scorable, named_author IS NULL AS unmeasured, {website_points(d)} AS points FROM evidence_wide"


@query
def score_culture_site(d):
    return f"SELECT site, {d.r1('points')} AS score, unmeasured FROM website_culture WHERE scorable"


@relation
def activity_points(d):
    return f"SELECT site, {_named(activity_score(d))} FROM evidence_wide"


@query
def score_activity_half(d):
    return f"SELECT site, usable, why, {d.r1('points')} AS points FROM activity_points"


@relation
def scored_culture(d):
    if d.spark:
        return "SELECT site, culture_score AS score, CASE WHEN activity_usable THEN 'website+index' ELSE 'website' END AS basis, culture_confidence AS confidence FROM graded_evidence"
    return f"""
SELECT w.site, CASE WHEN w.scorable THEN {d.r1(numbers.clamp('CASE WHEN a.usable THEN w.points / 2 + a.points ELSE w.points END'))} END AS score, CASE WHEN a.usable THEN 'website+index' ELSE 'website' END AS basis, CASE WHEN w.unmeasured THEN 'reduced' ELSE 'full' END AS confidence
FROM website_culture w JOIN activity_points a ON w.site = a.site"""


@query
def score_employee_culture(d):
    return "SELECT * FROM scored_culture"


@relation
def scored_ai(d):
    return f"SELECT site, {_named(ai_score(d))} FROM evidence_wide"


@query
def score_ai(d):
    return "SELECT * FROM scored_ai"


@relation
def graded(d):
    """Everything of a site's score. DuckDB's form joins the categories."""
    if d.spark:
        return "SELECT site, host, blocked_at_root AS blocked, insufficient, supply_score AS content_supply, sharing_score AS shareability, culture_score AS employee_culture, ai_score AS ai_discoverability, scorable, confidence, gradeable, withheld_reason, overall, grade FROM graded_evidence"
    w, overall = fixed.CATEGORY_WEIGHTS, f"CASE WHEN gradeable THEN {d.r1('total')} END"
    total = f"s.score * {w['content_supply']}e0 + h.score * {w['shareability']}e0 + c.score * {w['employee_culture']}e0 + a.score * {w['ai_discoverability']}e0"
    return f"""
SELECT *, {overall} AS overall, {numbers.grade(overall, fixed.GRADES)} AS grade FROM (
  SELECT *, NOT blocked AND NOT insufficient AND scorable = 4 AS gradeable, CASE WHEN blocked THEN 'blocked at the root' WHEN insufficient THEN 'structure not readable' WHEN scorable < 4 THEN 'categories not observed' END AS withheld_reason FROM (
    SELECT e.site, e.host, e.blocked_at_root AS blocked, e.total_urls > 0 AND (e.unclassified_pct >= 50 OR (coalesce(e.pool, 0) < {fixed.LEAST_POOL} AND e.unclassified_pct >= 30)) AS insufficient,
      s.score AS content_supply, h.score AS shareability, c.score AS employee_culture, a.score AS ai_discoverability, {total} AS total,
      CASE WHEN s.score IS NULL THEN 0 ELSE 1 END + CASE WHEN h.score IS NULL THEN 0 ELSE 1 END + CASE WHEN c.score IS NULL THEN 0 ELSE 1 END + CASE WHEN a.score IS NULL THEN 0 ELSE 1 END AS scorable,
      CASE WHEN e.total_urls > 0 AND (e.unclassified_pct >= 50 OR (coalesce(e.pool, 0) < {fixed.LEAST_POOL} AND e.unclassified_pct >= 30)) OR s.confidence = 'reduced' OR h.confidence = 'reduced' OR c.confidence = 'reduced' OR a.confidence = 'reduced' THEN 'reduced' ELSE 'full' END AS confidence
    FROM evidence_wide e JOIN scored_supply s ON e.site = s.site JOIN scored_sharing h ON e.site = h.site JOIN scored_culture c ON e.site = c.site JOIN scored_ai a ON e.site = a.site))"""


@query
def overall_grade(d):
    return "SELECT site, host, gradeable, overall, grade, withheld_reason, confidence, content_supply, shareability, employee_culture, ai_discoverability FROM graded"


@relation
def lead(d):
    """Hiring pressure, and the gap it leaves to the public score; null where there is no score or no count to rank by."""
    source = "graded_evidence e" if d.spark else "evidence_wide e JOIN graded g ON e.site = g.site"
    g = "e" if d.spark else "g"
    parts = [f"coalesce({piecewise(d, 'e.reqs', fixed.OPEN_REQS)}, 0)", f"coalesce({piecewise(d, 'e.posted_30d', fixed.VELOCITY)}, 0)", "CASE WHEN e.reqs IS NULL OR e.buyer_roles = 0 THEN 0 ELSE least(30, 20 + 5 * e.buyer_roles) END", piecewise(d, "coalesce(e.canonical_urls, 0)", fixed.SITE_SIZE)]
    return f"""
SELECT *, CASE WHEN gap IS NULL THEN 'unranked' WHEN reqs IS NULL THEN 'unqualified' WHEN gap >= 45 THEN 'hot' WHEN gap >= 28 THEN 'warm' WHEN gap >= 14 THEN 'watch' ELSE 'cold' END AS tier FROM (
  SELECT *, CASE WHEN overall IS NULL THEN NULL ELSE {d.r1(numbers.clamp('pressure * ((100 - overall) / 100)'))} END AS gap FROM (
    SELECT {g}.site, {g}.host, {g}.overall, e.reqs, e.ats_reqs IS NULL AND e.board_reqs IS NOT NULL AS self_hosted, e.competitor_mentioned, {d.r1(numbers.clamp(' + '.join(parts)))} AS pressure FROM {source}))"""


@query
def lead_score(d):
    return "SELECT site, pressure, overall AS public_score, gap AS opportunity_gap, tier FROM lead"


@query
def advocacy_baseline(d):
    """How active a company's employees are, in words; a rate that was not measured is not quiet."""
    measured = f"index_status = 'resolved' AND employees_indexed IS NOT NULL AND employees_indexed >= {fixed.LEAST_INDEXED} AND posting_rate IS NOT NULL"
    return f"""
SELECT site, CASE WHEN index_status <> 'resolved' THEN index_status WHEN {measured} THEN 'measured' ELSE 'thin' END AS status, CASE WHEN {measured} THEN posting_rate END AS rate_pct, CASE WHEN index_status = 'resolved' THEN employees_indexed END AS indexed,
  CASE WHEN NOT ({measured}) THEN NULL WHEN posting_rate < 3 THEN 'quiet' WHEN posting_rate < 10 THEN 'typical' ELSE 'active' END AS reading FROM evidence_wide"""


@query
def employee_voice(d):
    """An alternative to the culture score, from bylines: diversity, spread, coverage."""
    people, top, named = "byline_people", "byline_top_share", "coalesce(named_author, 0)"
    parts = [
        piecewise(d, people, fixed.VOICE_DIVERSITY), f"CASE WHEN {people} = 0 THEN 0 ELSE {piecewise(d, f'100 - floor({top})', fixed.VOICE_SPREAD)} END", f"{d.dbl(named)} / 100 * 15", piecewise(d, "culture_urls", fixed.VOICE_CULTURE),
        f"CASE WHEN careers_ok THEN 8 ELSE 0 END + {piecewise(d, 'careers_urls', fixed.VOICE_CAREERS)}", piecewise(d, "author_urls", fixed.VOICE_AUTHORS),
    ]
    return f"SELECT site, {d.r1(numbers.clamp(' + '.join(f'({p})' for p in parts)))} AS score FROM evidence_wide"


@query
def score_band(d):
    return "SELECT site, CASE WHEN overall IS NULL THEN 'none' WHEN overall >= 80 THEN 'green' WHEN overall >= 70 THEN 'amber' ELSE 'red' END AS band FROM graded"


@query
def component_groups(d):
    """Components of the culture category with their points, the most they could have, and both for their group. The website's count half where the index is usable."""
    half = lambda x: f"({x}) / 2"
    rows = [
        ("What the site says", "Culture pages", 15, half(piecewise(d, "culture_urls", fixed.CULTURE))), ("What the site says", "Careers page", 7.5, half("CASE WHEN careers_ok THEN 15 ELSE 0 END")),
        ("What the site says", "Careers depth", 7.5, half(piecewise(d, "careers_urls", fixed.CAREERS_DEPTH))), ("What the site says", "Named authors", 12.5, half(f"coalesce({d.dbl('named_author')}, 0) / 100 * 25")),
        ("What the site says", "Stories", 7.5, half(piecewise(d, "story_urls", fixed.STORIES))), ("What employees do", "Posting", 25, piecewise(d, "coalesce(posting_rate, 0)", fixed.POSTING_RATE)),
        ("What employees do", "Decision-makers", 15, f"coalesce({piecewise(d, 'maker_rate', fixed.DECISION_MAKERS)}, 0)"), ("What employees do", "Cadence", 10, f"coalesce({piecewise(d, 'company_posts', fixed.CADENCE)}, 0)"),
    ]
    each = " UNION ALL ".join(f"SELECT e.site, {d.lit(g)} AS section, {d.lit(n)} AS component, {m}e0 AS most, {d.r1(p)} AS points FROM evidence_wide e JOIN (SELECT site FROM activity_points WHERE usable) a ON e.site = a.site" for g, n, m, p in rows)
    return f"SELECT site, section, component, points, most, {d.r1('sum(points) OVER (PARTITION BY site, section)')} AS section_points, sum(most) OVER (PARTITION BY site, section) AS section_most FROM ({each})"


@query
def lead_intel_row(d):
    """The fixed columns that go with a captured lead; without evidence they are null, never zero."""
    held = "c.has_evidence"
    return f"""
SELECT c.site, {held} AS evidence_available, coalesce({held} AND g.gradeable, false) AS gradeable, CASE WHEN {held} THEN g.grade END AS grade, CASE WHEN {held} THEN g.overall END AS public_score, CASE WHEN {held} AND NOT g.gradeable THEN g.withheld_reason END AS withheld_reason,
  CASE WHEN {held} THEN l.tier END AS lead_tier, CASE WHEN {held} THEN l.gap END AS opportunity_gap, CASE WHEN {held} THEN l.pressure END AS hiring_pressure,
  CASE WHEN NOT {held} THEN NULL WHEN l.reqs IS NULL THEN 'no hiring data' WHEN l.self_hosted THEN 'self-hosted board: no job text to search' END AS lead_signal_note,
  CASE WHEN {held} THEN CASE WHEN x.claims = 0 THEN 'no_index_loaded' WHEN i.domain IS NULL THEN 'no_evidence_in_index' ELSE 'evidence_found' END END AS incumbent_status,
  CASE WHEN {held} THEN b.status END AS advocacy_baseline_status, CASE WHEN {held} THEN b.rate_pct END AS advocacy_baseline_rate_pct, CASE WHEN {held} THEN b.indexed END AS advocacy_baseline_indexed, CASE WHEN {held} THEN b.reading END AS advocacy_baseline_note,
  CASE WHEN {held} THEN t.finding END AS top_fix_id, CASE WHEN {held} THEN t.severity END AS top_fix_severity, concat('https://reports.example/report/', c.domain) AS report_url, CASE WHEN NOT {held} THEN 'no evidence in the cache: nothing here is estimated' END AS intel_note
FROM captured_lead c CROSS JOIN (SELECT count(*) AS claims FROM claim) x LEFT JOIN lead l ON c.site = l.site LEFT JOIN graded g ON c.site = g.site LEFT JOIN advocacy_baseline b ON c.site = b.site
LEFT JOIN (SELECT DISTINCT domain FROM claim WHERE NOT is_client_vendor AND domain IS NOT NULL) i ON c.domain = i.domain LEFT JOIN (SELECT * FROM ranked_finding WHERE kind = 'action' AND nth = 1) t ON c.site = t.site"""


@query
def lead_validate(d):
    return f"SELECT id, mail, {d.rx('mail', r'^[^\s@]+@[^\s@]+[.][^\s@]+\z')} AS valid, substring(name, 1, 200) AS kept_name FROM (SELECT id, substring({d.trim('mail')}, 1, 200) AS mail, name FROM contact_form)"


@query
def challenge_outcome(d):
    """What is recorded of a challenge: refused without a token or by the service, let in and said so where it is not set up or cannot be reached."""
    return "SELECT id, CASE WHEN NOT configured THEN 'not-enforced' WHEN token IS NULL THEN 'refused: missing-token' WHEN NOT reachable THEN 'unverified-outage' WHEN NOT verified THEN 'refused: rejected' ELSE 'passed' END AS outcome FROM challenge"


@query
def strip_derived(d):
    """What is stored of a site: evidence without anything that is computed from it."""
    return f"SELECT * {'EXCEPT' if d.spark else 'EXCLUDE'} (scoring, lead_score) FROM evidence_bundle"


@query
def private_leaks(d):
    """Findings that, as a client sees them, give away what only the lead score may know."""
    return f"SELECT site, finding FROM findings_client WHERE {d.rx('concat(finding, shown)', 'hiring_pressure|opportunity_gap|buyer_in_seat|approximate_open_reqs')}"


@query
def corpus_stats(d):
    return f"SELECT CAST(count(*) AS BIGINT) AS total, {d.count_if('gradeable')} AS graded, {d.count_if('NOT gradeable')} AS withheld FROM graded"


@query
def grade_distribution(d):
    return "SELECT coalesce(grade, 'withheld') AS grade, CAST(count(*) AS BIGINT) AS sites FROM graded GROUP BY coalesce(grade, 'withheld')"


@query
def withheld_reasons(d):
    return "SELECT withheld_reason, confidence, CAST(count(*) AS BIGINT) AS sites FROM graded WHERE withheld_reason IS NOT NULL GROUP BY withheld_reason, confidence"


@query
def corpus_percentiles(d):
    """The values at place floor(n q) of the sorted scores: no interpolation. Scores are counted by value first, so few rows are sorted."""
    q = {"p0": 0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    cols = ", ".join(f"min(CASE WHEN upto > floor(total * {v}e0) THEN overall END) AS {k}" for k, v in q.items())
    return f"""
SELECT CAST(max(total) AS BIGINT) AS n, {cols}, max(overall) AS p100 FROM (
  SELECT overall, sum(n) OVER (ORDER BY overall ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM (SELECT overall, count(*) AS n FROM graded WHERE gradeable GROUP BY overall))"""


@query
def leaderboard(d):
    """All sites: by score, sites without one last, then by name.

    Names are ranked within score and first letters, and the counts in front are added, so no task sorts all sites.
    """
    return """
SELECT r.site, r.host, r.overall, r.grade, CAST(r.inside + coalesce(f.before, 0) AS INTEGER) AS nth FROM (
  SELECT site, host, overall, grade, coalesce(overall, -1) AS key, substring(host, 1, 6) AS part, row_number() OVER (PARTITION BY coalesce(overall, -1), substring(host, 1, 6) ORDER BY host) AS inside FROM graded) r
JOIN (SELECT key, part, sum(n) OVER (ORDER BY key DESC, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT coalesce(overall, -1) AS key, substring(host, 1, 6) AS part, count(*) AS n FROM graded GROUP BY coalesce(overall, -1), substring(host, 1, 6))) f ON r.key = f.key AND r.part = f.part""" if d.spark else """
SELECT site, host, overall, grade, CAST(row_number() OVER (ORDER BY coalesce(overall, -1) DESC, host) AS INTEGER) AS nth FROM graded"""


@query
def grade_movers(d):
    """Sites whose grade changes when employee activity is not counted."""
    source = "(SELECT *, supply_score AS content_supply, sharing_score AS shareability, ai_score AS ai_discoverability FROM graded_evidence) g" if d.spark else "graded g JOIN website_culture c ON g.site = c.site"
    w = fixed.CATEGORY_WEIGHTS
    total = f"g.content_supply * {w['content_supply']}e0 + g.shareability * {w['shareability']}e0 + {d.r1('g.website_points' if d.spark else 'c.points')} * {w['employee_culture']}e0 + g.ai_discoverability * {w['ai_discoverability']}e0"
    return f"SELECT site, grade, overall, {numbers.grade('before', fixed.GRADES)} AS grade_before, before AS overall_before FROM (SELECT g.site, g.grade, g.overall, {d.r1(total)} AS before FROM {source} WHERE g.gradeable) WHERE {numbers.grade('before', fixed.GRADES)} <> grade"
