"""Job postings and posting activity."""

from __future__ import annotations

from ..functions import fixed, markup, numbers
from ..plans.adapters import NOW_ACTIVITY, NOW_ORDERS
from ..plans.dialect import Dialect
from ..plans.registry import query, relation


def triggers(d: Dialect, title: str) -> str:
    """The kinds of buyer that a title names, in order, separated by spaces."""
    return d.join(d.filt(d.array(*(f"CASE WHEN {d.rx(title, p)} THEN '{k}' ELSE '' END" for k, p in fixed.BUYER_TITLES)), "x", "x <> ''"), " ")


@query
def jobs_normalize(d):
    """One schema for the three interfaces: Greenhouse lists departments, Lever counts milliseconds, Ashby has a location or is remote."""
    g = (lambda p: f"get_json_object(reply, '$.{p}')") if d.spark else (lambda p: f"json_extract_string(reply, '$.{p}')")
    day = f"date_format(timestamp_millis(CAST({g('createdAt')} AS BIGINT)), 'yyyy-MM-dd')" if d.spark else f"strftime(make_timestamp(CAST({g('createdAt')} AS BIGINT) * 1000), '%Y-%m-%d')"
    names = "from_json(reply, 'departments array<struct<name: string>>').departments.name" if d.spark else "json_extract_string(reply, '$.departments[*].name')"
    both = lambda one, two: f"CASE WHEN coalesce({g(one)}, '') = '' THEN nullif({g(two)}, '') WHEN coalesce({g(two)}, '') = '' THEN {g(one)} ELSE concat({g(one)}, ' / ', {g(two)}) END"
    return f"""
SELECT site, ord, ats, nullif(CASE ats WHEN 'lever' THEN {g('text')} ELSE {g('title')} END, '') AS title,
  CASE ats WHEN 'greenhouse' THEN nullif({g('location.name')}, '') WHEN 'lever' THEN nullif({g('categories.location')}, '') ELSE coalesce(nullif({g('location')}, ''), CASE WHEN {g('isRemote')} = 'true' THEN 'Remote' END) END AS location,
  CASE ats WHEN 'greenhouse' THEN nullif({d.join(d.filt(names, 'x', "x <> ''"), ', ')}, '') WHEN 'lever' THEN {both('categories.department', 'categories.team')} ELSE {both('department', 'team')} END AS department,
  substring(CASE ats WHEN 'greenhouse' THEN coalesce(nullif({g('first_published')}, ''), nullif({g('updated_at')}, '')) WHEN 'lever' THEN {day} ELSE nullif({g('publishedAt')}, '') END, 1, 10) AS posted,
  CASE ats WHEN 'greenhouse' THEN {g('absolute_url')} WHEN 'lever' THEN {g('hostedUrl')} ELSE {g('jobUrl')} END AS url FROM board_reply"""


@relation
def board_once(d):
    """Each board of a site once, where it was named first: pages name one more than once."""
    return "SELECT site, ats, token, min(ord) AS ord, min_by(jobs, ord) AS jobs FROM board_hint GROUP BY site, ats, token"


@query
def jobs_first_source(d):
    """The first board with an adapter that answers with a job; boards without one are named, not read as no hiring."""
    usable = "ats IN ('greenhouse', 'lever', 'ashby')"
    return f"""
SELECT h.site, f.ats AS used, f.jobs, h.attempts, h.unread FROM (SELECT site, CAST(count(*) AS BIGINT) AS attempts, {d.count_if(f'NOT {usable}')} AS unread FROM board_once GROUP BY site) h
LEFT JOIN (SELECT site, ats, jobs FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS nth FROM board_once WHERE {usable} AND jobs > 0) WHERE nth = 1) f ON h.site = f.site"""


@query
def jobs_source(d):
    """Where a site's open roles come from: its board, else its own careers page, else unknown."""
    return """
SELECT e.site, CASE WHEN f.used IS NOT NULL THEN f.used WHEN e.board_reqs IS NOT NULL THEN 'self-hosted' END AS source, coalesce(f.jobs, e.board_reqs) AS reqs FROM evidence e LEFT JOIN jobs_first_source f ON e.site = f.site"""


@query
def buyer_roles(d):
    return f"SELECT site, ord, title, kinds FROM (SELECT site, ord, title, {triggers(d, 'title')} AS kinds FROM job) WHERE kinds <> ''"


@query
def competitor_mentions(d):
    """Vendors whose name stands in a job's text or title, as words, with the jobs of a site that name them and the first three.

    Spark joins a name's longest word to the words of a job, and looks for the whole name only where that is found.
    """
    if not d.spark:
        word = "concat('(?i)(^|[^A-Za-z0-9_])', replace(v.name, '#', '[#]'), '([^A-Za-z0-9_]|$)')"
        texts = f"SELECT t.title, t.description, v.name AS vendor FROM (SELECT DISTINCT title, description FROM job) t JOIN competitor v ON regexp_matches(t.description, {word}) OR regexp_matches(t.title, {word})"
        hits = f"SELECT j.site, h.vendor, j.ord, j.title FROM job j JOIN ({texts}) h ON j.title IS NOT DISTINCT FROM h.title AND j.description IS NOT DISTINCT FROM h.description"
    else:
        words = "array_distinct(regexp_extract_all(lower(concat(title, ' ', description)), '[a-z0-9_]+', 0))"
        longest = "max_by(w, length(w)) AS word"
        whole = "concat('(?i)(^|[^A-Za-z0-9_])\\\\Q', v.name, '\\\\E([^A-Za-z0-9_]|$)')"
        hits = f"""SELECT j.site, v.name AS vendor, j.ord, j.title FROM (SELECT site, ord, title, description, word FROM job LATERAL VIEW explode({words}) _w AS word) j
JOIN (SELECT name, {longest} FROM competitor LATERAL VIEW explode(regexp_extract_all(lower(name), '[a-z0-9_]+', 0)) _x AS w GROUP BY name) v ON j.word = v.word
WHERE j.description RLIKE {whole} OR j.title RLIKE {whole}"""
    return f"""
SELECT site, vendor, CAST(count(*) AS BIGINT) AS jobs, {d.join(d.lists('CASE WHEN nth <= 3 THEN title END', 'ord'), ' | ')} AS example_jobs
FROM (SELECT *, row_number() OVER (PARTITION BY site, vendor ORDER BY ord) AS nth FROM ({hits})) GROUP BY site, vendor"""


@query
def jobs_analysis(d):
    now = d.seconds(f"TIMESTAMP '{NOW_ORDERS}'")
    age = f"{now} - {d.seconds('posted_at')}"
    return f"""
SELECT site, CAST(count(*) AS BIGINT) AS open_reqs, {d.count_if('length(description) > 200')} AS with_text, {d.count_if(f'{age} <= 30 * 86400')} AS posted_30d, {d.count_if(f'{age} <= 90 * 86400')} AS posted_90d, max({d.day('posted_at')}) AS newest, CAST(count(posted_at) AS BIGINT) AS dated,
  {d.count_if(f"{triggers(d, 'title')} <> ''")} AS buyer_roles FROM job GROUP BY site"""


@query
def jobs_departments(d):
    """The twelve most frequent departments, and locations, of a site's jobs; among equals the first seen."""
    each = lambda col: f"SELECT site, '{col}' AS kind, coalesce(nullif({col}, ''), 'unspecified') AS name, CAST(count(*) AS BIGINT) AS n, min(ord) AS first_ord FROM job GROUP BY site, coalesce(nullif({col}, ''), 'unspecified')"
    return f"SELECT site, kind, name, n, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site, kind ORDER BY n DESC, first_ord) AS INTEGER) AS nth FROM ({each('department')} UNION ALL {each('location')})) WHERE nth <= 12"


def counts_since(d: Dialect, days: int = 90, now: str = NOW_ACTIVITY) -> str:
    """Seven counts of a company over the days before now, from the start of the first of them, in one pass; employees who never posted count as indexed."""
    since = f"{d.seconds('ts')} >= {d.idiv(f'{d.seconds(f"TIMESTAMP {chr(39)}{now}{chr(39)}")} - {days} * 86400', 86400)} * 86400"
    return f"""
SELECT company, CAST(count(DISTINCT employee) AS BIGINT) AS employees_indexed, CAST(count(DISTINCT CASE WHEN is_post AND {since} THEN employee END) AS BIGINT) AS employees_posted, CAST(count(DISTINCT CASE WHEN is_post AND is_decision_maker AND {since} THEN employee END) AS BIGINT) AS makers_posted,
  {d.count_if("kind = 'company'")} AS company_posts_all, {d.count_if(f"kind = 'company' AND {since}")} AS company_posts, {d.count_if(f"kind = 'reshare' AND {since}")} AS reshares FROM company_post GROUP BY company"""


@relation
def company_counts(d):
    return counts_since(d)


@query
def activity_counts(d):
    return f"SELECT c.*, coalesce(f.frequent, 0) AS frequent_posters, {numbers.pct(d, 'c.employees_posted', 'c.employees_indexed')} AS active_rate_pct FROM company_counts c LEFT JOIN (SELECT company, CAST(count(*) AS BIGINT) AS frequent FROM (SELECT company, employee FROM company_post WHERE is_post GROUP BY company, employee HAVING count(*) >= 12) GROUP BY company) f ON c.company = f.company"


@query
def index_selftest(d):
    """The index works if three counts of a control company are all above zero."""
    return "SELECT company, employees_indexed > 0 AND company_posts_all > 0 AND reshares > 0 AS ok FROM company_counts"


def name_fits(d: Dialect, name: str, hay: str) -> str:
    """Does a telling word of a company's name stand in the site's address or title?"""
    words = d.filt(d.split(d.sub(f"lower({name})", "[^a-z0-9]+", " "), " "), "w", f"length(w) >= 4 AND w NOT IN ({d.strings(fixed.GENERIC_NAME_WORDS)})")
    clean, tight = d.sub(f"lower({hay})", "[^a-z0-9]+", " "), d.sub(f"lower({hay})", "[^a-z0-9]+")
    fitting = d.filt(words, "w", f"{d.contains(clean, 'w')} OR {d.contains(tight, 'w')}")
    return f"{d.size(fitting)} > 0"


@query
def name_matches_site(d):
    return f"SELECT site, {name_fits(d, 'company_name', 'hay')} AS fits FROM (SELECT site, company_name, concat(domain, ' ', title) AS hay FROM company_candidate)"


@relation
def assessed(d):
    from ..functions import urls

    return f"""
SELECT site, looked_up, company_name, indexed, website_matches, has_headcount, consistent, verifiable, declared, fits, CASE WHEN record_id IS NULL THEN 'none' WHEN NOT verifiable THEN 'low' WHEN website_matches AND has_headcount AND consistent THEN 'high' WHEN declared AND has_headcount AND consistent AND fits THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN indexed IS NULL THEN 'unknown' WHEN indexed = 0 THEN 'none' WHEN indexed < 20 THEN 'thin' ELSE 'ok' END AS coverage FROM (
  SELECT c.site, c.looked_up, c.record_id, c.company_name, c.indexed, coalesce({urls.registrable_domain(d, 'c.website')} = c.domain, false) AS website_matches, c.headcount > 0 OR c.size_range IS NOT NULL AS has_headcount, NOT (c.headcount = 0 AND c.size_range IS NOT NULL) AS consistent,
    c.indexed IS NULL OR c.indexed > 0 AS verifiable, c.method = 'homepage_link' AS declared, n.fits FROM company_candidate c JOIN name_matches_site n ON c.site = n.site)"""


@query
def assess_candidate(d):
    return "SELECT site, confidence, coverage, website_matches, has_headcount, consistent, verifiable FROM assessed"


@query
def rejection_reason(d):
    """Why a company record was not taken, in words."""
    cases = d.array("CASE WHEN NOT website_matches THEN 'website differs' ELSE '' END", "CASE WHEN NOT has_headcount THEN 'no headcount' ELSE '' END", "CASE WHEN NOT consistent THEN 'headcount contradicts size' ELSE '' END", "CASE WHEN NOT verifiable THEN 'nobody indexed' ELSE '' END", "CASE WHEN NOT website_matches AND NOT declared THEN 'not linked from the homepage' ELSE '' END", "CASE WHEN declared AND NOT fits THEN 'name not on the site' ELSE '' END")
    return f"SELECT site, coalesce(nullif({d.join(d.filt(cases, 'x', 'x <> ' + chr(39) * 2), '; ')}, ''), 'low confidence') AS reason FROM assessed WHERE confidence IN ('none', 'low')"


@query
def attach_activity(d):
    """A site's activity block from the cache; without one it was not looked up, which is no zero."""
    return "SELECT e.site, coalesce(a.confidence, 'not_looked_up') AS status, a.coverage, CASE WHEN a.confidence IN ('high', 'medium') THEN a.indexed END AS indexed FROM evidence e LEFT JOIN (SELECT * FROM assessed WHERE looked_up) a ON e.site = a.site"


def replaced(d: Dialect, notes: str, prefix: str, note: str) -> str:
    """A list of notes, each once, without those of a prefix and with another one at its end, if there is one."""
    kept = d.filt(d.distinct(notes), "x", f"NOT {d.starts('x', d.lit(prefix))}")
    return f"CASE WHEN {note} IS NULL THEN {kept} ELSE {d.append(kept, note)} END"


ACTIVITY_NOTE = "Employee posting activity:"


@relation
def noted_evidence(d):
    """What was not observed of a site, after its activity was attached: earlier notes on activity go, and one says why there is none."""
    why = f"CASE WHEN a.status = 'not_looked_up' THEN {d.lit(ACTIVITY_NOTE + ' not looked up, so the category rests on the website alone.')} WHEN a.status NOT IN ('high', 'medium') THEN concat({d.lit(ACTIVITY_NOTE + ' no company matched (')}, coalesce(r.reason, a.status), ').') END"
    return f"SELECT site, {replaced(d, 'not_observed', ACTIVITY_NOTE, 'why')} AS notes FROM (SELECT e.site, e.not_observed, {why} AS why FROM evidence_note e JOIN attach_activity a ON e.site = a.site LEFT JOIN rejection_reason r ON e.site = r.site)"


@query
def not_observed_list(d):
    return f"SELECT site, {d.join('notes', ' | ')} AS not_observed, {d.size('notes')} AS n FROM noted_evidence"


@query
def evidence_block(d):
    """What is kept of a matched company: a summary without the record, with at most eight competitors."""
    return f"""
SELECT a.site, a.confidence, a.coverage, CASE WHEN a.confidence IN ('high', 'medium') THEN a.company_name END AS company_name, CASE WHEN a.confidence IN ('high', 'medium') THEN r.rivals END AS competitors
FROM assessed a LEFT JOIN (SELECT site, {d.join(d.lists('name', 'ord'), ', ')} AS rivals FROM rival WHERE ord < 8 GROUP BY site) r ON a.site = r.site"""
