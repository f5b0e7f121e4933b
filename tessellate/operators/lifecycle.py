"""Runs over time: request logs, caches, budgets, job states and leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, urls
from ..plans.adapters import NOW_EVENTS
from ..plans.registry import frame, query, relation

NOW = f"TIMESTAMP '{NOW_EVENTS}'"


@query
def fetch_log_rollup(d):
    return f"SELECT host, CAST(count(*) AS BIGINT) AS requests_made, CAST(sum(bytes) AS BIGINT) AS bytes_downloaded, {d.count_if('status <> 200')} AS failed, CAST(max(ms) AS BIGINT) AS slowest_ms FROM request GROUP BY host"


@query
def run_log_stats(d):
    """Throughput of a day's run, its failures, and the seconds that a thousand more would take."""
    return f"SELECT {d.day('ts')} AS day, CAST(count(*) AS BIGINT) AS runs, {d.count_if('status = 200')} AS succeeded, {d.count_if('status <> 200')} AS failed, CAST(CASE WHEN max(t) > min(t) THEN floor({d.dbl('max(t) - min(t)')} / count(*) * 1000 + 0.5) END AS BIGINT) AS eta_s FROM request GROUP BY {d.day('ts')}"


@query
def credit_ledger(d):
    return f"SELECT {d.month('ts')} AS month, CAST(sum(cost) AS BIGINT) AS used, CAST(count(*) AS BIGINT) AS calls, sum(cost) > 40000 AS over_cap FROM request GROUP BY {d.month('ts')}"


@query
def rate_window(d):
    """Requests of a client in the hour up to each of its own. An upper bound of what the limiter counts, which does not count refused ones."""
    return "SELECT id, client, CAST(count(*) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_hour FROM request"


@query
def cache_lookup(d):
    """The entry that answers for a key: fresh by its own start, failures in the writable cache only for an hour; writable first, then seeds."""
    ttl = "CASE WHEN source_ord = 0 AND failure THEN 3600 ELSE 30 * 86400 END"
    return f"SELECT cache_key, id, source_ord FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY source_ord, started DESC, id) AS nth FROM cache_entry WHERE {d.seconds(NOW)} - started <= {ttl}) WHERE nth = 1"


@query
def activity_cache(d):
    """Matched companies for thirty days, unmatched ones for seven; lookups that the budget cut short are never kept."""
    return f"SELECT id, status, fresh FROM (SELECT id, CASE WHEN failure THEN 'ceiling' WHEN source_ord = 0 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN failure THEN false ELSE {d.seconds(NOW)} - started <= CASE WHEN source_ord = 0 THEN 30 ELSE 7 END * 86400 END AS fresh FROM cache_entry)"


@query
def prewarm_todo(d):
    """Requested sites without a fresh entry, and those whose entry is a failure."""
    return f"""
SELECT q.host, CASE WHEN k.cache_key IS NULL THEN 'missing' ELSE 'failed' END AS why FROM (SELECT DISTINCT host FROM wanted_site) q
LEFT JOIN (SELECT l.cache_key, e.failure FROM cache_lookup l JOIN cache_entry e ON l.id = e.id) k ON {urls.cache_key(d, 'q.host')} = k.cache_key WHERE k.cache_key IS NULL OR k.failure"""


@query
def job_state_latest(d):
    """A host's run as it stands: ready or error if it ended, running or queued else; what ran too long has failed."""
    last = "max(struct(t, id, state))" if d.spark else "max({'t': t, 'id': id, 'state': state})"
    return f"SELECT host, CASE WHEN s.state = 'running' AND {d.seconds(NOW)} - s.t > 150 THEN 'error' ELSE s.state END AS state, s.id AS id FROM (SELECT host, {last} AS s FROM job_event GROUP BY host)"


@query
def leads_append(d):
    """Leads as they are kept: the newest fields of each, cut to length, with the time they came."""
    return f"SELECT id, host AS domain, substring(name, 1, 200) AS name, {d.day('ts')} AS received, challenge FROM lead_form"


@query
def origin_resolve(d):
    """The first address that answered a client, of a site's two, and how often it was tried."""
    return "SELECT host, client, min_by(origin, CASE WHEN ok THEN t * 1000000 + id END) AS origin, CAST(count(*) AS BIGINT) AS attempts FROM origin_attempt GROUP BY host, client"


@query
def language_resolution(d):
    """Which page is read in English: a declared alternate, else a path that answers, of at most eight tries."""
    return """
SELECT host, how, candidate FROM (SELECT host, how, candidate, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN how = 'hreflang' THEN 0 ELSE 1 END, id) AS nth FROM (
  SELECT host, id, status, how, candidate, row_number() OVER (PARTITION BY host ORDER BY id) AS tried FROM language_try) WHERE tried <= 8 AND status = 200) WHERE nth = 1"""


@frame("scanned_file", "evidence_file")
def scanned(files: DataFrame) -> DataFrame:
    """files(path, body) -> (path, readable, site, host, canonical_urls, robots_fetched, not_observed): what the JSON of each says; one that cannot be read has its path alone."""
    schema = "meta struct<site: long, normalized_host: string>, canonical_urls long, robots struct<present: boolean>, not_observed array<string>, _corrupt_record string"
    read = files.select("path", F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    good = F.col("e").isNotNull() & F.col("e._corrupt_record").isNull()
    kept = lambda c: F.when(good, F.col(c))
    return read.select("path", good.alias("readable"), kept("e.meta.site").alias("site"), kept("e.meta.normalized_host").alias("host"), kept("e.canonical_urls").alias("canonical_urls"), kept("e.robots.present").alias("robots_fetched"), kept("e.not_observed").alias("not_observed"))


@relation
def scanned_file(d):
    get = lambda p: f"CASE WHEN ok THEN json_extract_string(body, '{p}') END"
    return f"""
SELECT path, ok AS readable, CAST({get('$.meta.site')} AS BIGINT) AS site, {get('$.meta.normalized_host')} AS host, CAST({get('$.canonical_urls')} AS BIGINT) AS canonical_urls, CAST({get('$.robots.present')} AS BOOLEAN) AS robots_fetched, CASE WHEN ok THEN json_extract_string(body, '$.not_observed[*]') END AS not_observed
FROM (SELECT path, body, json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END) = 'OBJECT' AS ok FROM evidence_file)"""


@query
def evidence_scan(d):
    """What a scan of evidence files finds, a row a file that can be read."""
    return f"SELECT site, host, canonical_urls, robots_fetched, {d.size('not_observed')} AS notes FROM scanned_file WHERE readable"


@query
def evidence_rejects(d):
    """Files of a scan that cannot be read: they stop nothing, and are named."""
    return "SELECT path FROM scanned_file WHERE NOT readable"


@query
def report_numbers(d):
    """The figures that a report prints: the score to a tenth, its place among all graded sites."""
    return f"""
SELECT g.site, g.overall, CAST(r.better AS BIGINT) AS better, CAST(t.total AS BIGINT) AS graded_sites FROM graded g
JOIN (SELECT overall AS o, coalesce(sum(n) OVER (ORDER BY overall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS better FROM (SELECT overall, count(*) AS n FROM graded WHERE gradeable GROUP BY overall)) r ON g.overall = r.o
CROSS JOIN (SELECT count(*) AS total FROM graded WHERE gradeable) t WHERE g.gradeable"""
