"""robots.txt: grammar, group selection, path rules, posture towards AI agents, content signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, numbers
from ..plans.dialect import Dialect
from ..plans.registry import frame, over, query, relation
from ..sources.scratch import kept

PATHS = ["/", "/private/x", "/private/open/y", "/a", "/doc.pdf", "/doc.pdf?x", "/search", "/search/about/us"]


def rule_pattern(d: Dialect, path: str) -> str:
    """The pattern of a path rule: * is anything, $ the end, all else itself."""
    escaped = f"regexp_replace({path}, {d.lit('([.+?^{}()|' + chr(92) + '[' + chr(92) + ']' + chr(92) * 2 + '])')}, {d.lit(chr(92) * 2 + d.group(1))}" + (")" if d.spark else ", 'g')")
    return f"concat('^', replace({escaped}, '*', '.*'))"


@relation
def robots_lines(d):
    return d.explode("site, host", "robots_txt" if d.spark else "robots_txt", d.split("coalesce(body, '')", "\n"), "raw", "idx")


@frame("robots_lines", "robots_txt")
def lines(files: DataFrame) -> DataFrame:
    """Spark's form: files are dealt out by site before they are cut, as few bytes of a table may be many lines; all that goes by site then needs no other shuffle."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "site").select("site", "host", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n", -1)).alias("idx", "raw")).select("site", "host", "raw", "idx")


def by_file(files: DataFrame, relation: str) -> DataFrame:
    """A relation of one row a site that hangs on what its robots file says: files that say the same are read once, and every site gets the row of its file. A site with several files is read by itself."""
    sites = files.groupBy("site").agg(F.count("*").alias("n"), F.first("body").alias("body"))
    alone = sites.filter("n = 1 AND body IS NOT NULL").select("site", "body")
    texts = kept(alone.groupBy("body").agg(F.min("site").alias("twin")), "robots-texts")
    several = files.join(sites.filter("n > 1").select("site"), "site", "left_semi").select("site", "host", "body")
    read = texts.select(F.col("twin").alias("site"), F.lit(None).cast("string").alias("host"), "body").unionByName(several)
    found = kept(over(files.sparkSession, relation, robots_txt=read), relation)
    said = texts.join(found.withColumnRenamed("site", "twin"), "twin").drop("twin")
    own = found.join(sites.filter("n > 1").select("site"), "site", "left_semi")
    return alone.join(said, "body").select(found.columns).unionByName(own)


@relation
def robots_line(d):
    """Lines that say something, each in the group it belongs to: an agent line after anything else opens a group; rules before any agent are everyone's."""
    cut = d.trim(d.sub("raw", "#.*"))
    return f"""
SELECT site, idx, field, value, CAST(sum(CASE WHEN field = 'user-agent' AND coalesce(previous, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM (
  SELECT *, lag(field) OVER (PARTITION BY site ORDER BY idx) AS previous FROM (
    SELECT site, idx, lower({d.trim(d.ext('line', '^([^:]*):'))}) AS field, {d.trim(d.ext('line', '^[^:]*:(.*)'))} AS value FROM (SELECT site, idx, {cut} AS line FROM robots_lines) WHERE {d.contains('line', d.lit(':'))}))"""


@relation
def robots_agent(d):
    return """
SELECT site, grp, lower(value) AS token, idx FROM robots_line WHERE field = 'user-agent'
UNION ALL SELECT DISTINCT site, 0 AS grp, '*' AS token, -1 AS idx FROM robots_line WHERE grp = 0 AND field <> 'sitemap'"""


@relation
def robots_group(d):
    delay = f"CASE WHEN field = 'crawl-delay' THEN CASE WHEN value = '' THEN {d.dbl('0')} WHEN {d.rx('value', r'^[0-9]+([.][0-9]+)?\z')} THEN {d.dbl('value')} END END"
    return f"""
SELECT a.site, a.grp, a.agents, coalesce(r.rules, 0) AS rules, r.crawl_delay, r.content_signal FROM (SELECT site, grp, {d.join(d.lists('token', 'idx'), ' ')} AS agents FROM robots_agent GROUP BY site, grp) a
LEFT JOIN (SELECT site, grp, {d.count_if("field IN ('allow', 'disallow')")} AS rules, max_by({delay}, CASE WHEN ({delay}) IS NOT NULL THEN idx END) AS crawl_delay,
  max_by(value, CASE WHEN field = 'content-signal' THEN idx END) AS content_signal FROM (SELECT *, CASE WHEN field = 'crawl-delay' AND NOT {d.rx('value', r'^([0-9]+([.][0-9]+)?)?\z')} THEN true ELSE false END AS bad FROM robots_line) WHERE field <> 'user-agent' AND NOT bad GROUP BY site, grp) r
ON a.site = r.site AND a.grp = r.grp"""


@query
def robots_parse(d):
    """Groups with their agents, and their rules as they stand, in order."""
    rules = d.join(d.lists("concat(field, ': ', value)", "idx"), " | ")
    return f"""
SELECT g.site, g.grp, g.agents, g.rules, g.crawl_delay, g.content_signal, r.rule_list FROM robots_group g
LEFT JOIN (SELECT site, grp, {rules} AS rule_list FROM robots_line WHERE field IN ('allow', 'disallow') GROUP BY site, grp) r ON g.site = r.site AND g.grp = r.grp"""


@query
def robots_unknown(d):
    """Directives that are none of the grammar's, with their values."""
    return "SELECT site, idx, field, value FROM robots_line WHERE field NOT IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'content-signal', 'sitemap')"


@query
def robots_sitemaps(d):
    return "SELECT DISTINCT site, value AS sitemap FROM robots_line WHERE field = 'sitemap' AND value <> ''"


@query
def crawl_delay(d):
    """The pause between requests in ms: what everyone's group asks for, at most two seconds."""
    return f"SELECT site, least(min_by(crawl_delay, grp) * 1000, 2000) AS delay_ms FROM robots_group WHERE {d.has(d.split('agents', ' '), d.lit('*'))} AND crawl_delay IS NOT NULL GROUP BY site"


@relation
def robots_site(d):
    """Spark's form of a file: one row a site with its agents, each with its group, and its rules that say something."""
    rule = f"struct(grp, field = 'allow' AS allow, value AS path, {rule_pattern(d, 'value')} AS pattern, NOT {d.rx('value', '[*$]')} AS plain, length({d.sub('value', '[$]$')}) AS weight)"
    return f"""
SELECT site, CASE WHEN opened THEN concat(named, array(struct('*' AS token, 0 AS grp))) ELSE named END AS tokens, rules FROM (
  SELECT site, collect_list(CASE WHEN field = 'user-agent' THEN struct(lower(value) AS token, grp) END) AS named, max(grp = 0 AND field <> 'sitemap') AS opened,
    collect_list(CASE WHEN field IN ('allow', 'disallow') AND value <> '' THEN {rule} END) AS rules FROM robots_line GROUP BY site)"""


@relation
def robots_agents(d):
    """Spark's form: a row a site with every agent, whether the file names it, and the groups whose rules hold for it. So sites are multiplied by agents (and paths) only as rows leave, behind all shuffles."""
    hits = "filter(tokens, t -> t.token <> '*' AND contains(lower(a.agent), t.token))"
    own = f"array_max(transform({hits}, t -> struct(length(t.token) * 1000000 - t.grp AS weight, t.grp AS grp))).grp"
    return f"""
SELECT site, rules, transform(owned, a -> struct(a.ord AS ord, a.agent AS agent, a.kind AS kind, a.named AS named, CASE WHEN a.own IS NULL THEN everyones ELSE array(a.own) END AS grps)) AS agents FROM (
  SELECT site, rules, array_sort(array_distinct(transform(filter(tokens, t -> t.token = '*'), t -> t.grp))) AS everyones,
    transform(known, a -> struct(a.ord AS ord, a.agent AS agent, a.kind AS kind, exists(tokens, t -> t.token = lower(a.agent)) AS named, {own} AS own)) AS owned
  FROM robots_site CROSS JOIN (SELECT collect_list(struct(ord, agent, kind)) AS known FROM ai_agent))"""


def matching(path: str) -> str:
    """Spark's form: the rules of a site that match a path."""
    return f"filter(rules, r -> CASE WHEN r.plain THEN startswith({path}, r.path) ELSE {path} RLIKE r.pattern END)"


def verdict(matches: str, grps: str) -> str:
    """Spark's form of allowed(): what the matching rules of some groups say."""
    longest = lambda kind: f"coalesce(array_max(transform(filter({matches}, r -> {kind} AND array_contains({grps}, r.grp)), r -> r.weight)), -1)"
    return f"({longest('NOT r.allow')} = -1 OR {longest('r.allow')} >= {longest('NOT r.allow')})"


@relation
def agent_group(d):
    """The groups whose rules hold for an agent: the one with its longest token, else all of everyone's."""
    hit = f"a.token <> '*' AND {d.contains('lower(g.agent)', 'a.token')}"
    if d.spark:
        return "SELECT site, a.agent, a.kind, a.ord, grp FROM robots_agents LATERAL VIEW explode(agents) _a AS a LATERAL VIEW explode(a.grps) _g AS grp"
    return f"""
SELECT site, agent, kind, ord, grp FROM (
  SELECT a.site, g.agent, g.kind, g.ord, a.grp, row_number() OVER (PARTITION BY a.site, g.agent ORDER BY length(a.token) DESC, a.grp) AS nth FROM robots_agent a CROSS JOIN ai_agent g WHERE {hit}) WHERE nth = 1
UNION ALL
SELECT DISTINCT a.site, g.agent, g.kind, g.ord, a.grp FROM robots_agent a CROSS JOIN ai_agent g
LEFT JOIN (SELECT DISTINCT b.site, h.agent AS named FROM robots_agent b CROSS JOIN ai_agent h WHERE b.token <> '*' AND {d.contains('lower(h.agent)', 'b.token')}) n ON n.site = a.site AND n.named = g.agent
WHERE a.token = '*' AND n.named IS NULL"""


@query
def robots_group_select(d):
    return "SELECT site, agent, grp FROM agent_group"


@relation
def robots_rule(d):
    return f"SELECT site, grp, field AS kind, value AS path, {rule_pattern(d, 'value')} AS pattern, NOT {d.rx('value', '[*$]')} AS plain, length({d.sub('value', '[$]$')}) AS weight FROM robots_line WHERE field IN ('allow', 'disallow') AND value <> ''"


def allowed(d: Dialect, cases: str, keys: str, path: str) -> str:
    """Of each case (site, agent, path ...): the longest rule that matches decides, allow wins a tie."""
    hit = f"regexp_matches({path}, r.pattern)" if not d.spark else f"CASE WHEN r.plain THEN startswith({path}, r.path) ELSE {path} RLIKE r.pattern END"
    return f"""
SELECT {keys}, coalesce(max(CASE WHEN r.kind = 'disallow' THEN r.weight END), -1) = -1 OR coalesce(max(CASE WHEN r.kind = 'allow' THEN r.weight END), -1) >= coalesce(max(CASE WHEN r.kind = 'disallow' THEN r.weight END), -1) AS allowed
FROM {cases} LEFT JOIN robots_rule r ON c.site = r.site AND c.grp = r.grp AND {hit} GROUP BY {keys}"""


@query
def robots_allowed(d):
    """Spark decides once for each path and each set of groups that holds for some agent of a site."""
    if d.spark:
        cells = f"transform({d.array(*(d.lit(p) for p in PATHS))}, p -> struct(p AS path, {matching('p')} AS matches))"
        return f"""
SELECT site, a.agent, v.path, v.allowed FROM (
  SELECT site, agents, transform(array_distinct(transform(agents, a -> a.grps)), g -> struct(g AS grps, transform(cells, c -> struct(c.path AS path, {verdict('c.matches', 'g')} AS allowed)) AS verdicts)) AS cases FROM (SELECT site, agents, {cells} AS cells FROM robots_agents))
LATERAL VIEW explode(filter(agents, x -> size(x.grps) > 0)) _a AS a LATERAL VIEW explode(try_element_at(filter(cases, x -> x.grps = a.grps), 1).verdicts) _v AS v"""
    paths = d.explode("site, agent, grp", "agent_group", d.array(*(d.lit(p) for p in PATHS)), "path", "idx")
    return allowed(d, f"({paths}) c", "c.site, c.agent, c.path", "c.path")


@relation
def robots_access(d):
    """Spark's form of agent_access: a row a site with a robots file, and how many files it has."""
    return f"""
SELECT s.site, s.files, transform(coalesce(k.agents, n.everyone), a -> struct(a.ord AS ord, a.agent AS agent, a.kind AS kind, a.named AS named, a.allowed AS allowed)) AS agents
FROM (SELECT site, CAST(count(*) AS INTEGER) AS files FROM robots_txt WHERE body IS NOT NULL GROUP BY site) s
LEFT JOIN (SELECT site, transform(agents, a -> struct(a.ord AS ord, a.agent AS agent, a.kind AS kind, a.named AS named, {verdict('matches', 'a.grps')} AS allowed)) AS agents FROM (
  SELECT site, agents, {matching("'/'")} AS matches FROM robots_agents)) k ON s.site = k.site
CROSS JOIN (SELECT collect_list(struct(ord, agent, kind, false AS named, true AS allowed)) AS everyone FROM ai_agent) n"""


@relation
def agent_access(d):
    """Of every site with a robots file and every agent: may it read the root?"""
    if d.spark:
        return "SELECT site, a.ord, a.agent, a.kind, a.allowed AS root_allowed, a.named FROM robots_access LATERAL VIEW explode(flatten(array_repeat(agents, files))) _a AS a"
    known = allowed(d, "(SELECT *, '/' AS path FROM agent_group) c", "c.site, c.agent", "c.path")
    return f"""
SELECT s.site, g.ord, g.agent, g.kind, coalesce(k.allowed, true) AS root_allowed, n.token IS NOT NULL AS named
FROM (SELECT site FROM robots_txt WHERE body IS NOT NULL) s CROSS JOIN ai_agent g LEFT JOIN ({known}) k ON k.site = s.site AND k.agent = g.agent
LEFT JOIN (SELECT DISTINCT site, token FROM robots_agent) n ON n.site = s.site AND n.token = lower(g.agent)"""


@query
def ai_posture(d):
    return "SELECT site, agent, kind, named, root_allowed, CASE WHEN named THEN 'own group' ELSE 'wildcard group' END AS basis FROM agent_access"


@query
def robots_by_host(d):
    """May a page be fetched, by the robots file of its own host? Without a file it may."""
    pages = "(SELECT page_id, site, path FROM wanted_page)"
    known = allowed(d, f"(SELECT p.page_id, p.path, g.site, g.grp FROM {pages} p JOIN (SELECT site, grp FROM agent_group WHERE ord = 8) g ON p.site = g.site) c", "c.page_id", "c.path")
    return f"SELECT p.page_id, p.path, coalesce(k.allowed, true) AS allowed FROM {pages} p LEFT JOIN ({known}) k ON p.page_id = k.page_id"


@relation
def robots_signal(d):
    """Spark's form of the groups' content signals, of the lines that hold them alone."""
    return "SELECT site, grp, max_by(value, idx) AS content_signal FROM robots_line WHERE field = 'content-signal' GROUP BY site, grp"


@relation
def content_signal(d):
    parts = d.explode("site, grp, content_signal", f"(SELECT * FROM {'robots_signal' if d.spark else 'robots_group'} WHERE content_signal IS NOT NULL AND content_signal <> '')", d.split("content_signal", ","), "part", "idx")
    key, value = f"lower({d.trim(d.ext('part', '^([^=]*)'))})", f"lower({d.trim(d.ext('part', '^[^=]*=([^=]*)'))})"
    return f"SELECT site, grp, content_signal, name, max_by(setting, idx) AS setting FROM (SELECT site, grp, content_signal, {key} AS name, {value} AS setting, idx FROM ({parts})) WHERE name <> '' GROUP BY site, grp, content_signal, name"


@query
def content_signal_map(d):
    return "SELECT site, grp, name, setting FROM content_signal"


#: The kinds of agents that serve what a group's signals grant.
GRANTS = "SELECT DISTINCT site, grp, content_signal, k.kind FROM content_signal JOIN (SELECT * FROM (VALUES ('search', 'yes', 'search'), ('ai-input', 'yes', 'search'), ('ai-input', 'yes', 'user-fetch'), ('use', 'reference', 'search'), ('use', 'reference', 'user-fetch'), ('use', 'excerpt', 'search'), ('use', 'excerpt', 'user-fetch'), ('use', 'full', 'search'), ('use', 'full', 'user-fetch')) AS _g(grant_name, grant_value, kind)) k ON name = k.grant_name AND setting = k.grant_value"


@query
def signal_contradictions(d):
    """Signals that grant a use while agents of just the kind that serves it are blocked."""
    return f"""
SELECT s.site, s.grp, s.content_signal, {d.join(d.lists('a.agent', 'a.ord'), ', ')} AS blocked_agents, CAST(count(*) AS BIGINT) AS n_blocked FROM (
  {GRANTS}) s
JOIN agent_access a ON a.site = s.site AND a.kind = s.kind AND NOT a.root_allowed GROUP BY s.site, s.grp, s.content_signal"""


@query
def blocklist_match(d):
    """Sites that block everything on the list that the usual one-click rule writes."""
    return f"SELECT site, {d.count_if('NOT root_allowed')} AS blocked, {d.count_if(f'NOT root_allowed AND lower(agent) IN ({d.strings(fixed.ONE_CLICK_BLOCKLIST)})')} = {len(fixed.ONE_CLICK_BLOCKLIST)} AS one_click FROM agent_access GROUP BY site"


@query
def ai_access_score(d):
    weight = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in fixed.ACCESS_WEIGHTS.items()) + " END"
    return f"SELECT site, {d.r1(f'{d.dbl(f'sum(CASE WHEN root_allowed THEN {weight} ELSE 0 END)')} / {d.dbl(f'sum({weight})')} * 45')} AS access_points FROM agent_access GROUP BY site"
