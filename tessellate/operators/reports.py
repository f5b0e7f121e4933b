"""Reports as text: one page a site, from its scores and ranked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import frame, query

CATEGORIES = ("content_supply", "shareability", "employee_culture", "ai_discoverability")


def escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def long_date(ts: Column) -> Column:
    """A day in words, in UTC."""
    return F.date_format(ts, "MMMM d, yyyy")


def mail_encoded(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


@frame("report_text", "overall_grade", "rank_findings")
def report(graded: DataFrame, found: DataFrame, asof: str = "2024-01-31") -> DataFrame:
    """(site, html): the head line with its date, the category bars and the findings in their order. Sites without a grade say why."""
    actions = found.filter("kind = 'action'").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("nth", "finding"))).alias("actions"))
    items = F.array_join(F.transform("actions", lambda x: F.concat(F.lit("<li>"), escaped(F.replace(x["finding"], F.lit("_"), F.lit(" "))), F.lit("</li>"))), "")
    bars = F.concat(*(F.concat(F.lit(f'<div class="bar">{c.replace("_", " ")}: '), F.coalesce(F.col(c).cast("string"), F.lit("not scored")), F.lit("</div>")) for c in CATEGORIES))
    head = F.when(F.col("gradeable"), F.concat(F.lit("Grade "), "grade", F.lit(" ("), F.col("overall").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("No grade: "), F.coalesce("withheld_reason", F.lit(""))))
    share = F.concat(F.lit('<a href="mailto:?subject='), mail_encoded(F.concat(F.lit("Report of "), "host")), F.lit('">send</a>'))
    html = F.concat(F.lit("<h1>"), escaped(F.col("host")), F.lit("</h1><p>"), head, F.lit(", "), long_date(F.lit(asof).cast("date")), F.lit("</p>"), bars, F.lit("<ol>"), F.coalesce(items, F.lit("")), F.lit("</ol>"), share)
    return graded.join(actions, "site", "left").select("site", html.alias("html"))


@query
def report_text(d):
    """DuckDB's form of report()."""
    plain = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    bars = " || ".join(f"'<div class=\"bar\">{c.replace('_', ' ')}: ' || coalesce(CAST(g.{c} AS VARCHAR), 'not scored') || '</div>'" for c in CATEGORIES)
    return f"""
SELECT g.site, '<h1>' || {plain('g.host')} || '</h1><p>' || CASE WHEN g.gradeable THEN 'Grade ' || g.grade || ' (' || CAST(g.overall AS VARCHAR) || ')' ELSE 'No grade: ' || coalesce(g.withheld_reason, '') END || ', January 31, 2024</p>' || {bars}
  || '<ol>' || coalesce(f.items, '') || '</ol><a href=\"mailto:?subject=Report%20of%20' || g.host || '\">send</a>' AS html
FROM overall_grade g LEFT JOIN (SELECT site, string_agg('<li>' || replace(finding, '_', ' ') || '</li>', '' ORDER BY nth) AS items FROM rank_findings WHERE kind = 'action' GROUP BY site) f ON g.site = f.site"""


@query
def report_index(d):
    """The page that lists all reports: the best first, sites without a grade last, then by name."""
    return "SELECT nth, host, coalesce(grade, 'withheld') AS shown, concat('/report/', host) AS link FROM leaderboard"
