"""Rules against labelled examples, boundaries and invariants."""

import pytest
from pyspark.sql import functions as F

from tessellate.functions import column, fixed, numbers, urls
from tessellate.operators import sampling
from tessellate.plans.dialect import SPARK

#: URL paths and their sections, written down by hand.
LABELLED = [
    ("/blog/post", "blog"), ("/blogs/post", "unclassified"), ("/insights", "blog"), ("/customers/acme", "case_study"), ("/case-studies", "case_study"), ("/recipes/pie", "recipe"), ("/learn/x", "resource"), ("/whitepapers/a", "guide_ebook"),
    ("/newsroom", "news_press"), ("/about/news", "news_press"), ("/company/newsroom", "news_press"), ("/events/2024", "event_webinar"), ("/podcast", "podcast_video"), ("/careers/open", "careers"), ("/life-at-acme", "culture"), ("/our-people", "culture"),
    ("/about-us", "about"), ("/about-acme", "about"), ("/docs", "docs_support"), ("/stores", "locations"), ("/store/x", "catalog_listing"), ("/products/x", "product"), ("/use-cases/y", "solutions"), ("/pricing", "pricing"), ("/integrations", "partner_integration"),
    ("/privacy-notice", "legal"), ("/x/tag/y", "author_tag_taxonomy"), ("/request-demo", "contact_demo"), ("/", "home"), ("/2021/11/18/slug", "blog"), ("/2021/11/18", "author_tag_taxonomy"), ("/2021/11", "author_tag_taxonomy"), ("/2021/11/slug", "unclassified"),
    ("/presse", "news_press"), ("/nyheter/a", "news_press"), ("/blogg", "blog"), ("/karriere", "careers"), ("/chi-siamo", "about"), ("/impressum", "legal"), ("/kontakt", "contact_demo"), ("/producten", "product"), ("/p/1", "catalog_listing"), ("/p/", "unclassified"),
    ("/copy-of-home", "cms_cruft"), ("/lorem-ipsum", "cms_cruft"), ("/lorem-page", "unclassified"), ("/stampa", "unclassified"), ("/data/x", "unclassified"), ("/blog\n", "unclassified"),
]


def value(spark, text):
    return spark.sql(f"SELECT {text} AS v").first()["v"]


def test_sections(spark):
    df = spark.createDataFrame(LABELLED, "p string, want string").withColumn("got", column(urls.section, "p"))
    assert [r for r in df.collect() if r.got != r.want] == []


@pytest.mark.parametrize(
    ("typed", "want"),
    [("HubSpot.com.", "hubspot.com"), ("https://a.b/x?y", "a.b"), ("12345", None), ("a..b", None), ("x.test", None), ("", None), ("a b.com", None), ("http://u@h.io:8080/", "h.io")],
)
def test_normalized_domain(spark, typed, want):
    assert value(spark, urls.normalized_domain(SPARK, SPARK.lit(typed))) == want


@pytest.mark.parametrize(("x", "want"), [("www.a.co.uk", "a.co.uk"), ("https://www2.x.y.com/z", "y.com"), ("co.uk", "co.uk"), ("10.0.0.1", None), ("localhost", None), ("a.b.com.au", "b.com.au")])
def test_registrable_domain(spark, x, want):
    assert value(spark, urls.registrable_domain(SPARK, SPARK.lit(x))) == want


@pytest.mark.parametrize(("ip", "blocked"), [("10.1.1.1", True), ("100.63.0.1", False), ("100.64.0.1", True), ("172.31.0.1", True), ("172.32.0.1", False), ("192.0.2.9", True), ("8.8.8.8", False), ("223.0.0.1", False), ("224.0.0.1", True), ("1.2.3", True), ("1.2.3.256", True)])
def test_reserved_addresses(spark, ip, blocked):
    assert value(spark, urls.ipv4_blocked(SPARK, SPARK.lit(ip))) is blocked


def test_bands_at_their_points_and_outside(spark):
    for points in (fixed.VOLUME, fixed.RECENCY, fixed.DECISION_MAKERS):
        for x, y in points:
            assert value(spark, numbers.piecewise(SPARK, str(x), points)) == pytest.approx(y)
        assert value(spark, numbers.piecewise(SPARK, "1000000", points)) == points[-1][1]
        assert value(spark, numbers.piecewise(SPARK, "-5", points)) == points[0][1]
    assert value(spark, numbers.piecewise(SPARK, "CAST(NULL AS DOUBLE)", fixed.VOLUME)) is None


def test_grades_at_their_bounds(spark):
    for score, want in ((85, "A"), (84.9, "B"), (70, "B"), (55, "C"), (54.9, "D"), (40, "D"), (39.9, "F"), (0, "F")):
        assert value(spark, numbers.grade(f"{score}e0", fixed.GRADES)) == want


def test_weights_sum_up():
    assert sum(fixed.SHARE_WEIGHTS.values()) == 100
    assert sum(fixed.CATEGORY_WEIGHTS.values()) == pytest.approx(1)


def test_hashes_agree_with_python(spark):
    for name in ("nvidia.com", "a", "site1.com::blog"):
        assert value(spark, numbers.fnv1a(SPARK, SPARK.lit(name))) == sampling.seed(name)
    assert sampling.seed("nvidia.com") == 697408589


def test_rounding_is_half_up(spark):
    for x, want in (("2.25", 2.3), ("-2.25", -2.2), ("0.05", 0.1)):
        assert value(spark, SPARK.r1(f"CAST({x} AS DOUBLE)")) == want


def test_draw_is_stable_and_within_bounds():
    assert sampling.drawn(100, 5, "d::s") == sampling.drawn(100, 5, "d::s")
    assert len(set(sampling.drawn(7, 7, "x"))) == 7


def test_columns_compose(spark):
    df = spark.createDataFrame([("/blog/a",), ("/x",)], "p string").filter(column(urls.shareable, f"({urls.section(SPARK, 'p')})"))
    assert [r.p for r in df.select("p", F.lit(1)).collect()] == ["/blog/a"]
