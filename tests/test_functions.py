"""Scalar functions, as tables of cases."""

import pytest
from pyspark.sql import functions as F

from tallysieve.functions import locations, salary, text, times, titles, urls


def values(spark, column, *cases):
    """The column over one-column rows of ``x``."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column.alias("v")).collect()]


def test_company_keys(spark):
    cases = {"The Acme Company, Inc.": "acme", "Birch's (YC W21)": "birch", "The Digital Solutions Group": "digital solutions group", "the": "", None: "", "  Dune & Sons ": "dune sons"}
    assert values(spark, text.norm_company(F.col("x")), *cases) == list(cases.values())


def test_role_keys(spark):
    cases = {"Software Engineer Intern (Fall 2026) - Austin, TX": "software engineer fall 2026 austin tx", "Software Engineer Intern - Fall 2026 - Austin - TX": "software engineer fall 2026 austin tx", "Data Co-Op": "data", "Interns": "interns", None: ""}
    assert values(spark, text.norm_role(F.col("x")), *cases) == list(cases.values())


def test_markup_becomes_sentences(spark):
    assert values(spark, text.flat_markup(F.col("x")), "Interns&#xa;ONLY", "<strong>Interns</strong> only", "a</li><li>b", None) == ["Interns . ONLY", "Interns  only", "a . . b", ""]


def test_plain_with_and_without_compatibility(spark):
    assert values(spark, text.plain(F.col("x")), "Café & Söhne!", "Łódź") == ["cafe and sohne", "odz"]
    assert values(spark, text.plain(F.col("x"), compatibility=True), "ﬁne Ａcme", None) == ["fine acme", ""]


@pytest.mark.parametrize(
    ("raw", "pay"),
    [
        ("pay $35/hr - $45/hr now", "$35/hr - $45/hr"), ("$20.50-$35/hour", "$20.50-$35/hour"), ("$ 25.00 to $40.00 per Hour", "$ 25.00 to $40.00 per Hour"),
        ("$80,000 - $120,000/yr", "$80,000 - $120,000/yr"), ("$80K – $120K", "$80K – $120K"), ("tuition reimbursement of $10,000", None), ("a bonus of $5K", None),
        ("a bonus of $5K and later on, much further down the page, base $95,000", "$95,000"), ("raised $18.3M", None), (None, None), ("$20oo$30", None),
    ],
)
def test_extract_salary(spark, raw, pay):
    assert values(spark, salary.extract_salary(F.col("x")), raw) == [pay]


def test_compact_salary(spark):
    cases = {"$4,000.00/wk - $6,000.00/wk": "$4–6k/wk", "$25/hr": "$25/hr", "$900 - $1,500/mo": "$900–2k/mo", "$39.50": "$40", "Competitive pay": "Competitive…", "DOE": "DOE", None: ""}
    assert values(spark, salary.compact_salary(F.col("x")), *cases) == list(cases.values())


def test_chip_salary(spark):
    cases = {"$25.00/hr - $25.00/hr": "$25/hr", "$4,000.00/wk - $6,000.00/wk": "$4,000–$6,000/wk", "$1,000": "$1,000", "none": None, "US$ soon": "US$ soon"}
    assert values(spark, salary.chip_salary(F.col("x")), *cases) == list(cases.values())


def test_split_locations(spark):
    cases = {
        "Austin, TXFort Mill, SC": ["Austin, TX", "Fort Mill, SC"], "London, UKParis, France": ["London, UK", "Paris, France"], "21 Locations": ["21 Locations"],
        "21 locationsBoston, MASanta Ana, CA": ["Boston, MA", "Santa Ana, CA"], "McLean, VA": ["McLean, VA"], "US | California | San Francisco": ["US | California | San Francisco"],
        "Flexible - Any SpaceX Site": ["Flexible - Any SpaceX Site"], "a; b": ["a", "b"], "": [], None: [],
    }
    assert values(spark, locations.split_locations(F.col("x")), *cases) == list(cases.values())


def test_normalized_locations(spark):
    assert values(spark, locations.normalized_locations(F.col("x")), "New York City, NY", "Austin, TX +1", "NYC · LA", None) == [["new york ny"], ["austin tx"], ["new york ny", "los angeles ca"], []]


def test_ages(spark):
    today = F.lit("2024-12-31").cast("date")
    assert values(spark, times.age_days(F.col("x"), today), "3d", " 4 D ", "2024-12-30", "2025-01-05", "2024-13-40", "soon", None) == [3, 4, 1, 0, None, None, None]
    assert values(spark, times.relative_days(F.col("x")), "Posted Today", "Posted Yesterday", "Posted 30+ Days Ago", "Recently", None) == [0, 1, 30, None, None]
    assert values(spark, F.unix_seconds(times.epoch_timestamp(F.col("x"))), "1692651521922", "1692651521", "9e30", "soon", None) == [1692651521, 1692651521, None, None, None]
    assert values(spark, times.relative_time(F.col("x").cast("long")), "20", "90", "5400", "172800", "2592000", "7776000") == ["just now", "2m ago", "2h ago", "2d ago", "1mo ago", "3mo ago"]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.linkedin.com/jobs/view/swe-at-acme-4012345678?trk=x", "linkedin:4012345678"),
        ("https://acme.wd5.myworkdayjobs.com/en-US/x/job/Austin/Intern_JR-12345-1", "workday:acme:jr12345"),
        ("https://acme.wd5.myworkdayjobs.com/x/job/Austin/Intern_JR12345", "workday:acme:jr12345"),
        ("https://boards.greenhouse.io/Acme/jobs/77?gh_src=1", "greenhouse:acme:77"),
        ("https://careers.example.com/Jobs/7/?utm_source=a&b=2&a=1", "url:careers.example.com/jobs/7?a=1&b=2"),
        ("https://careers.example.com/", "url:careers.example.com/"),
        ("https://careers.example.com/a%zz", "row:r"),
        ("not a url", "row:r"),
        (None, "row:r"),
    ],
)
def test_canonical_target(spark, url, key):
    assert values(spark, urls.canonical_target(F.lit("r"), F.col("x")), url) == [key]


def test_tracker_url_and_hrefs(spark):
    assert values(spark, urls.tracker_url(F.col("x")), "WWW.Example.com/a/?q=1", "https://example.com", "", None) == ["example.com/a", "example.com", "", ""]
    assert values(spark, urls.application_href(F.lit("u"), F.col("x"), F.lit(False)), "", None, "a") == ["", "u", "a"]
    assert values(spark, urls.display_href(F.lit("u"), F.col("x")), "", None, "a") == ["u", "u", "a"]


def test_title_features(spark):
    assert values(spark, titles.seasons(F.col("x")), "Autumn or Fall 2026", "none") == [["fall"], []]
    assert values(spark, titles.states(F.col("x")), "Intern in Austin, TX") == [["IN", "TX"]]
    assert values(spark, titles.company_words(F.col("x")), "The Acme Labs", "The Group", "Berries & Co") == [["acme"], ["the", "group"], ["berry"]]
    assert values(spark, titles.title_words(F.col("x"), F.lit("Acme"), F.lit("Austin, TX")), "Acme Software Engineering Intern, Summer 2026 - Austin") == [["software", "engineer", "intern"]]
