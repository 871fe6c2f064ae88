"""Gates and verdict rules: each fires, and near misses stay open."""

import pytest
from pyspark.sql import functions as F

from tallysieve.operators import gates, verdicts
from tests.test_functions import values


@pytest.mark.parametrize(
    ("title", "reason"),
    [
        ("Senior Software Engineer Intern", "Senior-level title"), ("Solutions Architecture Intern", None), ("Fellowship Intern", None), ("New Grad Engineer", "New-graduate role"),
        ("Software Engineering Co-op_Summer 2027", None), ("Backend Engineer", "No internship marker in title"), ("Software Engineer Student Assistant", None),
        ("Software Engineer II - Student Affairs", "No internship marker in title"), ("Summer Analyst - Core", None), ("International Sales", "No internship marker in title"), (None, "No internship marker in title"),
    ],
)
def test_title_gate(spark, title, reason):
    assert values(spark, gates.gate_reason(F.col("x"), F.lit("search")), title) == [reason]
    assert values(spark, gates.gate_reason(F.col("x"), F.lit("list")), title) == [None]


def gate(spark, title, description, company="Acme"):
    column = verdicts.insider_gate(F.lit(title), F.col("x"), F.lit(company))["label"]
    return values(spark, column, description)[0]


@pytest.mark.parametrize(
    ("title", "description", "label"),
    [
        ("Intern Conversion: Developer", None, "company's own intern-conversion req"),
        ("Returning Summer Analyst", "", "returning-intern-only req"),
        ("Returning student program intern", "", None),
        ("Intern", "This requisition is for an Acme intern returning in 2027.", verdicts.GROUP_LABELS["restricted"]),
        ("Intern", "This role is for curious people. Employees get lunch.", None),
        ("Intern", "Current Acme interns only.", verdicts.GROUP_LABELS["interns"]),
        ("Intern", "Housing is provided for our 2026 summer interns only.", None),
        ("Intern", "Housing is provided for our 2026 summer interns only. " + "x" * 90 + ". For current Acme interns only.", verdicts.GROUP_LABELS["interns"]),
        ("Intern", "(Lakeside Co-ops Only)", verdicts.GROUP_LABELS["named"]),
        ("Intern", "(Example State University Co-ops Only)", None),
        ("Intern", "(Summer Interns Only)", None),
        ("Intern", "Internal candidates only", "internal candidates only"),
        ("Intern", "completed an internship with us in 2025", verdicts.GROUP_LABELS["prior"]),
        ("Intern", "completed an internship with Zenith in 2025", None),
        ("Intern", "our veteran internship program", None),
        ("Veteran Intern", "our veteran internship program", verdicts.GROUP_LABELS["veteran"]),
        ("Intern", "currently on active duty", verdicts.GROUP_LABELS["military"]),
        ("Intern", "enrolled at a university in Germany", verdicts.GROUP_LABELS["region"]),
        ("Intern", "enrolled at a university in the United States", None),
    ],
)
def test_insider_gate(spark, title, description, label):
    assert gate(spark, title, description) == label


def test_school_degree_time_and_place(spark):
    school = verdicts.restricted_school(F.lit("Intern"), F.col("x"))
    assert values(spark, school, "Acme's Drexel Co-op Program", "Co-op with Example State University", "IBM co-op program", "Drexel Co-op US", None) == ["Drexel", None, None, "Drexel", None]
    assert values(spark, verdicts.is_graduate_only(F.col("x")), "enrolled in a master's degree", "enrolled in a PhD program or bachelor", None) == [True, False, False]
    assert values(spark, verdicts.is_full_time_only(F.col("x")), "a full-time position", "full-time position after the internship", None) == [True, False, False]
    assert values(spark, verdicts.foreign_place(F.col("x")), "London, UK", "London, UK or Austin, TX", "Remote in US", "Paris", None, "") == ["London", None, None, "Paris", None, None]


def corrected(spark, **fields):
    row = {"id": "1", "title": "Intern", "company": "Acme", "location": "Austin, TX", "description": "intern " * 60, "tier": "APPLY", "reason": "", "salary": ""} | fields
    names = list(row)
    return verdicts.corrected(spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names))).first()


def test_chain_order(spark):
    thin = corrected(spark, description="short")
    assert (thin.tier, thin.reason) == ("APPLY_CAVEAT", "Classified on title only — no description available")
    assert corrected(spark).tier == "APPLY"
    full = "a full-time position " * 12
    assert corrected(spark, description=full).tier == "INELIGIBLE"
    assert corrected(spark, id="gh:1", description=full).tier == "APPLY_CAVEAT"
    hard = corrected(spark, id="gh:1", description="must be on active duty " * 12)
    assert (hard.tier, hard.hard_ineligible) == ("INELIGIBLE", True)
    kept = corrected(spark, tier="INELIGIBLE", reason="model", description="must be on active duty " * 12)
    assert (kept.tier, kept.reason, kept.hard_ineligible) == ("INELIGIBLE", "model", True)
    assert corrected(spark, tier="PENDING", location="Paris").tier == "PENDING"
    assert corrected(spark, description="pays $30/hr intern " * 20).salary == "$30/hr"
    assert corrected(spark, description="pays $30/hr intern " * 20, salary="$9").salary == "$9"


def test_error_kinds(spark):
    kind = verdicts.error_kind(F.lit("BadRequestError"), F.col("x"))
    assert values(spark, kind, "Your CREDIT balance is too low", "bad", None) == ["billing", "transient", "transient"]
    assert values(spark, verdicts.error_kind(F.col("x"), F.lit("credit balance")), "AuthenticationError", "RateLimitError") == ["auth", "transient"]
