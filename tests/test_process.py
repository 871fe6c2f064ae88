"""What becomes of judged listings: stored, parked, kept back."""

from pyspark.sql import functions as F

from tallysieve.operators import maintenance, process
from tallysieve.operators.gates import GATES

_LONG = "We build tools with interns who like to learn and to write clear code. " * 4
_ROW = "id string, title string, company string, location string, description string, apply_url string, salary string, tier string, reason string, suggested_resume string, status string"


def row(i, **more):
    base = {"id": i, "title": "Software Engineer Intern", "company": "Acme", "location": "Austin, TX", "description": _LONG, "apply_url": None, "salary": None, "tier": None, "reason": "", "suggested_resume": None, "status": "new"}
    return tuple({**base, **more}.values())


def table(spark, *rows):
    return spark.createDataFrame(list(rows), _ROW)


def verdicts(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, tier string, reason string, suggested_resume string, salary string, failed boolean")


_GOOD = ("a", "APPLY", "fits", "Data", "$1/hr", False)


def test_a_passing_verdict_is_stored_whole(spark):
    rows = table(spark, row("a"), row("b", salary="$9/hr"), row("c"))
    told = verdicts(spark, _GOOD, ("b", "MAYBE", None, "", "$1/hr", None), ("c", None, "r", None, "", False))
    got = {r.id: (r.tier, r.reason, r.suggested_resume, r.salary, r.notify) for r in process.processed(rows, rows.where("false"), told).collect()}
    assert got == {"a": ("APPLY", "fits", "Data", "$1/hr", True), "b": ("APPLY_CAVEAT", "", "General", "$9/hr", True), "c": ("APPLY_CAVEAT", "r", "General", None, True)}


def test_rows_that_wait_keep_their_facts(spark):
    rows = table(spark, row("a", description=None), row("none", description="", salary=""))
    facts = spark.createDataFrame([("a", "found", "u", "$2/hr"), ("none", "text", None, None)], "id string, description string, apply_url string, salary string")
    told = verdicts(spark, ("a", "APPLY", "x", "Data", "$1/hr", True))
    got = {r.id: (r.tier, r.reason, r.suggested_resume, r.salary, r.description, r.notify) for r in process.processed(rows, facts, told).collect()}
    assert got == {"a": ("PENDING", process.PARKED, "General", "$2/hr", "found", False), "none": ("PENDING", process.PARKED, "General", "", "text", False)}


def test_rules_go_over_a_verdict(spark):
    rows = table(spark, row("a", description=_LONG + "Pay is $25/hr - $35/hr."), row("b", description="short"))
    told = verdicts(spark, ("a", "APPLY", "x", "Data", "", False), ("b", "APPLY", "x", "Data", "", False))
    got = {r.id: r for r in process.processed(rows, rows.where("false"), told).collect()}
    assert got["a"].salary == "$25/hr - $35/hr" and (got["b"].tier, got["b"].reason[:10]) == ("APPLY_CAVEAT", "Classified")


def test_a_tenant_stores_gated_and_judged_rows_only(spark):
    rows = table(spark, row("a", title="Store Clerk"), row("b", title="Clerk Intern", description="Pay is $25/hr - $35/hr."), row("c", title="Clerk"), row("d", title="Clerk"), row("e", title="Clerk", description="Pay is $25/hr - $35/hr."))
    told = verdicts(spark, ("a", "MAYBE", "why", None, "$3/hr", False), ("c", "APPLY", "x", None, None, True), ("e", "INELIGIBLE", None, None, None, False))
    got = {r.id: (r.tier, r.reason, r.salary, r.notify) for r in process.tenant_processed(rows, told, GATES["hourly"]).collect()}
    assert set(got) == {"a", "b", "e"}
    assert got["a"] == ("APPLY_CAVEAT", "why", "$3/hr", True) and got["e"] == ("INELIGIBLE", "", "$25/hr - $35/hr", False)
    assert got["b"][0] == "INELIGIBLE" and got["b"][1] and got["b"][2] is None


def test_promoted_rows_are_written_whole_and_others_not_at_all(spark):
    rows = table(spark, row("a", tier="INELIGIBLE", reason="old", status="applied"), row("b", tier="INELIGIBLE"), row("c", tier="INELIGIBLE"), row("d", tier="APPLY"))
    told = verdicts(spark, _GOOD, ("b", "INELIGIBLE", "again", "Data", None, False), ("c", "APPLY", "x", "Data", None, True), ("d", "INELIGIBLE", "x", "Data", None, False))
    log = maintenance.rejected_recheck(rows, told).collect()
    assert sorted((r.id, r.field, r.old, r.new) for r in log) == [("a", "reason", "old", "fits"), ("a", "suggested_resume", None, "Data"), ("a", "tier", "INELIGIBLE", "APPLY")]


def test_refetched_rows_take_reason_resume_and_pay(spark):
    rows = table(spark, row("a", tier="APPLY", description="thin", salary="$5/hr"), row("b", tier="APPLY", description="thin", status="applied"), row("c", tier="APPLY", description="thin", salary="$5/hr"))
    found = rows.select("id", F.lit(_LONG).alias("description"))
    told = verdicts(spark, _GOOD, ("c", "INELIGIBLE", "no", "", None, False))
    log = {(r.id, r.field): r.new for r in maintenance.refetched(rows, found, told).collect()}
    assert log == {("a", "description"): _LONG, ("a", "reason"): "fits", ("a", "suggested_resume"): "Data", ("a", "salary"): "$1/hr", ("c", "description"): _LONG, ("c", "tier"): "INELIGIBLE", ("c", "reason"): "no", ("c", "suggested_resume"): "General"}
