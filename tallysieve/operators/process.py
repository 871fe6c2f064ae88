"""From a fetched listing to a stored, parked or dropped row and its notice, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.salary import extract_salary
from tallysieve.functions.text import or_null
from tallysieve.operators.gates import gate_reason, source_of
from tallysieve.operators.verdicts import corrected
from tallysieve.schemas import ACTIONABLE, PENDING, TIERS

_FACTS = ("description", "apply_url", "salary")


def enriched(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the fetched facts (id, description, apply_url, salary) that they lack; nothing is emptied."""
    found = facts.select("id", *(F.col(n).alias(f"__{n}") for n in _FACTS))
    joined = rows.join(found, "id", "left")
    return joined.select(*(F.coalesce(or_null(F.col(n)), or_null(F.col(f"__{n}")), F.col(n)).alias(n) if n in _FACTS else F.col(n) for n in rows.columns))


#: The reason of a row that waits for a verdict.
PARKED = "Awaiting classification: the classifier was unavailable when this posting was found"


def _told(verdicts: DataFrame) -> DataFrame:
    """Verdicts with a tier that there is, a reason, a resume, pay and whether they failed, under names of their own."""
    c = lambda n: or_null(F.col(n)) if n in verdicts.columns else F.lit(None).cast("string")
    return verdicts.select(
        "id",
        F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("APPLY_CAVEAT").alias("__tier"),
        F.coalesce(c("reason"), F.lit("")).alias("__reason"),
        F.coalesce(c("suggested_resume"), F.lit("General")).alias("__resume"),
        c("salary").alias("__pay"),
        F.coalesce("failed", F.lit(False)).alias("__failed"),
    )


_TOLD = ("__tier", "__reason", "__resume", "__pay", "__failed")


def processed(rows: DataFrame, facts: DataFrame, verdicts: DataFrame, parked_reason: str = PARKED) -> DataFrame:
    """``rows`` enriched and judged, with ``notify``: whether a notice is due.

    ``verdicts`` is (id, tier, reason, suggested_resume, salary, failed), one for an id.
    A row whose verdict failed, or that has none, is parked as PENDING with its facts
    kept.  Others get their verdict's tier, reason and resume, and its pay if they have
    none, and go through the rules.  Only actionable rows are notified.
    """
    judged = enriched(rows, facts).join(_told(verdicts), "id", "left").withColumn("__parked", F.coalesce("__failed", F.lit(True)))
    salary = F.coalesce(or_null(F.col("salary")), F.col("__pay"), F.col("salary"))
    passed = judged.where("NOT __parked").withColumn("tier", F.col("__tier")).withColumn("reason", F.col("__reason")).withColumn("suggested_resume", F.col("__resume")).withColumn("salary", salary)
    passed = corrected(passed.drop("__parked", *_TOLD)).drop("hard_ineligible")
    parked = judged.where("__parked").withColumn("tier", F.lit(PENDING)).withColumn("reason", F.lit(parked_reason)).withColumn("suggested_resume", F.lit("General")).select(*passed.columns)
    return passed.unionByName(parked).withColumn("notify", F.col("tier").isin(*ACTIONABLE))


def tenant_processed(rows: DataFrame, verdicts: DataFrame, gates: tuple) -> DataFrame:
    """Rows of a tenant that has title gates and no rules, with ``notify``.

    Gated rows are stored as INELIGIBLE with the gate as their reason and are else as they
    came.  Of the others a row whose verdict failed, or that has none, is not stored, so it
    comes again; the rest get their verdict's tier and reason, and its pay, or the
    description's, if they have none.
    """
    why: Column = gate_reason(F.col("title"), source_of(F.col("id")), gates)
    judged = rows.withColumn("__why", why).join(_told(verdicts), "id", "left")
    gated = F.col("__why").isNotNull()
    judged = judged.where(gated | ~F.coalesce("__failed", F.lit(True)))
    pay = F.coalesce(or_null(F.col("salary")), F.col("__pay"), extract_salary(F.col("description")), F.col("salary"))
    out = judged.withColumn("tier", F.when(gated, "INELIGIBLE").otherwise(F.col("__tier"))).withColumn("reason", F.when(gated, F.col("__why")).otherwise(F.col("__reason")))
    out = out.withColumn("salary", F.when(gated, F.col("salary")).otherwise(pay))
    return out.drop("__why", *_TOLD).withColumn("notify", F.col("tier").isin(*ACTIONABLE))
