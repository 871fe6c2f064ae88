"""Batch maintenance: scan, filter, recompute, and keep what changes.

Each job gives rows of a change log (job, id, field, old, new).  None writes
status; most look at new rows only, so a person's decision stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.salary import extract_salary
from tallysieve.functions.text import norm_key, or_null, stripped, text
from tallysieve.operators.gates import is_internship
from tallysieve.operators.verdicts import corrected
from tallysieve.operators.views import random_sample
from tallysieve.schemas import ACTIONABLE, TIERS

#: Fixed value: furniture at the start of a stored description.
FURNITURE = r"(?i)cookie|skip to (?:main )?content|sign in|job alert|privacy"
WRITABLE = ("tier", "reason", "suggested_resume", "salary", "description", "apply_url", "norm_key")


def _log(rows: DataFrame, job: str, field: str, old: Column, new: Column) -> DataFrame:
    if field not in WRITABLE:
        raise ValueError(f"{field} is not for maintenance to write")
    return rows.where(~old.eqNullSafe(new)).select(F.lit(job).alias("job"), "id", F.lit(field).alias("field"), old.alias("old"), new.alias("new"))


def _new(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("status", F.lit("new")) == "new")


def stale_keys(rows: DataFrame) -> DataFrame:
    return _log(rows, "norm_keys", "norm_key", F.col("norm_key"), norm_key(F.col("company"), F.col("title")))


def missing_salaries(rows: DataFrame) -> DataFrame:
    """Pay found in descriptions of rows without any."""
    open_ = rows.where(F.col("description").isNotNull() & or_null(F.col("salary")).isNull())
    found = open_.withColumn("__pay", extract_salary(F.col("description"))).where("__pay IS NOT NULL")
    return _log(found, "salaries", "salary", F.col("salary"), F.col("__pay"))


def needs_refetch(description: Column) -> Column:
    """Too short, or page furniture at its start."""
    d = text(description)
    return (F.length(stripped(d)) < 200) | F.left(d, F.lit(400)).rlike(FURNITURE)


def fetched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Changes from fetched facts (id, description, apply_url, salary) for rows that lack them; nothing is emptied."""
    joined = rows.join(found.select("id", *(F.col(n).alias(f"__{n}") for n in ("description", "apply_url", "salary"))), "id")
    out = None
    for n in ("description", "apply_url", "salary"):
        lacking = joined.where(or_null(F.col(n)).isNull() & or_null(F.col(f"__{n}")).isNotNull())
        part = _log(lacking, "fetched", n, F.col(n), F.col(f"__{n}"))
        out = part if out is None else out.union(part)
    return out


def lacking(rows: DataFrame, kind: str) -> DataFrame:
    """Rows without a description: of lists, actionable ones, or new rejected ones that no list gave."""
    listed = F.col("id").startswith("gh:")
    wanted = {"lists": listed, "actionable": F.col("tier").isin(*ACTIONABLE), "rejected": (F.col("tier") == "INELIGIBLE") & (F.coalesce("status", F.lit("new")) == "new") & ~listed}[kind]
    return rows.where(wanted & or_null(F.col("description")).isNull())


def _judged(rows: DataFrame, verdicts: DataFrame, job: str, *fields: str, promoted: bool = False) -> DataFrame:
    """Changes of ``fields`` (tier alone if none is named) by new verdicts under today's rules; a failed verdict changes nothing.

    ``verdicts`` has id, tier, failed and, for these fields, reason, suggested_resume and
    salary.  Pay is written where the verdict or the description names some.  With
    ``promoted`` only rows whose tier changes are written.
    """
    fields = fields or ("tier",)
    defaults = {"reason": F.lit(""), "suggested_resume": F.lit("General"), "salary": F.lit(None).cast("string")}
    more = [n for n in fields if n != "tier"]
    tier = F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("APPLY_CAVEAT")
    good = verdicts.where(~F.coalesce("failed", F.lit(False))).select("id", tier.alias("__tier"), *(F.coalesce(or_null(F.col(n)), defaults[n]).alias(f"__{n}") for n in more))
    told = rows.select("*", *(F.col(n).alias(f"__old_{n}") for n in fields)).join(good, "id")
    for n in fields:
        told = told.withColumn(n, F.col(f"__{n}")).drop(f"__{n}")
    new = {n: F.coalesce(or_null(F.col(n)), F.col(f"__old_{n}")) if n == "salary" else F.col(n) for n in fields}
    changes = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"__old_{n}").alias("old"), new[n].alias("new")) for n in fields))
    judged = corrected(told)
    if promoted:
        judged = judged.where(F.col("tier") != F.col("__old_tier"))
    each = judged.select("id", F.inline(changes)).where(~F.col("old").eqNullSafe(F.col("new")))
    return each.select(F.lit(job).alias("job"), "id", "field", "old", "new")


def filled(rows: DataFrame, kind: str, found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Descriptions (id, description) found for rows that lack them, and the new tiers of those whose status is new."""
    open_ = lacking(rows, kind).join(found.select("id", or_null(F.col("description")).alias("__text")).where("__text IS NOT NULL"), "id")
    texts = _log(open_, f"fill_{kind}", "description", F.col("description"), F.col("__text"))
    return texts.union(_judged(_new(open_.withColumn("description", F.col("__text")).drop("__text")), verdicts, f"fill_{kind}"))


def refetched(rows: DataFrame, found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New descriptions of APPLY rows that nobody decided on and whose text is thin or furniture, and their new verdicts."""
    open_ = rows.where((F.col("tier") == "APPLY") & ~F.coalesce("status", F.lit("new")).isin("applied", "dismissed") & needs_refetch(F.col("description")))
    open_ = open_.join(found.select("id", or_null(F.col("description")).alias("__text")).where("__text IS NOT NULL"), "id")
    texts = _log(open_, "refetch", "description", F.col("description"), F.col("__text"))
    return texts.union(_judged(open_.withColumn("description", F.col("__text")).drop("__text"), verdicts, "refetch", "tier", "reason", "suggested_resume", "salary"))


def rejected_recheck(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New verdicts of rejected rows that these no longer reject, whatever their status."""
    return _judged(rows.where("tier = 'INELIGIBLE'"), verdicts, "rejected", "tier", "reason", "suggested_resume", promoted=True)


def rejudged(rows: DataFrame, job: str = "recheck") -> DataFrame:
    """Tier changes of new actionable rows under today's rules."""
    open_ = _new(rows).where(F.col("tier").isin(*ACTIONABLE))
    judged = corrected(open_.withColumn("__old", F.col("tier")))
    return _log(judged, job, "tier", F.col("__old"), F.col("tier"))


def title_recheck(rows: DataFrame) -> DataFrame:
    """New actionable rows, lists apart, whose titles no longer pass as internships."""
    open_ = _new(rows).where(F.col("tier").isin(*ACTIONABLE) & ~F.col("id").startswith("gh:"))
    return _log(open_.where(~is_internship(F.col("title"))), "titles", "tier", F.col("tier"), F.lit("INELIGIBLE"))


def promoted_lists(rows: DataFrame) -> DataFrame:
    """New rejected rows of lists go back to review."""
    return _log(_new(rows).where(F.col("id").startswith("gh:") & (F.col("tier") == "INELIGIBLE")), "lists", "tier", F.col("tier"), F.lit("APPLY_CAVEAT"))


def resume_recheck(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Changes of the suggested resume alone."""
    joined = _new(rows).where(F.col("tier").isin(*ACTIONABLE)).join(verdicts.select("id", F.col("suggested_resume").alias("__new")), "id")
    return _log(joined, "resumes", "suggested_resume", F.col("suggested_resume"), F.col("__new"))


def audit_sample(rows: DataFrame, verdicts: DataFrame, n: int, seed: int) -> DataFrame:
    """One row: sampled rejected rows, how many new verdicts promote, and that rate over all rejected rows, cut to a whole number."""
    rejected = _new(rows).where("tier = 'INELIGIBLE'")
    sample = random_sample(rejected, n, seed).select("id").join(verdicts.select("id", "tier"), "id", "left")
    found = sample.agg(F.count("*").alias("sampled"), F.count_if(F.col("tier").isin(*ACTIONABLE)).alias("promoted"))
    all_ = rejected.agg(F.count("*").alias("population"))
    # Both sides are one row.
    return found.crossJoin(all_).select("sampled", "promoted", "population", F.when(F.col("sampled") > 0, F.floor(F.col("promoted") / F.col("sampled") * F.col("population"))).otherwise(0).alias("estimate"))


def change_log(rows: DataFrame) -> DataFrame:
    """All changes that need no fetching and no classifier."""
    return stale_keys(rows).union(missing_salaries(rows)).union(rejudged(rows)).union(title_recheck(rows)).union(promoted_lists(rows))


def applied(rows: DataFrame, log: DataFrame, *fields: str) -> DataFrame:
    """``rows`` with the logged changes of ``fields``; of several changes of one field the last by job name holds."""
    for field in fields or WRITABLE:
        if field in rows.columns:
            change = log.where(F.col("field") == field).groupBy("id").agg(F.max_by(F.struct("new"), "job").alias("__change"))
            rows = rows.join(change, "id", "left").withColumn(field, F.when(F.col("__change").isNotNull(), F.col("__change.new")).otherwise(F.col(field))).drop("__change")
    return rows
