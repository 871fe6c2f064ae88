"""Status changes, optimistic overlays, the retry queue and control state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysieve.functions.text import or_null
from tallysieve.operators.resolve import status_of_rank, status_rank
from tallysieve.schemas import PENDING, STATUSES, TIERS

MAX_IDS = 50
QUEUE_LIMIT = 40
STOP_AFTER = 2
ID_PATTERN = r"^[A-Za-z0-9:_-]{1,100}$"
TIER_RANK = {"INELIGIBLE": 0, "APPLY_CAVEAT": 1, "APPLY": 2}


def valid_ids(ids: Column, pattern: str = ID_PATTERN) -> Column:
    """The distinct ids if there are 1 to ``MAX_IDS`` and all are well-formed; else null."""
    distinct = F.array_distinct(ids)
    good = F.size(distinct).between(1, MAX_IDS) & F.forall(distinct, lambda i: i.rlike(pattern))
    return F.when(good, distinct)


def set_group_status(rows: DataFrame, ids: list[str], status: str) -> DataFrame:
    """``rows`` with the status of ``ids`` set, all or nothing.

    Raises ValueError for a bad status, a bad number of ids or an unknown id, before
    anything changes.
    """
    wanted = list(dict.fromkeys(ids))
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    if not 1 <= len(wanted) <= MAX_IDS:
        raise ValueError(f"1 to {MAX_IDS} ids, not {len(wanted)}")
    found = rows.where(F.col("id").isin(wanted)).select("id").distinct().count()
    if found != len(wanted):
        raise ValueError(f"{len(wanted) - found} ids are unknown")
    return rows.withColumn("status", F.when(F.col("id").isin(wanted), status).otherwise(F.col("status")))


def verify_status(rows: DataFrame, ids: list[str], status: str) -> DataFrame:
    """Ids that don't have the status after a write; empty if the write held."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    return wanted.join(rows.where(F.col("status") == status).select("id"), "id", "left_anti")


def update_classification(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with newer tier, reason, suggested_resume and, if not empty, salary; nothing else changes.

    A failed verdict changes nothing.
    """
    good = verdicts.where(~F.coalesce("failed", F.lit(False))).select("id", *(F.col(n).alias(f"new_{n}") for n in ("tier", "reason", "suggested_resume", "salary")))
    joined = rows.join(good, "id", "left")
    has = F.col("new_tier").isNotNull()
    update = {n: F.when(has, F.col(f"new_{n}")).otherwise(F.col(n)) for n in ("tier", "reason", "suggested_resume")}
    update["salary"] = F.coalesce(or_null(F.col("new_salary")), F.col("salary"))
    return joined.select(*(update[n].alias(n) if n in update else F.col(n) for n in rows.columns))


def members(groups: DataFrame) -> DataFrame:
    """(rn, id, status) of every row of every group."""
    own = groups.select("rn", "id", F.coalesce("status", F.lit("new")).alias("status"))
    nested = groups.select("rn", F.explode("duplicates").alias("d")).select("rn", F.col("d.id").alias("id"), F.coalesce("d.status", F.lit("new")).alias("status"))
    return own.union(nested)


def overlay(member_rows: DataFrame, mutations: DataFrame) -> DataFrame:
    """(rn, status) of groups under the newest mutation of any of their members; null where there is none."""
    log = mutations.select("mutation_id", "desired_status", F.explode("ids").alias("id"))
    newest = member_rows.join(log, "id").groupBy("rn").agg(F.max_by("desired_status", "mutation_id").alias("status"))
    return member_rows.select("rn").distinct().join(newest, "rn", "left")


def apply_group_status(groups: DataFrame, overlaid: DataFrame) -> DataFrame:
    """Groups with the overlaid status on the leader and on all nested rows."""
    new = F.col("__new")
    joined = groups.join(overlaid.withColumnRenamed("status", "__new"), "rn", "left")
    nested = F.when(new.isNotNull(), F.transform("duplicates", lambda d: d.withField("status", new))).otherwise(F.col("duplicates"))
    return joined.withColumn("duplicates", nested).withColumn("status", F.coalesce(new, F.col("status"))).drop("__new")


def acknowledged(member_rows: DataFrame, mutations: DataFrame) -> DataFrame:
    """Ids of confirmed mutations whose rows all have the desired status; a missing row holds one back."""
    wanted = mutations.where("phase = 'confirmed'").select("mutation_id", "desired_status", F.explode("ids").alias("id"))
    seen = wanted.join(member_rows.select("id", "status"), "id", "left")
    held = F.coalesce(F.col("status") == F.col("desired_status"), F.lit(False))
    return seen.groupBy("mutation_id").agg(F.bool_and(held).alias("done")).where("done").select("mutation_id")


def rolled_back(mutations: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status) to restore for failed mutations that are still the newest of their id."""
    each = mutations.select("mutation_id", "previous_status", F.explode("ids").alias("id"))
    newest = each.groupBy("id").agg(F.max_by(F.struct("mutation_id", "previous_status"), "mutation_id").alias("m"))
    return newest.select("id", F.col("m.mutation_id").alias("mutation_id"), F.col("m.previous_status").alias("status")).join(failed.select("mutation_id"), "mutation_id", "left_semi").select("id", "status")


def pending_queue(rows: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The oldest parked rows."""
    return rows.where(F.col("tier") == PENDING).orderBy("found_at", "id").limit(limit)


def park(rows: DataFrame) -> DataFrame:
    """Rows whose verdict failed wait as PENDING with their description kept; others keep their verdict."""
    failed = F.coalesce("failed", F.lit(False))
    return rows.withColumn("tier", F.when(failed, PENDING).when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise("APPLY_CAVEAT"))


def drained(attempts: DataFrame, order: str = "found_at", stop_after: int = STOP_AFTER) -> DataFrame:
    """The attempts that a drain makes before it stops, from the outcome of each: ok, poison, transient, billing or auth.

    An account-wide failure stops at once, ``stop_after`` failures in a row stop
    after the last; a poison row is skipped and counts as neither.  At most
    ``QUEUE_LIMIT`` attempts, the earliest, are looked at, so one ordered window holds them.
    """
    attempts = attempts.orderBy(order, "id").limit(QUEUE_LIMIT)
    w = Window.orderBy(order, "id")
    counted = attempts.withColumn("ok_run", F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(w))
    in_run = Window.partitionBy("ok_run").orderBy(order, "id")
    fails = F.sum(F.when(F.col("outcome") == "transient", 1).otherwise(0)).over(in_run)
    stops = counted.withColumn("stop", F.when(F.col("outcome").isin("billing", "auth") | (fails >= stop_after), 1).otherwise(0))
    before = F.coalesce(F.sum("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stops.withColumn("before", before).where("before = 0").drop("ok_run", "stop", "before")


def alert_due(last_alert: Column, now: Column, kind: Column, hours: int = 6) -> Column:
    """Whether an outage is announced: hard kinds only, once in ``hours``; an unreadable mark announces."""
    last = F.try_to_timestamp(last_alert)
    return kind.isin("billing", "auth") & (last.isNull() | (now - last >= F.expr(f"INTERVAL {hours} HOURS")))


def recovery_due(last_alert: Column, promoted: Column) -> Column:
    """Whether an end of an outage is announced: rows got through and the outage had been announced."""
    return (F.coalesce(promoted, F.lit(0)) > 0) & (F.coalesce(last_alert, F.lit("")) != "")


def run_allowed(runs: DataFrame, source: str, now: Column, stale_minutes: int = 20) -> DataFrame:
    """One row: whether a run of ``source`` may start, as no unfinished run of it is fresh."""
    active = runs.where((F.col("source") == source) & F.col("finished_at").isNull() & (F.col("started_at") > now - F.expr(f"INTERVAL {stale_minutes} MINUTES")))
    return active.agg((F.count("*") == 0).alias("allowed"))


def put_state(table: DataFrame, key: str, value: str | None) -> DataFrame:
    """A key-value table with one key set, or removed if ``value`` is None."""
    rest = table.where(F.col("key") != key)
    return rest if value is None else rest.union(table.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def run_statistics(rows: DataFrame) -> DataFrame:
    """total_raw, new_jobs, notified and rate_limited of each run from its candidate rows."""
    return rows.groupBy("run_id").agg(
        F.count("*").cast("int").alias("total_raw"),
        F.count_if(F.col("stored")).cast("int").alias("new_jobs"),
        F.count_if(F.col("stored") & F.col("tier").isin("APPLY", "APPLY_CAVEAT")).cast("int").alias("notified"),
        F.count_if(F.col("rate_limited")).cast("int").alias("rate_limited"),
    )


def tier_transitions(rows: DataFrame) -> DataFrame:
    """Counts by (old_tier, new_tier) and the direction of the change."""
    rank = lambda c: F.coalesce(*(F.when(F.col(c) == t, n) for t, n in TIER_RANK.items()), F.lit(1))
    move = rank("new_tier") - rank("old_tier")
    direction = F.when(move > 0, "promoted").when(move < 0, "demoted").otherwise("level")
    return rows.where("old_tier != new_tier").groupBy("old_tier", "new_tier", direction.alias("direction")).agg(F.count("*").alias("n"))


def highest_status(statuses: DataFrame, key: str = "rn") -> DataFrame:
    """The most advanced status of each group."""
    return statuses.groupBy(key).agg(status_of_rank(F.max(status_rank(F.col("status")))).alias("status"))
