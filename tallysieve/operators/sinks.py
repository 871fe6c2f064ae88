"""What leaves the engine: notices and digests as outbox rows, written after the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallysieve.functions.text import or_null, text
from tallysieve.functions.urls import display_href
from tallysieve.schemas import ACTIONABLE

PRIORITY = {"APPLY": "high", "APPLY_CAVEAT": "default"}


def priority(tier: Column) -> Column:
    return F.when(tier == "APPLY", PRIORITY["APPLY"]).otherwise(PRIORITY["APPLY_CAVEAT"])


def notices(rows: DataFrame) -> DataFrame:
    """(id, title_header, body, priority, click) of actionable rows; headers are ASCII, blank lines of bodies go."""
    line = lambda label, c: F.concat(F.lit(label), or_null(F.col(c)))
    header = F.concat(text(F.col("company")), F.lit(" - "), text(F.col("title")))
    body = F.concat_ws("\n", F.col("tier"), or_null(F.col("location")), line("Why: ", "reason"), line("Resume: ", "suggested_resume"))
    due = rows.where(F.col("tier").isin(*ACTIONABLE))
    return due.select("id", F.regexp_replace(header, r"[^\x00-\x7F]", "?").alias("title_header"), body.alias("body"), priority(F.col("tier")).alias("priority"), text(F.col("url")).alias("click"))


def canary(runs: DataFrame) -> DataFrame:
    """One warning row if all searches of a run found nothing at all; else no row."""
    return runs.groupBy("run_id").agg(F.sum("total_raw").alias("raw")).where("raw = 0").select("run_id", F.lit("All searches returned no rows").alias("message"))


def escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def digest(rows: DataFrame) -> DataFrame:
    """One row with the digest's html and its number of entries, entries by tier.

    A digest is a report for one reader: its rows are those of one period.
    """
    c = F.col
    place = F.coalesce(F.concat(F.lit(" · "), escaped(or_null(c("location")))), F.lit(""))
    pay = F.coalesce(F.concat(F.lit(" · <b>"), escaped(or_null(c("salary"))), F.lit("</b>")), F.lit(""))
    why = F.coalesce(F.concat(F.lit("<div>"), escaped(or_null(c("reason"))), F.lit("</div>")), F.lit(""))
    entry = F.concat(F.lit('<div><b>'), c("tier"), F.lit('</b> <a href="'), display_href(c("url"), c("apply_url")), F.lit('">'), escaped(text(c("title"))), F.lit("</a><div>"), escaped(text(c("company"))), place, pay, F.lit("</div>"), why, F.lit("</div>"))
    entries = rows.where(c("tier").isin(*ACTIONABLE)).select(F.struct("tier", "id", entry.alias("html")).alias("e"))
    whole = entries.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["html"]), "\n").alias("rows"))
    return whole.select("n", F.concat(F.lit("<html><body><h2>Digest: "), c("n").cast("string"), F.lit(" new</h2>"), F.when(c("n") == 0, "<p>Nothing new.</p>").otherwise(c("rows")), F.lit("</body></html>")).alias("html"))


def observed_write(candidates: DataFrame, folder: str) -> dict[str, int]:
    """Write a run's stored candidates (with stored, tier, rate_limited) and give its statistics, counted while they pass.

    The counts are those of ``state.run_statistics`` without a scan of their own.
    """
    passing = Observation()
    watched = candidates.observe(
        passing,
        F.count(F.lit(1)).alias("total_raw"),
        F.count_if(F.col("stored")).alias("new_jobs"),
        F.count_if(F.col("stored") & F.col("tier").isin(*ACTIONABLE)).alias("notified"),
        F.count_if(F.col("rate_limited")).alias("rate_limited"),
    )
    watched.where("stored").write.mode("overwrite").parquet(folder)
    return passing.get
