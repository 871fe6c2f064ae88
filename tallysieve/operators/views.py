"""Reader-side operators: views, filters, counts, sorting and payload pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.text import text
from tallysieve.schemas import ACTIONABLE, OPTIONAL_VIEW_COLUMNS, VIEW_COLUMNS

#: Fixed value: titles that the role filter counts as internships.
INTERN_TITLE = r"(?i)intern|internship|co[\s-]?op|apprentice|summer analyst|summer associate|trainee"
HOURS = {"24h": 24, "7d": 168, "30d": 720}


def is_active(status: Column) -> Column:
    return F.coalesce(status, F.lit("new")) == "new"


def view(name: str) -> Column:
    """Rows of one view: to-apply, caveat, my-list, applied, saved or dismissed."""
    tier, status = F.col("tier"), F.col("status")
    if name in ("applied", "saved", "dismissed"):
        return F.coalesce(status == name, F.lit(False))
    wanted = {"to-apply": ACTIONABLE[:1], "caveat": ACTIONABLE[1:], "my-list": ACTIONABLE}[name]
    return F.coalesce(tier.isin(*wanted), F.lit(False)) & is_active(status)


VIEWS = ("to-apply", "caveat", "my-list", "applied", "saved", "dismissed")


def view_counts(rows: DataFrame) -> DataFrame:
    """One row with the size of every view."""
    return rows.agg(*(F.count_if(view(v)).alias(v.replace("-", "_")) for v in VIEWS))


def role_filter(role: str) -> Column:
    hit = F.col("title").rlike(INTERN_TITLE)
    return {"all": F.lit(True), "internships": hit, "entry-level": ~hit}[role]


def source_filter(source: str) -> Column:
    direct = F.col("id").startswith("ats:")
    return {"all": F.lit(True), "direct": direct, "linkedin": ~direct}[source]


def date_filter(window: str, now: Column) -> Column:
    """found_at within the window up to ``now``, its start included."""
    return F.lit(True) if window == "all" else F.col("found_at") >= now - F.expr(f"INTERVAL {HOURS[window]} HOURS")


def search_filter(query: str) -> Column:
    """Company or title holds the query, in any case; a blank query holds for all."""
    if not query.strip():
        return F.lit(True)
    q = query.lower()
    return F.lower(text(F.col("company"))).contains(q) | F.lower(text(F.col("title"))).contains(q)


def filtered(rows: DataFrame, name: str, role: str = "all", source: str = "all", window: str = "all", query: str = "", now: Column | None = None) -> DataFrame:
    """All filters of the list at once."""
    return rows.where(view(name) & role_filter(role) & source_filter(source) & date_filter(window, now if now is not None else F.current_timestamp()) & search_filter(query))


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sorted by text without case and accents, or by time; ties keep their place by seq."""
    c = F.col(key) if key == "found_at" else F.collate(text(F.col(key)), "UNICODE_CI_AI")
    return rows.orderBy(c.desc() if descending else c.asc(), "seq")


def optional_columns(rows: DataFrame) -> DataFrame:
    """Which optional columns any row has a value for."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    filled = lambda n: F.length(text(F.col(n))) > 0
    return rows.agg(
        some(F.col("id").startswith("ats:")).alias("source"),
        some(filled("suggested_resume") & (F.col("suggested_resume") != "N/A")).alias("resume"),
        some(filled("salary")).alias("salary"),
    )


def actionable(rows: DataFrame) -> DataFrame:
    """Rows that the list page reads: decided by a person, or new and worth a look."""
    decided = F.col("status") != "new"
    return rows.where(decided | ((F.col("status") == "new") & F.col("tier").isin(*ACTIONABLE)))


def view_columns(rows: DataFrame) -> DataFrame:
    """The columns of the list, the optional ones where the table has them."""
    return rows.select(*VIEW_COLUMNS, *(c for c in OPTIONAL_VIEW_COLUMNS if c in rows.columns))


def strip_for_client(groups: DataFrame) -> DataFrame:
    """Grouped rows without descriptions, those of nested rows included."""
    out = groups.withColumn("description", F.lit(None).cast("string"))
    kinds = {f.name: f.dataType for f in groups.schema.fields}
    if "duplicates" in kinds:
        out = out.withColumn("duplicates", F.transform("duplicates", lambda d: d.withField("description", F.lit(None).cast("string"))))
    return out


def freshest_first(rows: DataFrame) -> DataFrame:
    """By the raw posted_at text, latest first, missing last, ties by seq."""
    return rows.orderBy(text(F.col("posted_at")).desc(), "seq")


def delta_page(rows: DataFrame, since: Column, limit: int = 100) -> DataFrame:
    """Search-site rows found after ``since``, oldest first, at most ``limit``."""
    site = ~F.col("id").startswith("gh:") & ~F.col("id").startswith("ats:")
    return rows.where(site & (F.col("found_at") > since) & F.col("tier").isin(*ACTIONABLE)).orderBy("found_at", "id").limit(limit)


def random_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
