"""Job-board payloads as listings.

Payloads are landed as one JSON text per board, in rows of (company, platform,
payload); each platform has a schema and a projection.  Unknown platforms and
unreadable payloads give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.text import or_null, text
from tallysieve.functions.times import epoch_timestamp, relative_days

MAX_DESCRIPTION = 12_000
PAGE_ROWS, MAX_PAGES = 20, 200

_SCHEMAS = {
    "greenhouse": "struct<jobs:array<struct<title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string>>>",
    "lever": "array<struct<text:string,categories:struct<location:string>,hostedUrl:string,descriptionPlain:string,createdAt:string>>",
    "ashby": "struct<jobs:array<struct<title:string,location:string,jobUrl:string,applyUrl:string,descriptionPlain:string,publishedAt:string>>>",
    "smartrecruiters": "struct<content:array<struct<name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string>>>>",
    "workday": "struct<total:int,jobPostings:array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>>",
}
#: Entities that board texts use.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    for entity, sign in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def listing(company: Column, title: Column, location: Column, url: Column, description: Column, posted_at: Column) -> list[Column]:
    """Columns of one board row; its id derives from the url."""
    return [
        F.concat(F.lit("ats:"), F.left(F.sha1(url), F.lit(16))).alias("id"),
        title.alias("title"),
        company.alias("company"),
        text(location).alias("location"),
        url.alias("url"),
        url.alias("apply_url"),
        posted_at.alias("posted_at"),
        or_null(F.left(description, F.lit(MAX_DESCRIPTION))).alias("description"),
        F.lit(False).alias("is_easy_apply"),
        F.lit("ats-watch").alias("search_term"),
    ]


def _complete(rows: DataFrame) -> DataFrame:
    return rows.where((text(F.col("company")) != "") & (text(F.col("title")) != "") & (text(F.col("url")) != ""))


def _jobs(payloads: DataFrame, platform: str, path: str) -> DataFrame:
    parsed = payloads.where(F.col("platform") == platform).withColumn("p", F.from_json("payload", _SCHEMAS[platform]))
    return parsed.select("company", F.explode(path).alias("j"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    c = F.col
    return _complete(_jobs(payloads, "greenhouse", "p.jobs").select(*listing(c("company"), c("j.title"), c("j.location.name"), c("j.absolute_url"), unescaped(c("j.content")), c("j.updated_at"))))


def lever(payloads: DataFrame) -> DataFrame:
    c, at = F.col, F.col("j.createdAt")
    # Numbers are epochs; texts stay as they are.
    posted = F.when(at.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), iso_timestamp(epoch_timestamp(at))).otherwise(at)
    return _complete(_jobs(payloads, "lever", "p").select(*listing(c("company"), c("j.text"), c("j.categories.location"), c("j.hostedUrl"), c("j.descriptionPlain"), posted)))


def ashby(payloads: DataFrame) -> DataFrame:
    c = F.col
    url = F.coalesce(or_null(c("j.jobUrl")), c("j.applyUrl"))
    return _complete(_jobs(payloads, "ashby", "p.jobs").select(*listing(c("company"), c("j.title"), c("j.location"), url, c("j.descriptionPlain"), c("j.publishedAt"))))


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    c = F.col
    place = F.concat_ws(", ", *(or_null(c(f"j.location.{n}")) for n in ("city", "region", "country")))
    return _complete(_jobs(payloads, "smartrecruiters", "p.content").select(*listing(c("company"), c("j.name"), place, c("j.ref"), F.lit(None).cast("string"), c("j.releasedDate"))))


def workday(payloads: DataFrame, now: Column) -> DataFrame:
    """Pages of (company, token, page, payload); the token is tenant:host:site.

    The first page's total, if it names one, bounds the pages that count; a path that an
    earlier page had marks a board that wrapped around and is dropped.
    """
    pages = payloads.where("platform = 'workday'").withColumn("p", F.from_json("payload", _SCHEMAS["workday"]))
    totals = pages.where("page = 0").select("token", F.col("p.total").alias("total"))
    within = F.coalesce(F.col("page") * PAGE_ROWS < F.when(F.col("total") > 0, F.col("total")), F.lit(True))
    counted = pages.join(totals, "token").where((F.col("page") < MAX_PAGES) & within)
    jobs = counted.select("company", "token", "page", F.posexplode("p.jobPostings").alias("at", "j"))
    first = jobs.groupBy("token", F.col("j.externalPath").alias("path")).agg(F.min_by(F.struct("company", "j"), F.struct("page", "at")).alias("r"))
    parts = F.split("token", ":")
    base = F.concat(F.lit("https://"), parts[0], F.lit("."), parts[1], F.lit(".myworkdayjobs.com/"), parts[2])
    url = F.when(text(F.col("path")) != "", F.concat(base, "path"))
    days = relative_days(F.col("r.j.postedOn"))
    posted = F.when(days.isNotNull(), iso_timestamp(now - F.make_dt_interval(days)))
    return _complete(first.select(*listing(F.col("r.company"), F.col("r.j.title"), F.col("r.j.locationsText"), url, F.lit(None).cast("string"), posted)))


PLATFORMS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters}


def board_listings(payloads: DataFrame, now: Column) -> DataFrame:
    """Listings of all payloads (company, platform, token, page, payload), whatever their platform."""
    out = workday(payloads, now)
    for read in PLATFORMS.values():
        out = out.unionByName(read(payloads))
    return out


def with_registry(payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """Payloads of (company, page, payload) with the platform and token of the board registry; unregistered ones go."""
    return payloads.join(registry.select("company", "platform", "token"), "company")


def read_payloads(spark, path: str) -> DataFrame:
    """Landed payload files: JSON lines of company, page and payload."""
    return spark.read.schema("company string, page int, payload string").json(path)
