"""Schemas of postings, verdicts and control tables."""

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TEXT, _TIME = StringType(), TimestampType()

#: What a source gives for one posting.
LISTING = StructType(
    [
        StructField("id", _TEXT, False),
        StructField("title", _TEXT),
        StructField("company", _TEXT),
        StructField("location", _TEXT),
        StructField("url", _TEXT),
        StructField("apply_url", _TEXT),
        StructField("posted_at", _TEXT),
        StructField("description", _TEXT),
        StructField("is_easy_apply", BooleanType()),
        StructField("search_term", _TEXT),
    ]
)

VERDICT = StructType(
    [
        StructField("tier", _TEXT),
        StructField("reason", _TEXT),
        StructField("suggested_resume", _TEXT),
        StructField("salary", _TEXT),
        StructField("failed", BooleanType()),
        StructField("failed_kind", _TEXT),
        StructField("hard_ineligible", BooleanType()),
    ]
)

#: A stored posting.
POSTING = StructType(
    [
        *LISTING.fields[:6],
        StructField("search_term", _TEXT),
        StructField("description", _TEXT),
        StructField("logo_url", _TEXT),
        StructField("norm_key", _TEXT),
        StructField("tier", _TEXT),
        StructField("reason", _TEXT),
        StructField("suggested_resume", _TEXT),
        StructField("status", _TEXT),
        StructField("posted_at", _TIME),
        StructField("found_at", _TIME),
        StructField("is_easy_apply", BooleanType()),
        StructField("salary", _TEXT),
    ]
)

RUN = StructType(
    [
        StructField("id", LongType()),
        StructField("source", _TEXT),
        StructField("started_at", _TIME),
        StructField("finished_at", _TIME),
        StructField("total_raw", IntegerType()),
        StructField("new_jobs", IntegerType()),
        StructField("notified", IntegerType()),
        StructField("rate_limited", IntegerType()),
    ]
)

MUTATION = StructType(
    [
        StructField("mutation_id", LongType()),
        StructField("ids", ArrayType(_TEXT)),
        StructField("desired_status", _TEXT),
        StructField("previous_status", _TEXT),
        StructField("phase", _TEXT),
    ]
)

TIERS = ("APPLY", "APPLY_CAVEAT", "INELIGIBLE")
ACTIONABLE = ("APPLY", "APPLY_CAVEAT")
PENDING = "PENDING"
STATUSES = ("new", "saved", "dismissed", "applied")
#: Columns that list views read; long texts and bookkeeping stay in storage.
VIEW_COLUMNS = ("id", "title", "company", "location", "url", "apply_url", "logo_url", "tier", "reason", "status", "found_at", "is_easy_apply", "salary")
OPTIONAL_VIEW_COLUMNS = ("suggested_resume",)
