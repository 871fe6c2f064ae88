"""Registered queries: every operator over postings derived from the test tables, or over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve import synth
from tallysieve.functions import forms, locations, salary, text, times, titles, urls
from tallysieve.operators import dedup, gates, paging, resolve, state, verdicts, views
from tallysieve.operators.forms import chosen_options, logical_fields, unfilled
from tallysieve.sources import boards, details, lists, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable) -> Callable:
    """Register ``function(spark, sf_dir)`` under its name."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).withColumn("norm_key", text.norm_key(F.col("company"), F.col("title")))


def stored_half(rows: DataFrame) -> DataFrame:
    """The earlier arrivals, as what the store holds already."""
    return rows.where("seq % 4 = 0")


@query
def actionable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New postings that pass the title gates, by source."""
    rows = keyed(spark, sf_dir)
    fresh = dedup.unseen(rows.where("seq % 4 != 0"), stored_half(rows))
    first = dedup.first_per_key(fresh, "norm_key", "seq")
    judged = gates.gated(first).withColumn("source", gates.source_of(F.col("id")))
    passed = F.col("gate_reason").isNull()
    return judged.groupBy("source").agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"), F.count_if(passed & F.col("tier").isin("APPLY", "APPLY_CAVEAT")).alias("actionable"))


@query
def norm_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).groupBy("company").agg(F.count("*").alias("n")).select("company", text.norm_company(F.col("company")).alias("norm_company"), "n")


@query
def norm_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n")).select("title", text.norm_role(F.col("title")).alias("norm_role"), "n")


@query
def norm_key_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys that differ from the key computed now; a null key is stale."""
    rows = keyed(spark, sf_dir)
    old = F.when(F.col("seq") % 10 == 0, None).when(F.col("seq") % 10 == 1, F.concat("norm_key", F.lit(" old"))).otherwise(F.col("norm_key"))
    return rows.withColumn("stored_key", old).where(~F.col("stored_key").eqNullSafe(F.col("norm_key"))).select("seq", "stored_key", "norm_key")


@query
def title_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    rows = synth.postings(spark, sf_dir).select("title", gates.source_of(F.col("id")).alias("source"))
    rows = rows.groupBy("title", "source").agg(F.count("*").alias("n"))
    return rows.select("title", "source", "n", gates.is_senior(t).alias("senior"), gates.is_new_grad(t).alias("new_grad"), gates.is_internship(t).alias("internship"), gates.gate_reason(t, F.col("source")).alias("gate_reason"))


@query
def tenant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, source = F.col("title"), F.lit("search")
    rows = synth.postings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    return rows.select("title", "n", gates.gate_reason(t, source, gates.GATES["hourly"]).alias("hourly"), gates.gate_reason(t, source, gates.GATES["local"]).alias("local"))


@query
def dedup_dual_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that the store has neither by id nor by norm_key."""
    rows = keyed(spark, sf_dir)
    return dedup.unseen(rows.where("seq % 4 != 0"), stored_half(rows)).select("seq", "id", "norm_key")


@query
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrivals the store has, by which key."""
    rows = keyed(spark, sf_dir)
    return dedup.known_candidates(rows.where("seq % 4 != 0"), stored_half(rows))


@query
def dedup_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A key's first row is kept as one struct, which isn't pruned: only the columns that are shown go in.
    return dedup.first_per_key(keyed(spark, sf_dir).select("seq", "norm_key"), "norm_key", "seq").select("seq", "norm_key")


@query
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-run deduplication on both keys where one id may come with several keys."""
    block = F.expr("(seq % 3001) div 5")
    key = F.concat(F.lit("n"), block, F.lit("-"), F.col("seq") % 7 % 3)
    rows = synth.postings(spark, sf_dir).select("seq", F.concat(F.lit("u"), F.col("seq") % 3001).alias("id"), key.alias("norm_key"))
    return dedup.greedy_dedup(rows)


@query
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir).select("seq", "id", "company", "title", "norm_key", "tier", "status")
    return dedup.insert_new(stored_half(rows), rows.where("seq % 4 != 0")).select("seq", "id", "norm_key", "tier")


@query
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view_counts(synth.postings(spark, sf_dir))


@query
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One combination of all list filters."""
    rows = synth.postings(spark, sf_dir)
    now = F.timestamp_seconds(F.lit(904_694_400))
    return views.filtered(rows, "my-list", role="internships", source="linkedin", window="30d", query="LINE", now=now).select("seq", "id", "title")


@query
def actionable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.actionable(synth.postings(spark, sf_dir)).select("seq", "tier", "status")


@query
def optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).withColumn("suggested_resume", F.lit("N/A"))
    return views.optional_columns(rows)


@query
def freshest_first_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.freshest_first(synth.postings(spark, sf_dir)).limit(100).select("seq", "posted_at")


@query
def table_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sort_rows(synth.postings(spark, sf_dir), "company").limit(50).select("seq", "company")


@query
def pending_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending_queue(synth.postings(spark, sf_dir)).select("seq", "id", "found_s")


@query
def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a drain of the oldest rows gets, with made-up outcomes."""
    rows = state.pending_queue(synth.postings(spark, sf_dir))
    outcome = F.when(F.col("seq") % 11 == 0, "billing").when(F.col("seq") % 5 == 0, "transient").when(F.col("seq") % 7 == 0, "poison").otherwise("ok")
    return state.drained(rows.withColumn("outcome", outcome)).select("seq", "outcome")


@query
def salary_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n"))
    return rows.select(F.md5("description").alias("text_md5"), salary.extract_salary(F.col("description")).alias("salary"), "n")


@query
def salary_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("salary").agg(F.count("*").alias("n"))
    return rows.select("salary", salary.compact_salary(F.col("salary")).alias("compact"), "n")


@query
def split_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("location").agg(F.count("*").alias("n"))
    found = locations.split_locations(F.col("location"))
    return rows.select("location", F.array_join(found, "|").alias("places"), F.size(found).cast("long").alias("n_places"), locations.is_count_only(F.col("location")).alias("count_only"), "n")


@query
def full_time_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n"))
    return rows.select(F.md5("description").alias("text_md5"), verdicts.is_full_time_only(F.col("description")).alias("full_time"), verdicts.is_graduate_only(F.col("description")).alias("graduate_only"), "n")


@query
def school_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("title", "description").agg(F.count("*").alias("n"))
    found = verdicts.restricted_school(F.col("title"), F.col("description"))
    return rows.withColumn("school", found).where("school IS NOT NULL").groupBy("school").agg(F.sum("n").alias("n"))


@query
def non_us_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("location").agg(F.count("*").alias("n"))
    return rows.select("location", verdicts.foreign_place(F.col("location")).alias("place"), "n")


@query
def insider_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).groupBy("title", "description", "company").agg(F.count("*").alias("n"))
    gate = verdicts.insider_gate(F.col("title"), F.col("description"), F.col("company"))
    return rows.select(gate.alias("g"), "n").groupBy(F.col("g.label").alias("label"), F.col("g.quote").alias("quote")).agg(F.sum("n").alias("n"))


@query
def override_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after all rules, counted."""
    rows = verdicts.corrected(synth.postings(spark, sf_dir))
    return rows.groupBy("tier", "reason", "hard_ineligible").agg(F.count("*").alias("n"), F.count("salary").alias("n_salary"))


@query
def title_only_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts.corrected(synth.postings(spark, sf_dir).where("tier = 'APPLY'"))
    return rows.where(F.col("reason").startswith("Classified on title only")).select("seq", "tier")


@query
def canonical_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir)
    href = urls.application_href(F.col("url"), F.col("apply_url"), F.col("is_easy_apply"))
    return rows.select("seq", urls.canonical_target(F.col("id"), href).alias("target"))


@query
def tracker_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a made-up tracker against the store."""
    rows = keyed(spark, sf_dir)
    link = F.when(F.col("seq") % 3 == 0, F.concat(F.regexp_replace("url", "^https://", ""), F.lit("/"))).when(F.col("seq") % 3 == 1, "").otherwise("https://nowhere.example.net/x")
    tracker = rows.select("company", F.col("title").alias("role"), link.alias("link"))
    return dedup.match_tracker(stored_half(rows), tracker).groupBy("method", "already_applied").agg(F.count("*").alias("n"), F.countDistinct("matched_id").alias("n_matched"))


@query
def facet_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, year, state and specialisation of each title."""
    rows = synth.postings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    t = F.col("title")
    return rows.select("title", joined(titles.seasons(t)).alias("seasons"), joined(titles.years(t)).alias("years"), joined(titles.states(t)).alias("states"), joined(titles.specializations(t)).alias("specs"), "n")


@query
def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment and Jaccard of the words of neighbouring titles of one customer."""
    rows = synth.postings(spark, sf_dir).select("seq", "company", "location", titles.title_words(F.col("title"), F.col("company"), F.col("location")).alias("w"))
    other = rows.select((F.col("seq") - 1).alias("seq"), F.col("w").alias("v"))
    both = rows.join(other, "seq")
    six = lambda c: F.round(c, 6)
    return both.select("seq", six(titles.containment(F.col("w"), F.col("v"))).alias("containment"), six(titles.jaccard(F.col("w"), F.col("v"))).alias("jaccard"))


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.featured(synth.postings(spark, sf_dir).withColumn("rn", F.col("seq")))


@query
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that company buckets bring together."""
    return resolve.bucket_pairs(_featured(spark, sf_dir))


@query
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket pairs whose metadata agree."""
    rows = synth.postings(spark, sf_dir).withColumn("rn", F.col("seq"))
    return resolve.matching(resolve.bucket_pairs(resolve.featured(rows)), resolve.features_of(rows))


@query
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities: their first row, size and highest status."""
    found = resolve.entities(synth.postings(spark, sf_dir).select("seq", "id", "title", "company", "location", "url", "apply_url", "is_easy_apply", "status", "found_at"))
    groups = found.groupBy("root").agg(F.min_by("seq", "rn").alias("first_seq"), F.count("*").alias("size"), F.max(resolve.status_rank(F.col("status"))).alias("rank"))
    return groups.select("first_seq", "size", resolve.status_of_rank(F.col("rank")).alias("status"))


def _member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).select((F.col("seq") - F.col("seq") % 3).alias("rn"), F.concat(F.lit("p"), "seq").alias("id"), "status", "seq")


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for every fourth row and the row after it."""
    rows = synth.postings(spark, sf_dir).where("seq % 4 = 0")
    status = F.element_at(F.array(*(F.lit(s) for s in ("saved", "dismissed", "applied"))), (F.col("seq") % 3 + 1).cast("int"))
    ids = F.array(F.concat(F.lit("p"), F.col("seq")), F.concat(F.lit("p"), F.col("seq") + 1))
    return rows.select((F.col("seq") + 1).alias("mutation_id"), ids.alias("ids"), status.alias("desired_status"), F.lit("new").alias("previous_status"), F.when(F.col("seq") % 8 == 0, "confirmed").otherwise("pending").alias("phase"))


@query
def group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.highest_status(_member_rows(spark, sf_dir))


@query
def status_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.overlay(_member_rows(spark, sf_dir).select("rn", "id", "status"), _mutations(spark, sf_dir))


@query
def mutation_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.acknowledged(_member_rows(spark, sf_dir), _mutations(spark, sf_dir))


@query
def update_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New verdicts for some rows, a few of them failed."""
    rows = synth.postings(spark, sf_dir).select(F.concat(F.lit("p"), "seq").alias("id"), "seq", "tier", "reason", F.lit("General").alias("suggested_resume"), "salary")
    new = rows.where("seq % 3 = 0").select("id", F.lit("INELIGIBLE").alias("tier"), F.lit("again").alias("reason"), F.lit("Data").alias("suggested_resume"), F.when(F.col("seq") % 2 == 0, "").otherwise("$1").alias("salary"), (F.col("seq") % 9 == 0).alias("failed"))
    return state.update_classification(rows, new).select("seq", "tier", "reason", "suggested_resume", "salary")


@query
def tier_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).where("tier != 'PENDING'")
    judged = verdicts.corrected(rows.withColumn("old_tier", F.col("tier"))).select("seq", F.col("tier").alias("new_tier"), "old_tier")
    return state.tier_transitions(judged)


@query
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir).select((F.col("seq") % 20).alias("run_id"), (F.col("seq") % 3 == 0).alias("stored"), "tier", (F.col("seq") % 50 == 0).alias("rate_limited"))
    return state.run_statistics(rows)


@query
def parked_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by kind of error."""
    rows = synth.postings(spark, sf_dir)
    error = F.element_at(F.array(*(F.lit(e) for e in ("BadRequestError", "AuthenticationError", "RateLimitError"))), (F.col("seq") % 3 + 1).cast("int"))
    message = F.when(F.col("seq") % 2 == 0, "Your credit balance is too low").otherwise("overloaded")
    return rows.where("tier = 'PENDING'").select(verdicts.error_kind(error, message).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query
def digest_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actionable rows from the mark on, the mark included, with link and pay as shown."""
    rows = synth.postings(spark, sf_dir).where((F.col("found_s") >= 900_000_000) & F.col("tier").isin("APPLY", "APPLY_CAVEAT"))
    return rows.select("seq", "tier", urls.display_href(F.col("url"), F.col("apply_url")).alias("link"), text.or_null(F.col("salary")).alias("salary"))


@query
def delta_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.delta_page(synth.postings(spark, sf_dir), F.timestamp_seconds(F.lit(850_000_000))).select("seq", "id", "found_s")


@query
def epoch_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch texts in seconds, in milliseconds, out of range and unreadable."""
    rows = synth.postings(spark, sf_dir)
    raw = F.element_at(F.array(F.col("found_s").cast("string"), (F.col("found_s") * 1000).cast("string"), F.lit("9e30"), F.lit("soon")), (F.col("seq") % 4 + 1).cast("int"))
    return rows.select("seq", F.unix_seconds(times.epoch_timestamp(raw)).alias("posted_s"))


@query
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.postings(spark, sf_dir)
    today = F.lit("2024-12-31").cast("date")
    return rows.select("seq", times.age_days(F.col("age"), today).cast("long").alias("age_days"), times.relative_days(F.col("posted_on")).cast("long").alias("posted_days"), times.relative_time(F.lit(synth.NOW_S) - F.col("found_s")).alias("ago"), times.relative_time(F.pmod(F.col("seq") * 977, F.lit(90_000))).alias("ago_short"))


@query
def carry_forward_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and arrow companies take the last company above them in their table."""
    blank = F.when(F.col("seq") % 3 == 1, "↳").when(F.col("seq") % 7 == 2, "").otherwise(F.col("company"))
    rows = synth.postings(spark, sf_dir).select((F.col("seq") - F.col("seq") % 25).alias("tbl"), F.col("seq").alias("pos"), blank.alias("company"))
    return lists.carried(rows, "tbl")


@query
def notification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and bodies of notices."""
    from tallysieve.operators.sinks import notices

    return notices(synth.postings(spark, sf_dir).withColumn("suggested_resume", F.lit("General"))).select("id", "title_header", "body", "priority")


@query
def events_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties from JSON, by type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.countDistinct("k").alias("n_k"))


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct events of a stream that delivers each twice."""
    from tallysieve.streaming.feeds import drained_dedup

    return drained_dedup(spark, f"{sf_dir}/events.parquet")


@query
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of web pages without furniture."""
    rows = table(spark, sf_dir, "pages").select("page_id", pages.page_text(F.col("html")).alias("content"))
    return rows.select("page_id", "content", F.length("content").alias("n_chars"))


@query
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical keys of page urls: rows with the same key are the same page."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.canonical_target(F.col("page_id").cast("string"), F.col("url")).alias("target"), urls.tracker_url(F.col("url")).alias("short"))
    return rows.groupBy("target", "short").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain words, accents off."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.plain(F.col("text")).alias("plain"))


@query
def board_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board payloads made from postings, read back as listings."""
    rows = synth.postings(spark, sf_dir)
    board = F.element_at(F.array(F.lit("greenhouse"), F.lit("lever"), F.lit("ashby"), F.lit("smartrecruiters")), (F.col("seq") % 4 + 1).cast("int"))
    job = rows.select("company", board.alias("platform"), "seq", "title", "location", "url", "description", "found_s")
    greenhouse = F.to_json(F.struct(F.array(F.struct("title", F.struct(F.col("location").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("description").alias("content"), F.lit("2024-01-01").alias("updated_at"))).alias("jobs")))
    lever = F.to_json(F.array(F.struct(F.col("title").alias("text"), F.struct("location").alias("categories"), F.col("url").alias("hostedUrl"), F.col("description").alias("descriptionPlain"), (F.col("found_s") * 1000).alias("createdAt"))))
    ashby = F.to_json(F.struct(F.array(F.struct("title", "location", F.lit("").alias("jobUrl"), F.col("url").alias("applyUrl"), F.col("description").alias("descriptionPlain"), F.lit("2024-01-02").alias("publishedAt"))).alias("jobs")))
    smart = F.to_json(F.struct(F.array(F.struct(F.col("title").alias("name"), F.col("url").alias("ref"), F.lit("2024-01-03").alias("releasedDate"), F.struct(F.col("location").alias("city"), F.lit("").alias("region"), F.lit("us").alias("country")).alias("location"))).alias("content")))
    payload = F.when(F.col("platform") == "greenhouse", greenhouse).when(F.col("platform") == "lever", lever).when(F.col("platform") == "ashby", ashby).otherwise(smart)
    landed = job.select("company", "platform", F.lit("").alias("token"), F.lit(0).alias("page"), payload.alias("payload"))
    return boards.board_listings(landed, F.timestamp_seconds(F.lit(synth.NOW_S))).select("id", "title", "company", "location", "url", "posted_at", F.length("description").alias("n_description"))


@query
def maintenance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch maintenance jobs would change, by job."""
    from tallysieve.operators.maintenance import change_log

    rows = keyed(spark, sf_dir)
    stale = F.when(F.col("seq") % 10 == 0, None).otherwise(F.col("norm_key"))
    return change_log(rows.withColumn("norm_key", stale)).groupBy("job", "field").agg(F.count("*").alias("n"))


@query
def form_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a made-up profile answers to made-up form labels."""
    label = F.element_at(F.array(*map(F.lit, synth.FORM_LABELS)), (F.col("seq") % len(synth.FORM_LABELS) + 1).cast("int"))
    profile = F.create_map(*(F.lit(x) for pair in synth.PROFILE.items() for x in pair))
    counted = synth.postings(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return counted.select("label", forms.field_of(F.col("label")).alias("asked"), forms.answer(F.col("label"), profile)["value"].alias("value"), forms.is_unchosen(F.col("label")).alias("unchosen"), "n")


@query
def form_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which option, if any, an answer chooses, and the answer's best key in a list."""
    rows = synth.postings(spark, sf_dir).select(F.col("seq").alias("form"), F.lit("k").alias("key"), F.element_at(F.array(*map(F.lit, synth.ANSWERS)), (F.col("seq") % len(synth.ANSWERS) + 1).cast("int")).alias("value"))
    options = rows.select("form", "key", F.explode(F.array(*map(F.lit, synth.OPTIONS))).alias("option"))
    found = chosen_options(rows, options)
    return found.select("form", "value", "option", forms.best_key(F.col("value"), F.array(*map(F.lit, synth.ANSWER_KEYS))).alias("best"))


@query
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of forms made from events, eight to a form: radio buttons collapse, repeated cells and optional keys go."""
    event, a = F.col("event_id"), F.col("event_id") * 7919 % 997
    item = (event % 8).cast("string")
    key = F.when(a % 5 == 0, "").when(a % 5 == 1, F.concat(F.lit("37-"), item, F.lit("-2"))).otherwise(F.concat((a % 7).cast("string"), F.lit("-"), item))
    kind = F.when(F.col("user_id") % 2 == 0, "radio").otherwise("text")
    elements = table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("form"), (event % 8).alias("pos"), key.alias("id"), F.col("event_type").alias("name"), kind.alias("type"))
    fields = logical_fields(elements, "^6-")
    return fields.select("form", "key", "kind", F.get("members", F.lit(0)).alias("first_pos"), F.size("members").alias("n_members"))


@query
def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and gaps of profiles made from customers."""
    c = F.col("c_custkey")
    address = F.struct(F.when(c % 4 == 0, forms.TO_FILL).otherwise("Austin").alias("city"), F.when(c % 3 == 0, "United States").when(c % 3 == 1, "Canada").alias("country"))
    person = F.struct(F.when(c % 5 == 0, "").otherwise("Al").alias("preferred_first_name"), F.lit("Alexis").alias("legal_first_name"), F.col("c_name").alias("last_name"), address.alias("address"))
    work = F.struct(F.when(c % 2 == 0, c % 4 == 0).alias("us_citizen"))
    profile = F.to_json(F.struct(person.alias("personal"), work.alias("work_authorization"), F.array(F.lit("sql"), F.when(c % 6 == 0, forms.TO_FILL).otherwise("spark")).alias("skills")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", profile.alias("profile"))
    rows = rows.withColumn("v", forms.profile_values(F.col("profile"))).join(unfilled(rows, "c_custkey", "profile"), "c_custkey")
    return rows.select("c_custkey", *(F.element_at("v", F.lit(n)).alias(n) for n in ("first_name", "last_name", "resides_in_us", "us_citizen")), F.size("v").alias("n_values"), F.array_join("gaps", "|").alias("gaps"))


@query
def avatar_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of companies, some behind signs."""
    sign = F.element_at(F.array(*map(F.lit, synth.SIGNS)), (F.col("seq") % len(synth.SIGNS) + 1).cast("int"))
    rows = synth.postings(spark, sf_dir).select(F.concat(sign, "company").alias("company"))
    return rows.groupBy("company").agg(F.count("*").alias("n")).select("company", forms.avatar_letter(F.col("company")).alias("letter"), "n")


@query
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages of searches made from events are read, and why each search ends."""
    a, user = F.col("event_id") * 7919 % 997, F.col("user_id")
    error = F.when(a % 50 == 0, "rate_limited").when(a % 50 == 1, "http")
    first = F.when(a % 11 == 0, 0).when(user % 7 == 0, 6).otherwise(10)
    again = F.when(first == 0, F.when(a % 2 == 0, 10).otherwise(0))
    stored = F.when(a % 9 == 0, 10).otherwise(3)
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("search"), (F.col("event_id") % 8).alias("page"), error.alias("error"), first.alias("n_listings"), again.alias("n_retry"), stored.alias("n_stored"))
    return paging.pages_read(rows).select("search", "page", "stopped")


@query
def detail_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the descriptions behind application links."""
    counted = synth.postings(spark, sf_dir).groupBy("apply_url").agg(F.count("*").alias("n"))
    return counted.select("apply_url", details.route(F.col("apply_url")).alias("route"), F.array_join(details.requests(F.col("apply_url")), "|").alias("requests"), "n")


@query
def detail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions from answers of five platforms, made from postings."""
    seq = F.col("seq").cast("string")
    uuid = F.concat(F.lpad(seq, 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    role, kind = F.concat(F.lit("Role "), seq), F.col("seq") % 5
    url = (
        F.when(kind == 0, F.concat(F.lit("https://job-boards.greenhouse.io/acme/jobs/"), seq))
        .when(kind == 1, F.concat(F.lit("https://jobs.lever.co/acme/"), uuid, F.lit("/apply")))
        .when(kind == 2, F.concat(F.lit("https://jobs.ashbyhq.com/acme/"), uuid))
        .when(kind == 3, F.concat(F.lit("https://acme.wd1.myworkdayjobs.com/en-US/Careers/job/Austin/"), seq))
        .otherwise(F.concat(F.lit("https://careers-acme.icims.com/jobs/"), seq, F.lit("/job")))
    )
    other = F.struct(F.lit("x").alias("id"), F.lit("other").alias("descriptionPlain"))
    payload = (
        F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("&lt;p&gt;"), role, F.lit("&lt;/p&gt;")).alias("content"))))
        .when(kind == 1, F.to_json(F.struct(F.col("description").alias("descriptionPlain"))))
        .when(kind == 2, F.to_json(F.struct(F.array(other, F.struct(uuid.alias("id"), role.alias("descriptionPlain"))).alias("jobs"))))
        .when(kind == 3, F.to_json(F.struct(F.struct(F.concat(F.lit("<p>"), role, F.lit("</p>")).alias("jobDescription")).alias("jobPostingInfo"))))
        .otherwise(F.concat(F.lit("<body><div>menu</div><div class='iCIMS_JobContent x'>"), F.repeat(role, F.when(F.col("seq") % 2 == 0, F.lit(60)).otherwise(F.lit(2))), F.lit("</div></body>")))
    )
    landed = synth.postings(spark, sf_dir).select("seq", url.alias("url"), payload.alias("payload"))
    return landed.select("seq", details.route(F.col("url")).alias("route"), details.description(F.col("url"), F.col("payload")).alias("description"))


from tallysieve.plans import live, workflow  # noqa: E402,F401  register their queries
