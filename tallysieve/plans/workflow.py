"""Registered queries of sources, the ingest workflow, control state and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve import synth
from tallysieve.functions import times
from tallysieve.operators import maintenance, paging, process, resolve, sinks, state, views
from tallysieve.operators.gates import GATES
from tallysieve.plans.queries import keyed, query, table
from tallysieve.sources import boards, lists, pages


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).withColumn("id", F.concat(F.when(F.col("seq") % 3 == 1, "gh:").otherwise(""), F.lit("p"), "seq"))


def _every(n: int, at: int = 0) -> Column:
    return F.col("seq") % n == at


@query
def search_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of search pages made of one card a posting; some cards have no id, no link or an easy mark."""
    mark = F.when(_every(7, 3), "other:").otherwise("urn:li:jobPosting:")
    link = F.when(_every(9), "").otherwise(F.concat(F.lit('<a class="base-card__full-link x" href="'), "url", F.lit('"></a>')))
    html = F.concat(
        F.lit('<ul><li><div data-entity-urn="'), mark, F.col("seq") + 1_000_000, F.lit('"><h3 class="base-search-card__title"> '), "title", F.lit(' </h3><h4 class="base-search-card__subtitle">'), "company",
        F.lit('</h4><span class="job-search-card__location">'), "location", F.lit('</span><time datetime="2024-05-01"></time>'), link, F.when(_every(5), "<span>Easy Apply</span>").otherwise(""), F.lit("</div></li></ul>"),
    )
    rows = synth.postings(spark, sf_dir).select(F.lit("intern").alias("search_term"), html.alias("html"))
    return pages.card_listings(rows).select("id", "title", "company", "location", "url", "posted_at", "is_easy_apply")


@query
def search_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of posting pages: text or criteria, structured pay or a chip, the link outside."""
    body = F.when(_every(4), "<ul class='description__job-criteria-list'><li>Level</li><li>Intern</li></ul>").otherwise(F.concat(F.lit("<div class='show-more-less-html__markup'><p>Role "), "seq", F.lit("</p><p>Learn</p></div>")))
    pay = F.concat(F.lit('"baseSalary":{"value":{"minValue":'), F.lit(20_000) + F.col("seq"), F.lit(',"maxValue":90000,"unitText":"YEAR"}},'))
    facts = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting",'), F.when(_every(2), pay).otherwise(""), F.lit('"directApply":'), F.when(_every(3), "true").otherwise("false"), F.lit(',"url":"https://careers.example.com/'), "seq", F.lit('"}</script>'))
    chip = F.when(_every(5), "<span class='salary'> $25/hr - $35/hr </span>").otherwise("")
    rows = synth.postings(spark, sf_dir).select(F.col("seq").cast("string").alias("id"), F.concat(F.lit("<html><body>"), facts, chip, body, F.lit("</body></html>")).alias("html"))
    return pages.details(rows).select("id", "description", "apply_url", "is_easy_apply", "salary")


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """README tables (source_name, text) of 25 postings, one half of them HTML with arrows, the other half in pipes."""
    tbl, pos = F.col("seq") - F.col("seq") % 25, F.col("seq") % 25
    company = F.when((pos > 0) & _every(3, 1), "↳").otherwise(F.concat(F.lit("Company "), "seq"))
    link = F.when(_every(8, 5), "").otherwise(F.concat(F.lit('<a href="https://careers.example.com/'), "seq", F.lit('">Apply</a>')))
    age = F.concat((F.col("seq") % 10).cast("string"), F.lit("d"))
    cells = (company, F.concat(F.lit("<b>Intern "), "seq", F.lit("</b>")), F.lit("Austin, TX"), link, age)
    as_html = F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>"))
    as_pipes = F.concat(F.lit("| "), *(x for c in cells for x in (c, F.lit(" | "))))
    rows = synth.postings(spark, sf_dir).select(tbl.alias("tbl"), pos.alias("pos"), F.when(tbl % 2 == 0, as_html).otherwise(as_pipes).alias("line"))
    lines = rows.groupBy("tbl").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    html = F.concat(F.lit("# Jobs\n<table><tbody>"), F.array_join("lines", ""), F.lit("</tbody></table>"))
    pipes = F.concat(F.lit("| Company | Role | Place | Link | Age |\n| --- | --- | --- | --- | --- |\n"), F.array_join("lines", "\n"), F.lit("\nEnd"))
    return lines.select(F.concat(F.lit("list"), "tbl").alias("source_name"), F.when(F.col("tbl") % 2 == 0, html).otherwise(pipes).alias("text"))


@query
def readme_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the README tables."""
    found = lists.readme_listings(readmes(spark, sf_dir), F.timestamp_seconds(F.lit(synth.NOW_S)))
    return found.select("id", "title", "company", "location", "url", F.left("posted_at", F.lit(10)).alias("posted_day"), "search_term")


@query
def workday_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 50 postings in pages of 20 under a total of 35; the second page repeats a path of the first."""
    board, at = F.col("seq") - F.col("seq") % 50, F.col("seq") % 50
    path = F.concat(F.lit("/job/"), F.when(at == 25, F.col("seq") - 25).otherwise(F.col("seq")))
    job = F.struct("title", path.alias("externalPath"), F.col("location").alias("locationsText"), F.col("posted_on").alias("postedOn"))
    rows = synth.postings(spark, sf_dir).select(board.alias("board"), F.floor(at / 20).cast("int").alias("page"), at.alias("at"), job.alias("job"))
    made = rows.groupBy("board", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "job"))), lambda x: x["job"]).alias("jobPostings"))
    payload = F.to_json(F.struct(F.when(F.col("page") == 0, 35).alias("total"), "jobPostings"))
    landed = made.select(F.concat(F.lit("Board "), "board").alias("company"), "page", payload.alias("payload"))
    registry = synth.postings(spark, sf_dir).where(_every(50)).select(F.concat(F.lit("Board "), "seq").alias("company"), F.lit("workday").alias("platform"), F.concat(F.lit("acme"), "seq", F.lit(":wd5:careers")).alias("token"))
    found = boards.workday(boards.with_registry(landed, registry), F.timestamp_seconds(F.lit(synth.NOW_S)))
    return found.select("id", "title", "company", "location", "url", F.left("posted_at", F.lit(10)).alias("posted_day"))


@query
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of pieces of markup."""
    html = F.concat(F.lit("<div><p>Role&nbsp;"), "seq", F.lit("</p><ul><li>"), "title", F.lit("</li><li>&lt;b&gt;</li></ul></div>"))
    return synth.postings(spark, sf_dir).select("seq", pages.html_text(html).alias("text"))


@query
def changed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit feeds whose newest entry is not the one seen last, and the raw address of each list."""
    name = F.concat(F.lit("list"), "seq")
    feed = F.concat(F.lit("<feed><id>tag:feed</id>"), F.when(_every(6), "").otherwise(F.concat(F.lit("<entry><id>commit-"), F.col("seq") % 4, F.lit("</id></entry><entry><id>old</id></entry>"))), F.lit("</feed>"))
    rows = synth.postings(spark, sf_dir)
    seen = rows.where("seq % 5 < 3").select(name.alias("key"), F.concat(F.lit("commit-"), F.col("seq") % 3).alias("value"))
    found = lists.changed(rows.select(name.alias("source_name"), feed.alias("feed")), seen)
    raw = F.concat(F.lit("https://raw.githubusercontent.com/acme/"), "source_name", F.lit("/refs/heads/dev/README.md"))
    owner, repository, branch = lists.raw_url_parts(raw)
    return found.select("source_name", "commit", owner.alias("owner"), repository.alias("repository"), branch.alias("branch"))


@query
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fast path of a search: its first page alone, and why it would end there."""
    a = F.col("event_id") * 7919 % 997
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 8").alias("search"), (F.col("event_id") % 8).alias("page"), F.when(a % 50 == 0, "rate_limited").alias("error"), F.lit(10).alias("n_listings"), F.lit(0).alias("n_retry"), (a % 12).alias("n_stored"))
    return paging.pages_read(rows.where("page = 0")).groupBy("stopped").agg(F.count("*").alias("n"))


@query
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's status set at once and verified; then counted."""
    rows = _postings(spark, sf_dir).select("seq", F.concat(F.lit("p"), "seq").alias("id"), "status")
    ids = ["p1", "p2", "p3", "p2"]
    done = state.set_group_status(rows, ids, "applied")
    unverified = state.verify_status(done, ids, "applied").select(F.lit("unverified").alias("status"))
    return done.select("status").union(unverified).groupBy("status").agg(F.count("*").alias("n"))


@query
def valid_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids as requests give them: repeated, malformed, empty and too many."""
    own = F.concat(F.lit("gh:"), "seq")
    many = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("a-"), k))
    ids = F.when(_every(5), F.array(own, own)).when(_every(5, 1), F.array(own, F.lit("bad id"))).when(_every(5, 2), F.array().cast("array<string>")).when(_every(5, 3), many).otherwise(F.array(own, F.lit("x_1")))
    good = state.valid_ids(ids)
    return synth.postings(spark, sf_dir).select("seq", F.array_join(good, ",").alias("ids"))


@query
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control state with keys set anew, added and removed."""
    rows = synth.postings(spark, sf_dir).select(F.concat(F.lit("k"), F.col("seq")).alias("key"), F.concat(F.lit("v"), F.col("seq")).alias("value"))
    for key, value in (("k3", "new"), ("k4", None), ("other", "added")):
        rows = state.put_state(rows, key, value)
    return rows


@query
def parked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose verdict failed wait; unknown tiers become APPLY_CAVEAT."""
    rows = synth.postings(spark, sf_dir).select("seq", F.when(_every(4), "MAYBE").otherwise(F.col("tier")).alias("tier"), F.when(_every(6), True).when(_every(6, 1), None).otherwise(False).alias("failed"))
    return state.park(rows).groupBy("tier").agg(F.count("*").alias("n"))


@query
def outage_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether outages and their ends are announced, by marks of several ages."""
    now = F.timestamp_seconds(F.lit(synth.NOW_S))
    mark = F.when(_every(4), "").when(_every(4, 1), "unreadable").otherwise(F.date_format(now - F.make_dt_interval(F.lit(0), (F.col("seq") % 12).cast("int")), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    kind = F.element_at(F.array(F.lit("billing"), F.lit("auth"), F.lit("transient")), (F.col("seq") % 3 + 1).cast("int"))
    rows = synth.postings(spark, sf_dir).select("seq", state.alert_due(mark, now, kind).alias("alert"), state.recovery_due(mark, F.when(_every(5), None).otherwise(F.col("seq") % 2)).alias("recovery"))
    return rows.groupBy("alert", "recovery").agg(F.count("*").alias("n"))


@query
def run_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run may start: one source has a fresh unfinished run, the others stale or finished ones."""
    now = F.timestamp_seconds(F.lit(synth.NOW_S))
    source = F.element_at(F.array(F.lit("search"), F.lit("board"), F.lit("list")), (F.col("seq") % 3 + 1).cast("int"))
    ago = F.when(_every(3), F.col("seq") % 60).otherwise(F.lit(20) + F.col("seq") % 60).cast("int")
    runs = synth.postings(spark, sf_dir).select(source.alias("source"), (now - F.make_dt_interval(F.lit(0), F.lit(0), ago)).alias("started_at"), F.when(_every(3, 1), now).alias("finished_at"))
    out = None
    for name in ("search", "board", "list"):
        one = state.run_allowed(runs, name, now).select(F.lit(name).alias("source"), "allowed")
        out = one if out is None else out.union(one)
    return out


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for each posting: its id and that of the row 7 on."""
    rows = synth.postings(spark, sf_dir)
    was = F.element_at(F.array(F.lit("new"), F.lit("saved")), (F.col("seq") % 2 + 1).cast("int"))
    ids = F.array(F.concat(F.lit("p"), "seq"), F.concat(F.lit("p"), F.col("seq") + 7))
    return rows.select(F.col("seq").alias("mutation_id"), ids.alias("ids"), F.lit("applied").alias("desired_status"), was.alias("previous_status"))


@query
def rolled_back_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed changes put back: only where no newer change of the id came."""
    changes = _changes(spark, sf_dir)
    return state.rolled_back(changes, changes.where("mutation_id % 3 = 0"))


@query
def overlaid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups under a pending status, nested rows included; they come without descriptions and in the list's columns."""
    rows = synth.postings(spark, sf_dir)
    nested = F.when(_every(3), F.array(F.struct(F.concat(F.lit("d"), "seq").alias("id"), "status", "description")))
    groups = rows.select(F.col("seq").alias("rn"), "id", "title", "company", "location", "url", "apply_url", F.lit(None).cast("string").alias("logo_url"), "tier", "reason", "status", "found_at", "is_easy_apply", "salary", "description", nested.alias("duplicates"))
    shown = state.apply_group_status(groups, rows.where(_every(4)).select(F.col("seq").alias("rn"), F.lit("applied").alias("status")))
    plain = views.strip_for_client(shown)
    first = F.get("duplicates", F.lit(0))
    kept = F.lit(len(views.view_columns(plain).columns)).cast("long")
    return plain.select("rn", "status", first["status"].alias("nested_status"), (F.col("description").isNull() & F.coalesce(first["description"].isNull(), F.lit(True))).alias("bare"), kept.alias("n_view_columns"))


@query
def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as the list shows them: the first row, how many others, the highest status, and its tier."""
    rows = synth.postings(spark, sf_dir).select("seq", "id", "title", "company", "location", "url", "apply_url", "is_easy_apply", "status", "tier", "found_at")
    groups = resolve.grouped(rows)
    return groups.select("seq", F.coalesce(F.size("duplicates"), F.lit(0)).cast("long").alias("n_others"), "status", "tier")


@query
def full_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.postings(spark, sf_dir).select("seq", times.full_timestamp(F.col("found_at")).alias("shown"))


@query
def empty_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all of whose searches found nothing."""
    rows = synth.postings(spark, sf_dir).select((F.col("seq") % 100).alias("run_id"), F.when(_every(4), 0).otherwise(F.col("seq") % 5).alias("total_raw"))
    return sinks.canary(rows).select("run_id")


@query
def refetch_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that are thin or begin with furniture."""
    d = F.when(_every(5), F.concat(F.lit("Skip to main content. "), "description")).when(_every(5, 1), None).otherwise(F.col("description"))
    return synth.postings(spark, sf_dir).select("seq", maintenance.needs_refetch(d).alias("due"))


def _verdicts(rows: DataFrame) -> DataFrame:
    tier = F.element_at(F.array(F.lit("APPLY"), F.lit("APPLY_CAVEAT"), F.lit("INELIGIBLE"), F.lit("MAYBE")), (F.col("seq") % 4 + 1).cast("int"))
    return rows.select("id", tier.alias("tier"), F.lit("told").alias("reason"), _every(7).alias("failed"), F.lit("Data").alias("suggested_resume"))


def _whole_verdicts(rows: DataFrame) -> DataFrame:
    """Verdicts with all that they may say; some fail, some postings have none."""
    pay, resume = F.when(_every(4, 1), "$9/hr"), F.when(_every(5), "").otherwise("Data")
    told = _verdicts(rows.where("seq % 11 != 0")).drop("reason", "suggested_resume")
    more = rows.select("id", F.concat(F.lit("told "), "seq").alias("reason"), resume.alias("suggested_resume"), pay.alias("salary"))
    return told.join(more, "id")


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings half of which have lost their descriptions."""
    return _postings(spark, sf_dir).withColumn("description", F.when(_every(2), F.when(_every(4), "").otherwise(None)).otherwise(F.col("description")))


def _counted(log: DataFrame) -> DataFrame:
    return log.groupBy("job", "field", F.when(F.col("field") == "tier", F.col("new")).alias("new")).agg(F.count("*").alias("n"))


@query
def filled_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions found for rows that lack them, of lists, actionable ones and rejected ones, and the tiers that follow."""
    rows, whole = _bare(spark, sf_dir), _postings(spark, sf_dir)
    found = whole.select("id", F.when(_every(10, 4), "").otherwise(F.col("description")).alias("description"))
    told = _verdicts(whole).withColumn("tier", F.when(F.col("tier") == "MAYBE", "APPLY").otherwise(F.col("tier")))
    out = None
    for kind in ("lists", "actionable", "rejected"):
        log = maintenance.filled(rows, kind, found, told)
        out = log if out is None else out.union(log)
    return _counted(out)


@query
def refetched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin descriptions of open APPLY rows fetched again, and all that their new verdicts change."""
    whole = _postings(spark, sf_dir).withColumn("suggested_resume", F.lit("General"))
    thin = whole.withColumn("description", F.when(_every(2), "Sign in to see more").otherwise(F.col("description")))
    return maintenance.refetched(thin, whole.select("id", "description"), _whole_verdicts(whole)).select("job", "id", "field", "new")


@query
def rejected_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows of any status that new verdicts promote, and resumes suggested anew."""
    rows = _postings(spark, sf_dir).withColumn("suggested_resume", F.when(_every(5), "Data").otherwise("General"))
    log = maintenance.rejected_recheck(rows, _whole_verdicts(rows)).union(maintenance.resume_recheck(rows, _verdicts(rows)))
    return log.select("job", "id", "field", "new")


@query
def fetched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a fetch adds where a row has none."""
    rows = _bare(spark, sf_dir)
    found = rows.select("id", F.when(_every(3), "").otherwise("text").alias("description"), F.lit("https://x.example").alias("apply_url"), F.when(_every(5), "$1").alias("salary"))
    return maintenance.fetched(rows, found).groupBy("field").agg(F.count("*").alias("n"))


@query
def audit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rejected rows new verdicts would promote, from a sample as large as all of them."""
    rows = _postings(spark, sf_dir)
    return maintenance.audit_sample(rows, _verdicts(rows), 2_000_000_000, 1)


@query
def processed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New listings enriched, judged, parked or stored, and notified."""
    rows, whole = _bare(spark, sf_dir), _postings(spark, sf_dir)
    facts = whole.select("id", "description", F.lit(None).cast("string").alias("apply_url"), F.when(_every(3), "$1/hr").alias("salary"))
    done = process.processed(rows, facts, _whole_verdicts(whole))
    return done.select("seq", "tier", "reason", "suggested_resume", "salary", "notify", (F.coalesce("description", F.lit("")) != "").alias("has_text"))


@query
def tenant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a tenant with title gates and no rules: failures are not stored."""
    rows = _postings(spark, sf_dir)
    done = process.tenant_processed(rows, _whole_verdicts(rows), GATES["hourly"])
    return done.select("seq", "tier", "reason", "salary", "notify")


@query
def digest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of one period: entries by tier and id, and none for an empty one."""
    rows = keyed(spark, sf_dir).where("found_s < 700000000")
    shown = lambda part, period: sinks.digest(part).select(F.lit(period).alias("period"), "n", F.md5("html").alias("html_md5"))
    return shown(rows, "one").union(shown(rows.where("false"), "none"))
