"""Entity resolution: postings of the same job, from any source, as one entity.

Rows with the same recognised requisition are the same job.  Rows that share a
plain url, or a company bucket of at most ``MAX_BUCKET`` rows, are compared by
guarded metadata: company, place, season, year, state and specialisation may all
veto.  Entities are the connected components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysieve.functions import titles as T
from tallysieve.functions.locations import normalized_locations
from tallysieve.functions.text import plain_words, text
from tallysieve.functions.urls import application_href, canonical_target, is_search_site, target_words
from tallysieve.operators.graph import components, saved

MAX_BUCKET = 60
CONTAINMENT, JACCARD = 0.8, 0.55
RANKS = {"new": 0, "saved": 1, "dismissed": 2, "applied": 3}


def status_rank(status: Column) -> Column:
    rank = F.lit(0)
    for name, n in RANKS.items():
        rank = F.when(status == name, n).otherwise(rank)
    return rank


def status_of_rank(rank: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in RANKS)), rank)


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with rn, their place by found_at descending, then id.

    A total order needs one sorted sequence, but not one task: range partitions are
    sorted apart and numbered from their sizes.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = rows.repartitionByRange(int(parts), F.desc("found_at"), "id").sortWithinPartitions(F.desc("found_at"), "id")
    cut = saved(cut.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    sizes = cut.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"))
    place = F.col("__k").bitwiseAND((1 << 33) - 1) + F.col("before")
    return cut.join(F.broadcast(before), "__p").withColumn("rn", place).drop("__p", "__k", "before")


def featured(rows: DataFrame) -> DataFrame:
    """(rn, id) and the features that matching reads."""
    href = application_href(F.col("url"), F.col("apply_url"), F.col("is_easy_apply"))
    base = rows.select("rn", "id", "title", "company", "location", href.alias("href"))
    base = base.select("*", T.company_words(F.col("company")).alias("cw"), target_words(F.col("href")).alias("tw"))
    return base.select(
        "rn",
        canonical_target(F.col("id"), F.col("href")).alias("target"),
        "cw",
        F.array_union(plain_words(text(F.col("company"))), "tw").alias("cc"),
        F.array_join("tw", " ").alias("corpus"),
        normalized_locations(F.col("location")).alias("places"),
        T.seasons(F.col("title")).alias("seasons"),
        T.years(F.col("title")).alias("years"),
        T.states(F.col("title")).alias("states"),
        T.specializations(F.col("title")).alias("specs"),
        T.title_words(F.col("title"), F.col("company"), F.col("location")).alias("words"),
        is_search_site(F.col("href")).alias("search"),
    )


#: Features, or how to make them for the rows of a table (rn).
Features = DataFrame | Callable[[DataFrame], DataFrame]


def features_of(rows: DataFrame) -> Features:
    """The features of ``rows``, made only for those that are asked for; Spark moves no join below such a projection by itself."""
    return lambda asked: featured(rows.join(asked, "rn", "left_semi"))


_FEATURES = ("cw", "cc", "corpus", "places", "seasons", "years", "states", "specs", "words", "search")


def metadata_match(a: str, b: str) -> Column:
    """Whether two featured rows, as struct columns ``a`` and ``b``, are the same job by metadata."""
    x = lambda n: F.col(f"{a}.{n}")
    y = lambda n: F.col(f"{b}.{n}")
    some = lambda n: (F.size(x(n)) > 0) & (F.size(y(n)) > 0)
    within = lambda small, large: F.size(F.array_except(small, large)) == 0
    company = some("cw") & ((T.containment(x("cw"), y("cw")) == 1) | within(x("cw"), y("cc")) | within(y("cw"), x("cc")))
    near = F.exists(x("places"), lambda p: y("corpus").contains(p)) | F.exists(y("places"), lambda p: x("corpus").contains(p))
    place = some("places") & (F.arrays_overlap(x("places"), y("places")) | near)
    clash = T.disagree(x("seasons"), y("seasons")) | T.disagree(x("years"), y("years")) | T.disagree(x("states"), y("states"))
    special = ~T.disagree(x("specs"), y("specs")) & ~T.disagree(T.strong(x("specs")), T.strong(y("specs")))
    share = T.containment(x("words"), y("words"))
    same = (F.size(x("words")) == F.size(y("words"))) & (share == 1)
    close = (share >= CONTAINMENT) & (T.jaccard(x("words"), y("words")) >= JACCARD)
    return company & place & ~clash & special & some("words") & (same | ((x("search") != y("search")) & close))


def target_edges(features: DataFrame, whole: Features | None = None) -> DataFrame:
    """Each row with the first of its target; rows of a plain url only if the metadata agree.

    ``whole`` has the features that ``matching`` reads, if they aren't among ``features``.
    """
    placed = features.select("rn", "target")
    first = placed.groupBy("target").agg(F.min("rn").alias("first"))
    rest = placed.join(first, "target").where("rn != first")
    sure = rest.where(~F.col("target").startswith("url:")).select(F.col("first").alias("a"), F.col("rn").alias("b"))
    pairs = rest.where(F.col("target").startswith("url:")).select(F.col("first").alias("a"), F.col("rn").alias("b"))
    return sure.union(matching(pairs, features if whole is None else whole))


def bucket_pairs(features: DataFrame, max_bucket: int = MAX_BUCKET, sizes: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a < b) of rows that share a company bucket of at most ``max_bucket`` rows.

    The bound is the feature: larger companies have many parallel roles, whose
    copies the targets find.  ``sizes`` (bucket, n) counts rows that aren't among
    ``features`` too.
    """
    placed = features.select("rn", F.explode(T.company_buckets(F.col("cw"))).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")) if sizes is None else sizes
    members = placed.join(sizes.where(F.col("n").between(2, max_bucket)).select("bucket"), "bucket", "left_semi").groupBy("bucket").agg(F.sort_array(F.collect_list("rn")).alias("m"))
    each = members.select(F.posexplode("m").alias("i", "a"), "m")
    return each.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).distinct()


def matching(pairs: DataFrame, features: Features) -> DataFrame:
    """The pairs (a, b) whose metadata agree.  Only rows of pairs have their features moved, and made if they aren't yet."""
    pairs = saved(pairs)

    def side(s: str) -> DataFrame:
        asked = pairs.select(F.col(s).alias("rn")).distinct()
        made = features(asked) if callable(features) else features.join(asked, "rn", "left_semi")
        return made.select(F.col("rn").alias(s), F.struct(*_FEATURES).alias(f"f{s}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(metadata_match("fa", "fb")).select("a", "b")


def entities(rows: DataFrame) -> DataFrame:
    """``rows`` with rn and root, the rn of their entity's first row."""
    placed = ordered(rows)
    features = featured(placed)
    # Every row needs its target and company; the other features, several times as large, only rows that are compared.
    keys = saved(features.select("rn", "target", "cw"))
    whole = features_of(placed)
    edges = target_edges(keys, whole).union(matching(bucket_pairs(keys), whole))
    roots = components(edges).withColumnRenamed("node", "rn")
    return placed.join(roots, "rn", "left").withColumn("root", F.coalesce("comp", "rn")).drop("comp")


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each entity: its first row's columns, the highest status, and its other rows in order as duplicates."""
    return _packed(entities(rows), rows.columns)


def _packed(found: DataFrame, names: list[str]) -> DataFrame:
    row = F.struct(*names)
    packed = found.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("rn", row.alias("row")))).alias("m"), F.max(status_rank(F.col("status"))).alias("rank"))
    lead = F.element_at("m", 1)["row"]
    several = F.size("m") > 1
    others = F.transform(F.slice("m", 2, F.size("m")), lambda x: x["row"])
    columns = [F.when(several, status_of_rank(F.col("rank"))).otherwise(lead["status"]).alias("status") if n == "status" else lead[n].alias(n) for n in names]
    return packed.select(F.col("root").alias("rn"), *columns, F.when(several, others).alias("duplicates"))


def flattened(groups: DataFrame) -> DataFrame:
    """All rows of grouped rows, the leaders with their own columns."""
    names = [n for n in groups.columns if n not in ("rn", "duplicates")]
    leaders = groups.select(*names)
    return leaders.unionByName(groups.where(F.col("duplicates").isNotNull()).select(F.explode("duplicates").alias("d")).select(*(F.col("d")[n].alias(n) for n in names)))


def _match_keys(row: str) -> list[Column]:
    """The target and the company buckets of the posting in a struct column; null for a null one."""
    c = lambda n: F.col(f"{row}.{n}")
    there = c("id").isNotNull()
    href = application_href(c("url"), c("apply_url"), c("is_easy_apply"))
    return [F.when(there, canonical_target(c("id"), href)).alias(f"{row}_target"), F.when(there, T.company_buckets(T.company_words(c("company")))).alias(f"{row}_buckets")]


def _updated(rows: DataFrame, incoming: DataFrame, names: list[str]) -> DataFrame:
    """(lead, was, now, changed) of ``rows`` (lead, was) and rows ``incoming``, which replace those of their id; the higher status stays."""
    new = incoming.select(F.struct(*names).alias("new"))
    both = rows.join(new, rows["was.id"] == F.col("new.id"), "full_outer")
    rank = F.greatest(*(F.coalesce(status_rank(F.col(f"{r}.status")), F.lit(0)) for r in ("was", "new")))
    changed = F.col("new.id").isNotNull()
    now = F.struct(*(status_of_rank(rank).alias(n) if n == "status" else F.when(changed, F.col(f"new.{n}")).otherwise(F.col(f"was.{n}")).alias(n) for n in names))
    return both.select("lead", "was", now.alias("now"), changed.alias("changed"))


def _members(groups: DataFrame, names: list[str]) -> DataFrame:
    """(lead, was): each row of grouped rows with its leader's id."""
    leaders = groups.select(F.col("id").alias("lead"), F.struct(*names).alias("was"))
    others = groups.where(F.col("duplicates").isNotNull()).select(F.col("id").alias("lead"), F.explode("duplicates").alias("was"))
    return leaders.unionByName(others.select("lead", F.struct(*(F.col(f"was.{n}").alias(n) for n in names)).alias("was")))


def merged(groups: DataFrame, incoming: DataFrame) -> DataFrame:
    """Groups after an update: incoming rows replace those of their id, the higher status stays; the same as grouping all rows anew.

    Ids are unique in each.  Only groups that the update can change are grouped again:
    those with a row that shares the target or a company bucket of an incoming row, or
    of what it replaces.  In these a target's first row and a bucket's size may hang on
    rows of other groups, so both are taken from the keys of all rows; no other feature
    of an untouched group is made or moved.
    """
    names = [n for n in groups.columns if n not in ("rn", "duplicates")]
    groups = groups.select(*names, "duplicates")
    every = _updated(_members(groups, names), incoming, names)
    keys = saved(every.select("lead", F.col("now.id").alias("id"), F.struct(F.col("now.found_at").isNull().alias("late"), (-F.unix_micros("now.found_at")).alias("age"), F.col("now.id").alias("id")).alias("place"), "changed", *_match_keys("was"), *_match_keys("now")))
    changed = keys.where("changed")
    targets = changed.select(F.explode(F.array("was_target", "now_target")).alias("now_target")).where("now_target IS NOT NULL").distinct()
    buckets = changed.select(F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("was_buckets", "now_buckets")))).alias("bucket")).distinct()
    placed = keys.select("lead", "id", F.explode("now_buckets").alias("bucket"))
    hit = changed.select("lead").union(keys.join(targets, "now_target", "left_semi").select("lead")).union(placed.join(buckets, "bucket", "left_semi").select("lead"))
    leads = saved(hit.where("lead IS NOT NULL").distinct())
    rows = _updated(_members(groups.join(leads, groups["id"] == leads["lead"], "left_semi"), names), incoming, names).select("now.*")
    placed_rows = saved(ordered(rows))
    mine = placed_rows.select("id")
    own = keys.join(mine, "id", "left_semi")
    first = keys.join(own.select("now_target"), "now_target", "left_semi").groupBy("now_target").agg(F.min("place").alias("first"))
    known = first.join(mine, F.col("first.id") == F.col("id"), "left_semi").select(F.col("now_target").alias("target"), F.lit(True).alias("known"))
    sizes = placed.join(own.select(F.explode("now_buckets").alias("bucket")), "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("n"))
    # A row whose target's first row is elsewhere was not like it, and no other row of the target counts.
    features = featured(placed_rows).join(known, "target", "left").withColumn("target", F.when(F.col("known"), F.col("target")).otherwise(F.concat(F.lit("row:"), F.col("rn")))).drop("known")
    features = saved(features)
    edges = target_edges(features).union(matching(bucket_pairs(features, sizes=sizes), features))
    roots = components(edges).withColumnRenamed("node", "rn")
    found = placed_rows.join(roots, "rn", "left").withColumn("root", F.coalesce("comp", "rn"))
    anew = _packed(found, names).drop("rn")
    return groups.join(leads, groups["id"] == leads["lead"], "left_anti").unionByName(anew)
