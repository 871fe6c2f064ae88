"""Deduplication on two independent keys, and matching against an external tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.functions.text import norm_key, or_null
from tallysieve.functions.urls import tracker_url
from tallysieve.operators.graph import saved


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose id and norm_key are both not in ``stored``.

    Two anti joins, each on one key: an OR of keys would compare all pairs.  A null
    norm_key matches nothing.
    """
    by_id = batch.join(stored.select("id"), "id", "left_anti")
    return by_id.join(stored.where(F.col("norm_key").isNotNull()).select("norm_key"), "norm_key", "left_anti").select(batch.columns)


def known_candidates(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids of ``batch`` rows that ``stored`` has by id or by norm_key, with the kind of match."""
    left = batch.select("id", "norm_key").distinct()
    by_id = left.join(stored.select("id"), "id", "left_semi").select("id", F.lit("id").alias("matched_by"))
    by_key = left.join(stored.where(F.col("norm_key").isNotNull()).select("norm_key"), "norm_key", "left_semi").select("id", F.lit("norm_key").alias("matched_by"))
    return by_id.union(by_key).groupBy("id").agg(F.min("matched_by").alias("matched_by"))


def first_per_key(rows: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The earliest row of each key."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def greedy_dedup(rows: DataFrame, order: str = "seq", keys_of_dropped: bool = False) -> DataFrame:
    """Keeps a row, in arrival order, if no kept row before it has its id or norm_key.

    A dropped row does not register its keys, so later rows are compared with kept
    rows only.  A row without norm_key is compared by its id alone, one without id by
    its norm_key alone; rows that tie in ``order`` come as they were read.

    Rounds decide it: the first of all undecided rows with its id that is also the first
    with its norm_key is kept, and what shares either with it goes.  Each round decides
    the first undecided row of every chain of clashes, and most rows in the first; only
    keys and places move.

    With ``keys_of_dropped`` the id of a dropped row counts as seen too.  Then only the
    first row of an id can stay, so it is the first of each norm_key among these.
    """
    own = F.monotonically_increasing_id()
    names = rows.columns
    numbered = saved(rows.withColumn("__own__", own))
    place = F.struct(F.col(order).alias("at"), F.col("__own__").alias("own"))
    by_id = F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("r"), F.col("__own__")))
    by_key = F.coalesce(F.concat(F.lit("k"), F.col("norm_key").cast("string")), by_id)
    left = numbered.select("__own__", place.alias("place"), by_id.alias("i"), by_key.alias("k"))
    if keys_of_dropped:
        first = left.groupBy("i").agg(F.min_by(F.struct("__own__", "place", "k"), "place").alias("r")).select("r.*")
        kept = first.groupBy("k").agg(F.min_by("__own__", "place").alias("__own__")).select("__own__")
        return numbered.join(kept, "__own__", "left_semi").select(names)
    kept = None
    while True:
        first_i = left.groupBy("i").agg(F.min("place").alias("first_i"))
        first_k = left.groupBy("k").agg(F.min("place").alias("first_k"))
        stays = (F.col("place") == F.col("first_i")) & (F.col("place") == F.col("first_k"))
        judged = saved(left.join(first_i, "i").join(first_k, "k").select("__own__", "place", "i", "k", stays.alias("stays")))
        now = judged.where("stays")
        kept = now.select("__own__") if kept is None else kept.union(now.select("__own__"))
        left = judged.where("NOT stays").drop("stays").join(now.select("i"), "i", "left_anti").join(now.select("k"), "k", "left_anti")
        left = saved(left)
        if left.isEmpty():
            return numbered.join(kept, "__own__", "left_semi").select(names)


def insert_new(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``stored`` and the rows of ``batch`` with new ids, the first of each; norm_key is computed anew."""
    fresh = batch.join(stored.select("id"), "id", "left_anti").withColumn("norm_key", norm_key(F.col("company"), F.col("title")))
    # Without arrival numbers the least row of an id stays, so a batch that runs again stores the same.
    fresh = first_per_key(fresh, "id", "seq" if "seq" in fresh.columns else F.to_json(F.struct(*fresh.columns)))
    defaults = {"tier": "APPLY_CAVEAT", "suggested_resume": "General", "status": "new"}
    for name, value in defaults.items():
        if name in fresh.columns:
            fresh = fresh.withColumn(name, F.coalesce(or_null(F.col(name)), F.lit(value)))
    return stored.unionByName(fresh, allowMissingColumns=True)


def match_tracker(stored: DataFrame, tracker: DataFrame) -> DataFrame:
    """(company, role, link, matched_id, method, already_applied) for each tracker row.

    The url decides, the first stored row with it wins; else the norm_key.  ``stored``
    has id, url, apply_url, norm_key, status and seq, its order.
    """
    urls = stored.select("id", "status", "seq", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("url").alias("u")), F.struct(F.lit(1).alias("k"), F.col("apply_url").alias("u")))).alias("x"))
    urls = urls.select("id", "status", F.struct("seq", "x.k").alias("place"), tracker_url(F.col("x.u")).alias("u")).where("u != ''")
    by_url = urls.groupBy("u").agg(F.min_by(F.struct("id", "status"), "place").alias("by_url"))
    by_key = stored.where(F.col("norm_key") != "").groupBy("norm_key").agg(F.min_by(F.struct("id", "status"), "seq").alias("by_key"))
    rows = tracker.select("company", "role", "link", tracker_url(F.col("link")).alias("u"), norm_key(F.col("company"), F.col("role")).alias("norm_key"))
    found = rows.join(by_url, "u", "left").join(by_key, "norm_key", "left")
    hit = F.coalesce("by_url", "by_key")
    method = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_key").isNotNull(), "norm_key")
    return found.select("company", "role", "link", hit["id"].alias("matched_id"), method.alias("method"), F.coalesce(hit["status"] == "applied", F.lit(False)).alias("already_applied"))
