"""URL filters: list rules, and association rules that FP-growth mines from labels.

A url becomes a set of tokens: its scheme, the suffixes of its host, all segments of
its path with each run of digits as 0, file endings and query keys.  Tokens that the same
labelled urls have, such as a host's suffixes, are mined as one.  Spark's FP-growth
finds token combinations of any size that go with the label ``block``; rules below the support
or confidence bounds, or no better than one of theirs with a token less, are dropped.  The rest are
indexed by their rarest token; a url looks its tokens up and a rule matches if the
url has all its tokens.  All of this runs as DataFrame operations.

Defined results: null and urls without ``://`` have empty host and path and match
nothing; equal urls are judged alike; without labels there are no mined rules and
the verdict is ``allow``; a page of several labels is bad if one of them is; null ids have no
label; very long urls are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import saved

#: Verdict and (host, path) of the list rules.
LIST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKED = "=block"
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.6
BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Parts:
    scheme: Column
    host: Column
    path: Column
    query: Column


def parts(url: Column) -> Parts:
    """Scheme, host (A-Z lower-cased), path and query; all empty without ``://``."""
    at = F.locate("://", url)
    has = url.isNotNull() & (at > 0)
    rest = F.when(has, F.substring(url, at + 3, F.length(url))).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    group = lambda k: F.regexp_extract(rest, pattern, k)
    scheme = F.when(has, F.substring(url, F.lit(1), at - 1)).otherwise("")
    return Parts(F.translate(scheme, _UPPER, _LOWER), F.translate(group(1), _UPPER, _LOWER), group(2), group(3))


def listed(host: Column, path: Column, rules: tuple = LIST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest list rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(p: Parts) -> Column:
    """Distinct tokens of a url."""
    labels = F.filter(F.split(p.host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")))
    segments = F.filter(F.split(F.regexp_replace(F.translate(p.path, _UPPER, _LOWER), "[0-9]+", "0"), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("p:"), x))
    ending = F.regexp_extract(F.regexp_replace(F.translate(p.path, _UPPER, _LOWER), "[0-9]+", "0"), r"\.([a-z0-9]+)$", 1)
    keys = F.transform(F.filter(F.split(p.query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    every = F.concat(F.array(F.concat(F.lit("s:"), p.scheme)), F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")), segments, F.array(F.concat(F.lit("e:"), ending)), keys)
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, confidence, lift, support) of the rules for ``block`` from rows of (tokens, blocked)."""
    rows = saved(labelled.select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    each = rows.select("row", F.explode("tokens").alias("token"))
    # No more than (tokens of a url) / min_support tokens are frequent.
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("where")).where(F.col("n") >= min_support * total)
    alike = saved(often.groupBy("n", "where").agg(F.min("token").alias("one"), F.collect_list("token").alias("all")))
    baskets = each.join(F.broadcast(alike.select(F.col("one").alias("token"))), "token").groupBy("row").agg(F.collect_set("token").alias("items"))
    baskets = rows.select("row", "blocked").join(baskets, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "blocked")
    baskets = saved(baskets.select(F.when(F.col("blocked"), F.array_append("items", BLOCKED)).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
    found = saved(pruned(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")))
    whole = found.select("rule_id", F.explode("tokens").alias("one")).join(F.broadcast(alike.select("one", "all")), "one")
    whole = whole.groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("tokens"))
    return saved(found.drop("tokens").join(whole, "rule_id").select("rule_id", "tokens", "confidence", "lift", "support"))


def pruned(rules: DataFrame) -> DataFrame:
    """The rules without those that have a rule of one token less and at least their confidence.

    What a dropped rule matches, the other matches too.  Each rule looks up its parts
    by their identity; rules are not compared pairwise.
    """
    whole = rules.where(F.size("tokens") > 1).select("rule_id", "confidence", "tokens", F.explode("tokens").alias("left_out"))
    part = whole.select(F.col("rule_id").alias("worse"), F.col("confidence").alias("bar"), F.xxhash64(F.array_remove("tokens", F.col("left_out"))).alias("rule_id"))
    worse = part.join(rules.select("rule_id", "confidence"), "rule_id").where("confidence >= bar").select(F.col("worse").alias("rule_id")).distinct()
    return rules.join(worse, "rule_id", "left_anti")


def inverted(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule_tokens): every rule under the one of its tokens that the fewest of ``urls`` (tokens) have."""
    df = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    each = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(df, "token", "left")
    order = F.struct(F.coalesce("df", F.lit(0)), "token")
    return each.groupBy("rule_id").agg(F.min_by("token", order).alias("token"), F.first("tokens").alias("rule_tokens")).select("token", "rule_tokens")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls, from rows of (url, tokens), that have all tokens of a rule."""
    index = saved(inverted(rules, urls))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of (page_id, url).

    A page is labelled ``block`` if the document of its id has quality 0.
    """
    p = parts(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = pages.select("page_id", "url", p.host.alias("host"), p.path.alias("path"))
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("blocked"))
    named = pages.select("page_id", "url").join(known, F.col("page_id") == F.col("doc_id")).select(tokens(p).alias("tokens"), "blocked")
    rules = mine(named)
    if rules.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    open_urls = rows.where(F.col("verdict").isNull() & F.col("url").isNotNull()).select("url").distinct()
    bad = saved(matched(open_urls.select("url", tokens(p).alias("tokens")), rules)).withColumn("hit", F.lit("block"))
    found = rows.join(bad, "url", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "hit", F.lit("allow")).alias("verdict"))
