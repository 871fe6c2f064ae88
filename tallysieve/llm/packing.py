"""Optimal length buckets and token-budget batches.

Texts longer than the context are cut into pieces.  The global histogram of piece
lengths has at most ``context`` bins; dynamic programming over it chooses the bucket
lengths that minimise padding when every piece is padded to its bucket's length.
Inside each bucket, pieces form batches of as many rows as the token budget allows.

Rows are numbered within hash shards of a bucket and moved by the shards' offsets,
so no task gets a whole bucket, and only the last batch of a bucket is not full.
Rows of one id are told apart by their token counts, so results do not depend on order;
rows that are alike are counted first and get their numbers as a run.

Defined results: a text without tokens (null, empty, blank) gives one row with piece,
bucket and batch null; repeated rows are packed each; a null id is an id; a very long text
has as many pieces as it needs; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysieve.llm.textkit import saved, text_or_empty

CONTEXT, BUCKETS, BUDGET = 2048, 8, 65_536
SHARD_ROWS = 20_000


def best_buckets(histogram: dict[int, int], buckets: int) -> tuple[list[int], int]:
    """(ascending bucket lengths, tokens of padding): the least padding with at most ``buckets`` lengths."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c), dtype=np.int64)
    if not len(lengths):
        return [], 0
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    rows, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    best = np.append(0.0, np.full(len(lengths), np.inf))
    back, totals = [], []
    for _ in range(min(buckets, len(lengths))):
        # Lengths i..j share the bucket of length j.
        cost = best[None, :-1] + lengths[:, None] * (rows[1:, None] - rows[None, :-1]) - (tokens[1:, None] - tokens[None, :-1])
        cost[np.triu_indices(len(lengths), 1)] = np.inf
        back.append(cost.argmin(axis=1))
        best = np.append(np.inf, cost.min(axis=1))
        totals.append(best[-1])
    used = int(np.argmin(totals)) + 1
    out, j = [], len(lengths)
    for step in range(used - 1, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[step][j - 1])
    return out[::-1], int(round(min(totals)))


def token_count(text: Column) -> Column:
    """Runs without blanks."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def pieces(docs: DataFrame, context: int = CONTEXT, tokens: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, piece, start and length of every piece; ``tokens`` is a count by any tokenizer."""
    n = (token_count(text_or_empty()) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long")
    counted = docs.select("doc_id", n.alias("n_tokens"))
    cut = counted.select("doc_id", "n_tokens", F.explode_outer(F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {context}")))).alias("piece"))
    return cut.select("doc_id", "n_tokens", "piece", (F.col("piece") * context).alias("start"), F.when(F.col("piece").isNotNull(), F.least(F.lit(context).cast("long"), F.col("n_tokens") - F.col("piece") * context)).alias("length"))


def pack(docs: DataFrame, *, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, tokens: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, piece, start, length, bucket (its length), batch and slot of every piece.

    Batches are numbered from 0 in each bucket; a batch has at most ``budget``
    padded tokens, or one row where the bucket is longer than the budget.
    """
    cut = saved(pieces(docs, context, tokens))
    histogram = {r["length"]: r["n"] for r in cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    bounds, _ = best_buckets(histogram, buckets)
    bucket = F.lit(None).cast("long")
    shards = F.lit(1)
    rows = F.lit(1)
    by_length = sorted(histogram.items())
    for bound in reversed(bounds):
        below = max((b for b in bounds if b < bound), default=0)
        size = sum(c for n, c in by_length if below < n <= bound)
        inside = F.col("length") <= bound
        bucket = F.when(inside, F.lit(bound).cast("long")).otherwise(bucket)
        shards = F.when(inside, F.lit(-(-size // SHARD_ROWS))).otherwise(shards)
        rows = F.when(inside, F.lit(max(1, budget // bound))).otherwise(rows)
    placed = cut.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), shards)).withColumn("rows", rows)
    names = ["doc_id", "n_tokens", "piece", "start", "length", "bucket", "shard", "rows"]
    full = placed.where("length > 0").groupBy(*names).agg(F.count("*").alias("same"))
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")
    numbered = full.withColumn("k", F.sum("same").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("same"))
    counts = full.groupBy("bucket", "shard").agg(F.sum("same").alias("n"))
    before = counts.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    placed = numbered.join(before, ["bucket", "shard"]).withColumn("k", F.col("k") + F.col("before"))
    # Rows that are alike get a run of numbers, in parts that tasks can share.
    parts = placed.withColumn("lo", F.explode(F.expr(f"sequence(0L, same - 1, {SHARD_ROWS}L)")))
    if (full.agg(F.max("same").alias("most")).first().most or 0) > SHARD_ROWS:
        parts = parts.repartition("doc_id", "piece", "n_tokens", "lo")
    packed = parts.withColumn("at", F.explode(F.expr(f"sequence(k + lo, k + least(lo + {SHARD_ROWS}L, same) - 1)")))
    packed = packed.select("doc_id", "n_tokens", "piece", "start", "length", "bucket", F.expr("at div rows").alias("batch"), F.expr("at % rows").cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    bare = cut.where("length IS NULL").select("doc_id", "n_tokens", "piece", "start", "length", none.alias("bucket"), none.alias("batch"), none.alias("slot"))
    return packed.unionByName(bare)
