"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import saved


SPLIT_EDGES = 1000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): ``comp`` is the smallest node of the component.

    Labels spread along edges and then jump to their label's label, so the rounds
    grow with the logarithm of the longest path.  A node's edges meet its label in
    parts of about ``SPLIT_EDGES``, so a hub is no hot key; its neighbours' labels are
    summed up partially first.  Each round is a checkpoint in the shared folder.
    Self-loops and repeated edges do no harm; an empty edge list gives no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where(F.col("x") != F.col("y")).distinct()
    both = saved(both)
    nodes = both.groupBy("x").agg(F.min("y").alias("low"), F.ceil(F.count("*") / SPLIT_EDGES).cast("int").alias("parts"))
    labels = saved(nodes.select(F.col("x").alias("node"), F.least("x", "low").alias("comp"), "parts"))
    hubs = labels.where("parts > 1").select(F.col("node").alias("y"), "parts")
    if not hubs.isEmpty():
        both = both.join(hubs, "y", "left").fillna({"parts": 1})
        both = saved(both.select("x", "y", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part")))
    else:
        both = both.withColumn("part", F.lit(0))
    while True:
        told = labels.select(F.col("node").alias("y"), "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        near = both.join(told, ["y", "part"]).groupBy("x").agg(F.min("comp").alias("low"))
        spread = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "parts", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = saved(spread.join(up, "comp", "left").select("node", "parts", "was", F.least("comp", F.coalesce("above", "comp")).alias("comp")))
        labels = jumped.select("node", "comp", "parts")
        if jumped.where(F.col("was") != F.col("comp")).isEmpty():
            return labels.drop("parts")
