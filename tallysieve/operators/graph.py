"""Connected components of an edge list."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's checkpoint folder, which all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: A node with more edges than this has them in parts.
SPLIT_EDGES = 1000


def components(edges: DataFrame, split: int = SPLIT_EDGES) -> DataFrame:
    """(node, comp) of edges (a, b); comp is the component's smallest node.

    In each round a node takes the smallest label among its neighbours', then its
    label's label; the rounds end when no label changes.  The edges of a hub meet its
    label in parts of about ``split``, so no task gets all of them.
    """
    ends = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    near = saved(ends.union(ends.select("b", "a")).distinct())
    nodes = near.groupBy("a").agg(F.min("b").alias("low"), F.ceil(F.count("*") / split).cast("int").alias("parts"))
    labels = saved(nodes.select(F.col("a").alias("node"), F.least("a", "low").alias("comp"), "parts"))
    hubs = labels.where("parts > 1").select(F.col("node").alias("b"), "parts")
    if hubs.isEmpty():
        near = near.withColumn("part", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
        near = saved(near.join(hubs, "b", "left").select("a", "b", part.alias("part")))
    while True:
        told = labels.select(F.col("node").alias("b"), "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        low = near.join(told, ["b", "part"]).groupBy("a").agg(F.min("comp").alias("low"))
        step = labels.join(low, F.col("node") == F.col("a")).select("node", "parts", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = saved(step.join(jump, "comp").select("node", "parts", "was", F.least("comp", "next").alias("comp")))
        labels = moved.select("node", "comp", "parts")
        if moved.where("was != comp").isEmpty():
            return labels.drop("parts")
