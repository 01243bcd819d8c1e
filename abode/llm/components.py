"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, label`` for each node of ``links`` (a, b): label is the least node of its component.

    Each step takes the least label among a node and its neighbours and then
    the label of that label, so the steps grow with the logarithm of a chain's
    length. Steps end when no label changes; each is a written table. Nothing
    of the graph reaches the driver but the number of changes.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")) \
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct()
    both = scratch.write(both, f"{name}-links")
    now = both.groupBy("u").agg(F.min("v").alias("m")) \
        .select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("moved"))
    now = scratch.write(now, f"{name}-0")
    step = 0
    while now.filter("moved").limit(1).count():
        of_neighbour = both.join(now.select(F.col("node").alias("v"), "label"), "v") \
            .groupBy("u").agg(F.min("label").alias("m"))
        near = now.join(of_neighbour, F.col("node") == F.col("u")) \
            .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # written, so that the next join shuffles both sides and AQE can split a label that many nodes have
        near = scratch.write(near, f"{name}-near")
        above = near.select(F.col("node").alias("up"), F.col("label").alias("top"))
        after = near.join(above, F.col("label") == F.col("up")) \
            .select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("moved"))
        step += 1
        now = scratch.write(after, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    scratch.drop(f"{name}-links")
    return now.select("node", "label")


def merged_classes(classes: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``classes`` (node, label) after the links (a, b) between labels."""
    joined = connected_components(links, scratch, name).select(F.col("node").alias("label"), F.col("label").alias("to"))
    joined = scratch.write(joined, f"{name}-to")
    return scratch.write(classes.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{name}-classes")
