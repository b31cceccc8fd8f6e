"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import discard, landed


def _large(edges: DataFrame) -> DataFrame:
    """Connect every greater neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Connect a node and its lesser neighbours to the least of them. Edges point from greater to lesser."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lesser = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): the least node of the component, for nodes with an edge (u, v).

    Each round is written to the shared folder, so lineage does not grow; the
    edges become stars in a number of rounds that is logarithmic in practice.
    """
    down = lambda d: d.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = landed(down(edges), "cc")
    state = None
    for _ in range(rounds):
        before, now = now, landed(down(_small(down(_large(now)))), "cc")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
