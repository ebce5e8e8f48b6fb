"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import scope, settle

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long): root is its component's smallest node.

    Each round ties every node's larger neighbours to its smallest one, then
    every node's smaller neighbours to the smallest; rounds grow with the
    logarithm of the longest chain. Only aggregates and equi joins on the node
    are used, between written tables, so that a hub's rows can be split. An empty
    table gives an empty one; links of a node with itself count for nothing.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        with scope():
            edges = settle(_star_round(edges), "links", outer=True)
        state = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        mark = (state["n"], state["h"])
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("node"), "root").unionByName(
        stars.select(F.col("root").alias("node"), "root").distinct()
    )


def _star_round(edges: DataFrame) -> DataFrame:
    """One large star and one small star of (u, v) links with u > v."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("m"))
    )
    least = settle(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root")), "least")
    large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("root").alias("v"))
    own = settle(large.where("u <> v").distinct(), "large_stars")
    least = settle(own.groupBy("u").agg(F.min("v").alias("root")), "least")
    ends = F.array(
        F.struct(F.col("u"), F.col("root").alias("v")), F.struct(F.col("v").alias("u"), F.col("root").alias("v"))
    )
    small = own.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v")
    return small.where("u <> v").distinct()
