"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        moved.unionByName(least.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(u, v)``; the component is its smallest node.

    The steps end in a forest of stars. Each round is written to the shared folder, and the driver
    sees only a count and a checksum of it. No links give no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    stars = scratch.write(
        links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v").distinct(),
        "links",
    )
    seen = None
    for turn in range(MAX_ROUNDS):
        stars = scratch.write(_small_star(_large_star(stars)), f"stars-{turn}")
        scratch.drop("links" if turn == 0 else f"stars-{turn - 1}")
        state = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
