"""Bounded path search for many pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.operators.adjacency import Adjacency, dealt, for_every_piece, hub_directory
from claimgraph.operators.graph import active_ties, adjacency
from claimgraph.session import materialise

PAIR = ["source", "target"]


def _near_target(targets: DataFrame, edges: DataFrame, hops: int) -> list[DataFrame]:
    """For 0..hops: the (target, node) from which the target is that near, or nearer."""
    links = edges.select(F.col("next").alias("node"), F.col("node").alias("prior")).distinct()
    near = [targets.withColumn("node", F.col("target"))]
    for _ in range(hops):
        step = near[-1].join(links, "node").select("target", F.col("prior").alias("node"))
        near.append(materialise(step.unionByName(near[-1]).distinct(), "near"))
    return near


def find_paths(
    claims: DataFrame | Adjacency,
    pairs: DataFrame,
    threshold: float = 0.0,
    start: str | None = None,
    end: str | None = None,
    max_depth: int = 4,
    max_paths: int = 3,
) -> DataFrame:
    """Up to ``max_paths`` paths per (``source``, ``target``) over scored ties.

    Breadth first: an entity is entered once per pair, on the path with the
    strongest weakest link (then the lowest claim ids), the target is never passed
    through, and parallel claims into the target give parallel paths. Paths rank by
    hops, weakest link, claim ids. An entity too far from the target to still reach
    it is left out, which changes no answer.

    ``claims`` may be a published adjacency, whose buckets are then read as they lie. The ties of a hub are met in
    pieces either way.
    """
    if max_depth < 1 or max_paths < 1:
        raise ValueError("max_depth and max_paths are at least 1")
    pairs = pairs.select(*PAIR).distinct()
    if isinstance(claims, Adjacency):
        edges, hubs = claims.edges(threshold, start, end), claims.hubs.withColumnRenamed("entity_id", "node")
    else:
        edges = adjacency(active_ties(claims, threshold, start, end)).select(
            F.col("entity_id").alias("node"), F.col("counterpart_id").alias("next"), "claim_id", "confidence_point"
        )
        # Read at every level and by the near sets, so derived once.
        edges = materialise(edges, "edges")
        hubs = materialise(hub_directory(edges, "node"), "hubs")
        edges = dealt(edges, hubs, "node", "claim_id")
    near = _near_target(pairs.select("target").distinct(), edges, min(2, max_depth - 1))

    frontier = pairs.select(
        *PAIR,
        F.col("source").alias("node"),
        F.lit(1.0).alias("weakest"),
        F.array().cast(f"array<{dict(edges.dtypes)['claim_id']}>").alias("claim_ids"),
        F.array().cast(f"array<{dict(edges.dtypes)['next']}>").alias("entity_ids"),
        F.array().cast("array<double>").alias("confidences"),
    )
    visited = frontier.select(*PAIR, "node")
    found = []
    for depth in range(1, max_depth + 1):
        last = depth == max_depth
        ahead = for_every_piece(frontier, hubs, "node")
        on = [ahead["node"] == edges["node"], ahead["piece"] == edges["piece"]]
        if last:
            on.append(ahead["target"] == edges["next"])
        step = ahead.join(edges, on).select(
            *PAIR,
            F.col("next").alias("node"),
            F.least("weakest", "confidence_point").alias("weakest"),
            F.concat("claim_ids", F.array("claim_id")).alias("claim_ids"),
            F.concat("entity_ids", F.array("next")).alias("entity_ids"),
            F.concat("confidences", F.array("confidence_point")).alias("confidences"),
        )
        found.append(step.where(F.col("node") == F.col("target")).withColumn("hops", F.lit(depth)))
        if last:
            break
        ahead = step.where(F.col("node") != F.col("target"))
        remaining = max_depth - depth
        if remaining < len(near):
            ahead = ahead.join(near[remaining], ["target", "node"], "left_semi")
        entered = (
            ahead.join(visited, [*PAIR, "node"], "left_anti")
            .groupBy(*PAIR, "node")
            .agg(
                F.min(
                    F.struct(
                        (-F.col("weakest")).alias("rank"),
                        "claim_ids",
                        "entity_ids",
                        "confidences",
                    )
                ).alias("_best")
            )
            .select(
                *PAIR,
                "node",
                (-F.col("_best.rank")).alias("weakest"),
                "_best.claim_ids",
                "_best.entity_ids",
                "_best.confidences",
            )
        )
        frontier = materialise(entered, f"frontier{depth}")
        visited = visited.unionByName(frontier.select(*PAIR, "node"))

    paths = found[0]
    for more in found[1:]:
        paths = paths.unionByName(more)
    best = Window.partitionBy(*PAIR).orderBy("hops", F.desc("weakest"), "claim_ids")
    ranked = paths.drop("node").withColumn("path_rank", F.row_number().over(best)).where(
        F.col("path_rank") <= max_paths
    )
    full = F.max("path_rank").over(Window.partitionBy(*PAIR)) >= max_paths
    return ranked.withColumn("truncated", full)


def path_steps(paths: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per step, position 0 being the source, with display names."""
    step = F.arrays_zip("entity_ids", "claim_ids", "confidences")
    steps = paths.select(*PAIR, "path_rank", F.posexplode(step).alias("_i", "_s")).select(
        *PAIR,
        "path_rank",
        (F.col("_i") + 1).alias("position"),
        F.col("_s.entity_ids").alias("entity_id"),
        F.col("_s.claim_ids").alias("claim_id"),
        F.col("_s.confidences").alias("confidence_point"),
    )
    origin = paths.select(
        *PAIR,
        "path_rank",
        F.lit(0).alias("position"),
        F.col("source").alias("entity_id"),
        F.lit(None).cast(steps.schema["claim_id"].dataType).alias("claim_id"),
        F.lit(None).cast("double").alias("confidence_point"),
    )
    names = summary.select("entity_id", "display_name")
    fallback = F.concat(F.lit("#"), F.col("entity_id").cast("string"))
    return (
        origin.unionByName(steps)
        .join(names, "entity_id", "left")
        .withColumn("display_name", F.coalesce("display_name", fallback))
    )
