"""Canonical ids: connected components of asserted ``same-as`` claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.graph import active_ties, adjacency
from claimgraph.operators.history import asserted
from claimgraph.session import materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``u > v`` edges.

    Large star links each node's greater neighbours to the least of its
    neighbourhood, small star its lesser ones. A node is reduced to a minimum before
    anything is joined back, so no neighbourhood is ever collected.
    """
    if small:
        rows = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    else:
        both = F.array(
            F.struct(F.col("u").alias("node"), F.col("v").alias("other")),
            F.struct(F.col("v").alias("node"), F.col("u").alias("other")),
        )
        rows = edges.select(F.inline(both))
    least = rows.groupBy("node").agg(F.min("other").alias("_m"))
    least = least.select("node", F.least("_m", "node").alias("m"))
    joined = rows.join(least, "node")
    if small:
        linked = joined.select(F.col("other").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("node").alias("u"), F.col("m").alias("v"))
        )
    else:
        linked = joined.where(F.col("other") > F.col("node")).select(
            F.col("other").alias("u"), F.col("m").alias("v")
        )
    return linked.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``entity_id, canonical_id`` of every linked node (``links``: ``a, b``).

    Alternating large and small stars shrink each component to a star around its
    lowest id in logarithmically many rounds; each round is written to the shared
    folder, so a lost executor costs one round.
    """
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = materialise(edges.distinct(), "edges")
    digest = None
    for _ in range(max_rounds):
        edges = materialise(_star(_star(edges, small=False), small=True), "edges")
        seen = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if digest == tuple(seen):
            nodes = edges.select(F.col("u").alias("entity_id"), F.col("v").alias("canonical_id"))
            roots = edges.select(F.col("v").alias("entity_id")).distinct()
            return nodes.unionByName(roots.withColumn("canonical_id", F.col("entity_id")))
        digest = tuple(seen)
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def canonical_ids(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_id, canonical_id`` of every entity; disputing a link splits it again."""
    same = asserted(claims).where(
        (F.col("predicate") == "same-as") & F.col("object_entity_id").isNotNull()
    )
    found = components(
        same.select(F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"))
    )
    return entities.select("entity_id").join(found, "entity_id", "left").select(
        "entity_id", F.coalesce("canonical_id", "entity_id").alias("canonical_id")
    )


def canonical_claims(claims: DataFrame, canonical: DataFrame) -> DataFrame:
    """Ties re-attributed to canonical ids; ties inside one component are dropped."""
    def side(name: str) -> DataFrame:
        return canonical.select(
            F.col("entity_id").alias(f"{name}_entity_id"), F.col("canonical_id").alias(f"_{name}")
        )

    joined = claims.join(side("subject"), "subject_entity_id", "left").join(
        side("object"), "object_entity_id", "left"
    )
    subject = F.coalesce("_subject", "subject_entity_id")
    obj = F.coalesce("_object", "object_entity_id")
    return (
        joined.withColumns({"_s": subject, "_o": obj})
        .where(F.col("_o").isNull() | (F.col("_s") != F.col("_o")))
        .drop("subject_entity_id", "object_entity_id", "_subject", "_object")
        .withColumnsRenamed({"_s": "subject_entity_id", "_o": "object_entity_id"})
    )


def canonical_network(
    claims: DataFrame, canonical: DataFrame, focus: DataFrame, threshold: float = 0.0,
    start: str | None = None, end: str | None = None, include_unscored: bool = False,
) -> DataFrame:
    """Ego networks over canonical ids; a focus stands for its whole component."""
    roots = focus.join(canonical, "entity_id").select(F.col("canonical_id").alias("entity_id"))
    ties = active_ties(
        canonical_claims(claims, canonical), threshold, start, end, include_unscored
    )
    return adjacency(ties).join(roots, "entity_id", "left_semi")


def members(canonical: DataFrame) -> DataFrame:
    """``canonical_id, entity_id`` of components with more than one member."""
    several = (
        canonical.groupBy("canonical_id").agg(F.count("*").alias("members"))
        .where(F.col("members") > 1)
    )
    return canonical.join(several, "canonical_id")
