"""Ego networks, dossiers and neighbourhoods over current claims.

Every operator takes frames of ids and answers all of them in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.confidence import confidence_band, passes_confidence
from claimgraph.functions.temporal import (
    certainly_active,
    is_undated,
    possibly_active,
    window_bounds,
)
from claimgraph.operators.history import asserted
from claimgraph.schema import EDGE_CAP, ENTITY_RANGED, THRESHOLD_LADDER


def relationships(claims: DataFrame, predicates=ENTITY_RANGED) -> DataFrame:
    """Claims whose object is an entity. The test on predicates reaches the scan."""
    return claims.where(
        F.col("predicate").isin(*predicates) & F.col("object_entity_id").isNotNull()
    )


def adjacency(claims: DataFrame) -> DataFrame:
    """One row per claim and endpoint: ``entity_id`` sees ``counterpart_id``.

    Turns "subject or object is x" into an equality on ``entity_id``. A claim
    about itself, or one with a literal object, has a single endpoint.
    """
    subject, obj = F.col("subject_entity_id"), F.col("object_entity_id")
    ends = F.array_distinct(F.array_compact(F.array(subject, obj)))
    return claims.withColumn("entity_id", F.explode(ends)).withColumn(
        "counterpart_id", F.when(F.col("entity_id") == subject, obj).otherwise(subject)
    )


def active_ties(
    claims: DataFrame,
    threshold: float = 0.0,
    start: str | None = None,
    end: str | None = None,
    include_unscored: bool = False,
) -> DataFrame:
    """Asserted ties that pass the confidence filter and may be active in the window."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    w0, w1 = window_bounds(start, end)
    return (
        relationships(asserted(claims))
        .where(possibly_active(w0, w1))
        .where(passes_confidence(F.col("confidence_point"), threshold, include_unscored))
        .withColumns(
            {"certainly_active": certainly_active(w0, w1), "undated": is_undated()}
        )
    )


def ego_network(
    claims: DataFrame,
    focus: DataFrame,
    threshold: float = 0.0,
    start: str | None = None,
    end: str | None = None,
    include_unscored: bool = False,
) -> DataFrame:
    """All matching ties of every focus entity (``focus``: ``entity_id``)."""
    ties = active_ties(claims, threshold, start, end, include_unscored)
    return adjacency(ties).join(focus, "entity_id", "left_semi")


def network_counts(network: DataFrame, focus: DataFrame) -> DataFrame:
    """Counts before any cap, zero for a focus without ties.

    ``possibly`` counts every tie; ``possibly_dated`` leaves the undated ones out.
    """
    counted = network.groupBy("entity_id").agg(
        F.count("*").alias("possibly"),
        F.count_if(~F.col("undated")).alias("possibly_dated"),
        F.count_if("certainly_active").alias("certainly"),
        F.count_if("undated").alias("undated"),
    )
    names = ["possibly", "possibly_dated", "certainly", "undated"]
    return focus.select("entity_id").join(counted, "entity_id", "left").fillna(0, names)


def cap_edges(network: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """Strongest ties first, unscored last, at most ``cap`` per focus, with a flag.

    The rank filter is applied before the shuffle too, so a hub ships at most
    ``cap + 1`` rows per input partition.
    """
    if cap < 1:
        raise ValueError("cap is below 1")
    ranked = Window.partitionBy("entity_id").orderBy(
        F.col("confidence_point").desc_nulls_last(), F.col("claim_id")
    )
    kept = network.withColumn("edge_rank", F.row_number().over(ranked)).where(
        F.col("edge_rank") <= cap + 1
    )
    over = F.max("edge_rank").over(Window.partitionBy("entity_id")) > cap
    return kept.withColumn("truncated", over).where(F.col("edge_rank") <= cap)


def decorate_edges(network: DataFrame, summary: DataFrame) -> DataFrame:
    """Band, scored flag and the counterpart's summary for each edge."""
    names = summary.select(
        F.col("entity_id").alias("counterpart_id"),
        F.col("display_name").alias("counterpart_name"),
        F.col("entity_type").alias("counterpart_type"),
    )
    return network.withColumns(
        {
            "scored": F.col("confidence_point").isNotNull(),
            "band": confidence_band(F.col("confidence_point")),
        }
    ).join(names, "counterpart_id", "left")


def ranked_ties(capped: DataFrame) -> DataFrame:
    """Rank inside the scored and the unscored class of each capped network."""
    scored = F.col("confidence_point").isNotNull()
    order = Window.partitionBy("entity_id", "scored").orderBy(
        F.col("confidence_point").desc_nulls_last(), F.col("claim_id")
    )
    return capped.withColumn("scored", scored).withColumn(
        "tie_rank", F.row_number().over(order)
    )


def edges_by_threshold(claims: DataFrame, ladder=THRESHOLD_LADDER) -> DataFrame:
    """Scored ties at or above each threshold: one pass, one row per threshold."""
    point = F.col("confidence_point")
    counts = claims.agg(
        *[F.count_if(point >= F.lit(t)).alias(f"_{i}") for i, t in enumerate(ladder)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("edges"))
            for i, t in enumerate(ladder)
        ]
    )
    return counts.select(F.inline(rows))


def decade_counts(ties: DataFrame, lo: int = 1500, hi: int = 1700, step: int = 10) -> DataFrame:
    """Dated ties possibly active in each step of years, by year of the outer bounds."""
    first, last = F.year("start_earliest"), F.year("end_latest")
    dated = ties.where(~is_undated())
    starts = list(range(lo, hi, step))

    def touches(d: int):
        return (first.isNull() | (first <= d + step - 1)) & (last.isNull() | (last >= d))

    counts = dated.agg(*[F.count_if(touches(d)).alias(f"_{d}") for d in starts])
    rows = F.array(
        *[
            F.struct(
                F.lit(d).alias("decade_start"),
                F.lit(f"{d}s").alias("label"),
                F.col(f"_{d}").alias("ties"),
            )
            for d in starts
        ]
    )
    return counts.select(F.inline(rows))


def pair_dossier(claims: DataFrame, pairs: DataFrame, asserted_only: bool = False) -> DataFrame:
    """Every claim between the two entities of each pair (``a``, ``b``), either way round."""
    rows = asserted(claims) if asserted_only else claims
    rows = rows.where(F.col("object_entity_id").isNotNull()).withColumns(
        {
            "_lo": F.least("subject_entity_id", "object_entity_id"),
            "_hi": F.greatest("subject_entity_id", "object_entity_id"),
        }
    )
    keyed = pairs.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    return keyed.join(rows, ["_lo", "_hi"]).drop("_lo", "_hi")


def neighbors(
    claims: DataFrame,
    frontier: DataFrame,
    threshold: float = 0.0,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Scored, asserted ties of each frontier entity; keeps the frontier's columns."""
    edges = adjacency(active_ties(claims, threshold, start, end)).select(
        "entity_id", "counterpart_id", "claim_id", "confidence_point", "predicate"
    )
    return frontier.join(edges, "entity_id")


def blocked_sources(
    sources: DataFrame, records: DataFrame, support: DataFrame, scope: DataFrame | None = None
) -> DataFrame:
    """Sources without a confirmed licence that some claim rests on.

    ``scope`` (``claim_id``) narrows the question to those claims.
    """
    links = support if scope is None else support.join(scope, "claim_id", "left_semi")
    unconfirmed = sources.where(~F.coalesce(F.col("license_confirmed"), F.lit(False)))
    used = records.join(unconfirmed.select("source_id"), "source_id", "left_semi").join(
        links, "source_record_id", "left_semi"
    )
    return unconfirmed.join(used.select("source_id").distinct(), "source_id", "left_semi")

