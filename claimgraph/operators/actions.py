"""Governed actions in bulk: a frame of actions in, accepted events and refusals out.

``actions``: ``seq`` (unique, the order they arrive in), ``kind``, ``claim_id``,
``ground``, ``reason``, ``point``, ``agent_id``, ``occurred_at``, ``as_of``.

Within a batch an action sees the effect of the earlier ones. That needs no replay:
a superseded claim stays superseded, so only the first supersede counts, and before
it a claim stands disputed exactly when the last accepted dispute or undispute is a
dispute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.ordered import carry_before, sequence_bucket
from claimgraph.schema import DISPUTE_GROUNDS
from claimgraph.session import materialise


def refuse_time_travel(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions on the present, and refusals of those aimed at a past state."""
    past = F.col("as_of").isNotNull()
    refused = actions.where(past).select(
        "seq", "kind", "claim_id", F.lit("writes to a past state are refused").alias("refusal")
    )
    return actions.where(~past), refused


def judge(actions: DataFrame, status: DataFrame) -> DataFrame:
    """Add ``refusal`` (NULL when accepted) and ``routed`` (identity disputes).

    ``status``: ``claim_id, status`` of every existing claim.
    """
    known = actions.join(
        status.select("claim_id", F.col("status").alias("_status")), "claim_id", "left"
    )
    kind, ground = F.col("kind"), F.col("ground")
    named = F.coalesce(ground.isin(*DISPUTE_GROUNDS), F.lit(False))
    swings = F.when(
        ((kind == "dispute") & named & (ground != "identity")) | (kind == "undispute"), kind
    )
    ends = F.when(kind == "supersede", F.lit(True))
    seen = carry_before(
        known, ["claim_id"], sequence_bucket("seq"), ["seq"], {"_swing": swings, "_ended": ends}
    )
    superseded = (F.col("_status") == "superseded") | F.coalesce("_ended", F.lit(False))
    disputed = F.coalesce(F.col("_swing") == "dispute", F.col("_status") == "disputed")
    point = F.col("point")
    refusal = (
        F.when(F.col("_status").isNull(), F.lit("no such claim"))
        .when((kind == "dispute") & ~named, F.lit("unknown ground"))
        .when((kind == "dispute") & superseded, F.lit("claim is superseded"))
        .when((kind == "undispute") & (superseded | ~disputed), F.lit("claim is not disputed"))
        .when((kind == "adjust_confidence") & point.isNull(), F.lit("a numeric point is needed"))
        .when(
            (kind == "adjust_confidence") & ~point.between(0, 1), F.lit("point is outside [0, 1]")
        )
        .when((kind == "supersede") & superseded, F.lit("claim is superseded"))
        .when(
            ~kind.isin("dispute", "undispute", "adjust_confidence", "supersede"),
            F.lit("unknown action"),
        )
    )
    routed = refusal.isNull() & (kind == "dispute") & (ground == "identity")
    return seen.withColumns({"refusal": refusal, "routed": routed}).drop(
        "_status", "_swing", "_ended"
    )


def _payload() -> Column:
    reason = F.coalesce("reason", F.lit(""))
    kind = F.col("kind")
    return (
        F.when(kind == "dispute", F.to_json(F.struct("ground", reason.alias("reason"))))
        .when(kind == "adjust_confidence", F.to_json(F.struct("point", reason.alias("reason"))))
        .when(kind == "supersede", F.to_json(F.struct(reason.alias("reason"))))
        .otherwise(F.lit("{}"))
    )


def event_id(run_id: str) -> Column:
    """Ids name their writer, so those of two runs, or of an import, never meet."""
    return F.concat_ws("-", F.lit("action"), F.lit(run_id), "seq")


def accepted_events(judged: DataFrame, run_id: str = "run") -> DataFrame:
    """Events of accepted actions; a routed dispute leaves none."""
    return judged.where(F.col("refusal").isNull() & ~F.col("routed")).select(
        event_id(run_id).alias("id"),
        "claim_id",
        F.col("kind").alias("event_type"),
        "occurred_at",
        F.col("agent_id").alias("actor_agent_id"),
        _payload().alias("payload"),
    )


def refusals(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("refusal").isNotNull()).select("seq", "kind", "claim_id", "refusal")


def _of_kind(judged: DataFrame, kind: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    rows = judged.where(F.col("kind") == kind)
    return accepted_events(rows, run_id), refusals(rows)


def dispute(judged: DataFrame, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    return _of_kind(judged, "dispute", run_id)


def undispute(judged: DataFrame, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    return _of_kind(judged, "undispute", run_id)


def adjust_confidence(judged: DataFrame, run_id: str = "run") -> tuple[DataFrame, DataFrame]:
    return _of_kind(judged, "adjust_confidence", run_id)


def supersede(
    judged: DataFrame, replacements: DataFrame, run_id: str = "run"
) -> tuple[DataFrame, DataFrame]:
    """Supersede events that name the claim taking over.

    ``replacements``: ``seq, new_claim_id`` of the imported replacement claims. An
    action without one is refused.
    """
    rows = judged.where(F.col("kind") == "supersede").join(replacements, "seq", "left")
    missing = F.col("refusal").isNull() & F.col("new_claim_id").isNull()
    rows = rows.withColumn(
        "refusal", F.when(missing, F.lit("replacement is not valid")).otherwise(F.col("refusal"))
    )
    payload = F.to_json(
        F.struct(
            F.col("new_claim_id").alias("supersededBy"),
            F.coalesce("reason", F.lit("")).alias("reason"),
        )
    )
    events = rows.where(F.col("refusal").isNull()).select(
        event_id(run_id).alias("id"),
        "claim_id",
        F.lit("supersede").alias("event_type"),
        "occurred_at",
        F.col("agent_id").alias("actor_agent_id"),
        payload.alias("payload"),
    )
    return events, refusals(rows)


def route_identity(
    judged: DataFrame, claims: DataFrame, queue: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The review queue after identity disputes, and refusals on literal claims.

    ``queue``: ``entity_a, entity_b, score, features, state``, one row per pair. A
    pair disputed again keeps its score and state and takes the latest features.
    """
    ends = claims.select("claim_id", "subject_entity_id", "object_entity_id")
    # Written once for the queue and the refusals, so a batch is judged once and the few routed rows go on alone.
    routed = materialise(judged.where(F.col("routed")).select("seq", "kind", "claim_id", "reason"), "routed")
    rows = routed.join(ends, "claim_id")
    literal = F.col("object_entity_id").isNull()
    refused = rows.where(literal).select(
        "seq", "kind", "claim_id",
        F.lit("identity ground applies to relationship claims").alias("refusal"),
    )
    features = F.to_json(
        F.struct(
            F.coalesce("reason", F.lit("")).alias("reason"),
            F.col("claim_id").alias("sourceClaim"),
            F.lit("dispute").alias("routedFrom"),
        )
    )
    pair = ["entity_a", "entity_b"]
    latest = (
        rows.where(~literal)
        .select(
            F.least("subject_entity_id", "object_entity_id").alias("entity_a"),
            F.greatest("subject_entity_id", "object_entity_id").alias("entity_b"),
            features.alias("_features"),
            "seq",
        )
        .groupBy(*pair)
        .agg(F.max_by("_features", "seq").alias("_features"))
    )
    merged = queue.join(latest, pair, "full").select(
        *pair,
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("_features", "features").alias("features"),
        F.coalesce("state", F.lit("queued")).alias("state"),
    )
    return merged, refused


def merge_entities(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity_id, canonical_id`` per accepted group member, and refused groups.

    ``groups``: ``group_id, entity_id``, one row per member; the canonical id is the
    lowest of the group. A group needs two members.
    """
    lowest = groups.groupBy("group_id").agg(
        F.min("entity_id").alias("canonical_id"), F.count("*").alias("members")
    )
    fit = lowest.where(F.col("members") >= 2).drop("members")
    accepted = groups.join(fit, "group_id").select("group_id", "entity_id", "canonical_id")
    refused = lowest.where(F.col("members") < 2).select(
        "group_id", F.lit("a merge needs two entities").alias("refusal")
    )
    return accepted, refused


def lifespan_warning(groups: DataFrame, summary: DataFrame) -> DataFrame:
    """``group_id, warn``: somebody was born after another member had died."""
    lives = groups.join(
        summary.select("entity_id", "born_earliest", "died_latest"), "entity_id", "left"
    )
    return lives.groupBy("group_id").agg(
        F.coalesce(F.max("born_earliest") > F.min("died_latest"), F.lit(False)).alias("warn")
    )
