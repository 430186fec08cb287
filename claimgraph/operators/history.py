"""The append-only event log and the current state folded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.confidence import effective_confidence
from claimgraph.operators.ordered import carry_before
from claimgraph.schema import EVENT_TYPES
from claimgraph.session import materialise


def _latest(kind: str) -> Column:
    return F.max(F.when(F.col("event_type") == kind, F.struct("occurred_at", "id")))


def fold_accumulators() -> dict[str, Column]:
    """The mergeable state of a fold: the last event of each status-bearing kind."""
    return {f"last_{k}": _latest(k) for k in ("assert", "dispute", "undispute", "supersede")}


def status_of_fold() -> Column:
    """Status from the four accumulators.

    Illegal disputes need no replay: a dispute counts only if no supersede stands
    between it and the last assert, and a later supersede outranks it anyway.
    """
    a, d = F.col("last_assert"), F.col("last_dispute")
    u, s = F.col("last_undispute"), F.col("last_supersede")

    def after(x: Column, y: Column) -> Column:
        return x.isNotNull() & (y.isNull() | (x > y))

    return (
        F.when(after(s, a), F.lit("superseded"))
        .when(after(d, a) & after(u, d), F.lit("asserted"))
        .when(after(d, a), F.lit("disputed"))
        .when(a.isNotNull(), F.lit("asserted"))
    )


def illegal_disputes(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Disputes raised while their claim stood superseded.

    Only claims with a dispute after their first supersede can have one, so the log is first
    cut down to those; their events are then ordered in time buckets.
    """
    kind, place = F.col("event_type"), F.struct("occurred_at", "id")
    suspects = (
        events.where(kind.isin("dispute", "supersede")).groupBy("claim_id")
        .agg(F.min(F.when(kind == "supersede", place)).alias("_ended"), F.max(F.when(kind == "dispute", place)).alias("_last"))
        .where(F.col("_ended") < F.col("_last")).select("claim_id")
    )
    suspects = materialise(suspects, "suspects")  # so that its size is known: usually few claims, and the log stays put
    moves = events.where(F.col("event_type").isin("assert", "dispute", "supersede")).join(
        suspects, "claim_id", "left_semi"
    )
    standing = F.when(F.col("event_type") != "dispute", F.col("event_type"))
    carried = carry_before(
        moves,
        ["claim_id"],
        F.date_trunc(bucket, F.col("occurred_at")),
        ["occurred_at", "id"],
        {"standing": standing},
    )
    return carried.where(
        (F.col("event_type") == "dispute") & (F.col("standing") == "supersede")
    ).drop("standing")


def fold_status(events: DataFrame) -> DataFrame:
    """``claim_id, status, error`` from the whole log, ordered by (time, id).

    ``error`` names what a strict replay would refuse: an event kind outside the
    vocabulary, a dispute of a superseded claim, or a log that sets no status.
    """
    # The fold and the search for illegal disputes read the log three times, which may be dear to derive.
    events = materialise(events.select("id", "claim_id", "event_type", "occurred_at"), "log")
    folded = events.groupBy("claim_id").agg(
        *[c.alias(n) for n, c in fold_accumulators().items()],
        F.max(~F.col("event_type").isin(*EVENT_TYPES)).alias("unknown"),
    )
    illegal = illegal_disputes(events).groupBy("claim_id").agg(F.count("*").alias("illegal"))
    return folded.join(illegal, "claim_id", "left").select(
        "claim_id",
        status_of_fold().alias("status"),
        F.when(F.col("unknown"), F.lit("unknown event type"))
        .when(F.col("illegal").isNotNull(), F.lit("dispute of a superseded claim"))
        .when(status_of_fold().isNull(), F.lit("no assert event"))
        .alias("error"),
    )


def current_status(events: DataFrame) -> DataFrame:
    """``claim_id, status`` only: one aggregate, no ordering of the log."""
    return (
        events.groupBy("claim_id")
        .agg(*[c.alias(n) for n, c in fold_accumulators().items()])
        .select("claim_id", status_of_fold().alias("status"))
    )


def fold_state(events: DataFrame) -> DataFrame:
    """``claim_id`` and what its events leave: the last of each status-bearing kind and the last manual point.

    States of parts of a log merge to the state of the whole, in any order and with overlaps.
    """
    point = F.get_json_object("payload", "$.point").try_cast("double")
    adjusted = (F.col("event_type") == "adjust_confidence") & point.isNotNull()
    manual = F.max(F.when(adjusted, F.struct("occurred_at", "id", point.alias("point"))))
    return events.groupBy("claim_id").agg(*[c.alias(n) for n, c in fold_accumulators().items()], manual.alias("last_manual"))


def merge_states(states: DataFrame) -> DataFrame:
    """One state per claim from any number of them."""
    names = [*fold_accumulators(), "last_manual"]
    return states.groupBy("claim_id").agg(*[F.max(n).alias(n) for n in names])


def read_state(states: DataFrame) -> DataFrame:
    """``claim_id, status, manual_point`` of states."""
    return states.select("claim_id", status_of_fold().alias("status"), F.col("last_manual.point").alias("manual_point"))


def manual_points(events: DataFrame) -> DataFrame:
    """The latest manual confidence of each adjusted claim."""
    point = F.get_json_object("payload", "$.point").try_cast("double")
    return (
        events.where(F.col("event_type") == "adjust_confidence")
        .withColumn("point", point)
        .where(F.col("point").isNotNull())
        .groupBy("claim_id")
        .agg(F.max_by("point", F.struct("occurred_at", "id")).alias("manual_point"))
    )


def current_confidence(
    claims: DataFrame, events: DataFrame, calibration: DataFrame | None = None
) -> DataFrame:
    """``claim_id, confidence_point, origin, calibration_run_id`` of every claim.

    ``calibration`` holds the active run only: ``claim_id, point, run_id``.
    """
    out = claims.select("claim_id", F.col("confidence_point").alias("source_point")).join(
        manual_points(events), "claim_id", "left"
    )
    if calibration is None:
        out = out.withColumns(
            {"point": F.lit(None).cast("double"), "run_id": F.lit(None).cast("string")}
        )
    else:
        out = out.join(calibration.select("claim_id", "point", "run_id"), "claim_id", "left")
    resolved = effective_confidence(
        F.col("manual_point"), F.col("point"), F.col("run_id"), F.col("source_point")
    )
    return out.withColumn("_c", resolved).select(
        "claim_id",
        F.col("_c.point").alias("confidence_point"),
        F.col("_c.origin").alias("origin"),
        F.col("_c.calibration_run_id").alias("calibration_run_id"),
    )


def current_claims(claims: DataFrame, status: DataFrame, confidence: DataFrame) -> DataFrame:
    """Claims with their current status and confidence in place.

    Every read starts here; a cluster publishes this frame once per fold, bucketed
    by ``claim_id``, instead of joining three tables per question.
    """
    return (
        claims.drop("confidence_point", "status", "origin")
        .join(status.select("claim_id", "status"), "claim_id")
        .join(confidence.select("claim_id", "confidence_point", "origin"), "claim_id", "left")
    )


def asserted(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("status") == "asserted")


def claim_history(events: DataFrame, agents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Events with their actors; ``ids`` (``claim_id``) restricts to some claims."""
    rows = events if ids is None else events.join(ids, "claim_id", "left_semi")
    actor = agents.select(
        F.col("agent_id").alias("actor_agent_id"),
        F.col("slug").alias("actor_slug"),
        F.col("kind").alias("actor_kind"),
        F.col("display_name").alias("actor_name"),
    )
    return rows.join(actor, "actor_agent_id")


def event_feed(events: DataFrame, since=None, cursor=None, limit: int = 50) -> DataFrame:
    """Newest events first, at most ``limit``; ``cursor`` is the (time, id) last seen."""
    rows = events
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(since))
    if cursor is not None:
        at, last_id = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where(
            (F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("id") < last_id))
        )
    return rows.orderBy(F.desc("occurred_at"), F.desc("id")).limit(limit)
