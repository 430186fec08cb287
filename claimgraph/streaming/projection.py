"""Streams over the event log and the change feed.

The append-only tables are the feed, the stream checkpoint remembers what was read,
and every batch recomputes its entities from the tables, so a batch delivered twice
changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimgraph.operators.history import fold_accumulators, status_of_fold
from claimgraph.operators.models import claims_of, rebuild_entity_summary, touched_entities
from claimgraph.sources.runs import RunLog


def read_feed(
    spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, name_filter: str | None = None
) -> DataFrame:
    """A growing parquet folder as a stream."""
    reader = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", name_filter or "*.parquet")
    )
    return reader.parquet(path)


def _publisher(target: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Commit a batch to the log at ``target``, once.

    A run is named by the query, whose id its checkpoint holds, and the batch. So a batch delivered again is known
    by its name, and a query with a new checkpoint, whose batches count from 0 anew, writes newer versions all the same:
    versions are numbered by the commit.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]
        RunLog(spark, target).publish(
            f"{query}-{batch_id}", lambda at: {"rows": batch.withColumn("version", F.lit(at + 1))}
        )

    return write


def latest_versions(spark: SparkSession, target: str, key: str, at: int | None = None) -> DataFrame:
    """The newest row per key over all batches committed so far."""
    return _newest(RunLog(spark, target).table("rows", at), key).drop("version")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_v")).select(key, "_v.*")


def compact_versions(spark: SparkSession, target: str, key: str) -> None:
    """Keep the newest row per key alone; what readers get stays the same, and they read less for it."""
    log = RunLog(spark, target)
    log.publish(
        f"compact-{log.head()}", lambda at: {"rows": _newest(log.table("rows", at), key)}, replaces=("rows",)
    )


def stream_status(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Fold *accepted* events into statuses, writing the claims each batch changed.

    The state per claim is four maxima. Order comes from (time, id), so late events
    need no watermark.
    """
    folded = (
        events.groupBy("claim_id")
        .agg(*[c.alias(n) for n, c in fold_accumulators().items()])
        .select("claim_id", status_of_fold().alias("status"))
    )
    return (
        folded.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_publisher(target, checkpoint))
        .start()
    )


def start_projection(
    changes: DataFrame,
    entities: Callable[[], DataFrame],
    claims: Callable[[], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Recompute the summary of every entity a change batch touches.

    ``entities`` and ``claims`` are called per batch and must read the tables afresh.
    ``AvailableNow`` drains all pending changes and stops.
    """
    write = _publisher(target, checkpoint)

    def project(batch: DataFrame, batch_id: int) -> None:
        current = claims()
        touched = touched_entities(batch, current).persist()
        try:
            fresh = rebuild_entity_summary(
                entities().join(touched, "entity_id", "left_semi"), claims_of(current, touched)
            )
            write(fresh, batch_id)
        finally:
            touched.unpersist()

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(project)
        .start()
    )


def feed_lag(changes: DataFrame, processed: DataFrame, now) -> DataFrame:
    """Changes not yet projected, and the age in seconds of the oldest.

    ``processed``: ``change_id`` of projected changes.
    """
    pending = changes.join(processed, "change_id", "left_anti")
    age = F.timestamp_diff("SECOND", F.min("changed_at"), now)
    return pending.agg(F.count("*").alias("pending"), age.alias("oldest_age_seconds"))
