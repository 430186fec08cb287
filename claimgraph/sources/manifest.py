"""Run manifests: one row per run, readable on its own and in bulk."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def manifest_row(
    spark: SparkSession,
    *,
    run_id: str,
    adapter: str,
    adapter_version: str,
    source_slug: str,
    source_version: str,
    input_content_hashes: dict[str, str],
    counts: dict[str, int],
    anomaly_counters: DataFrame,
    submission: dict | None = None,
    validation: dict | None = None,
    created_at: str | None = None,
) -> DataFrame:
    """``run_id, manifest`` with the manifest as JSON text, keys sorted.

    ``anomaly_counters`` is a frame of a handful of named totals (``counter, n``).
    """
    fields = {
        "run_id": run_id,
        "created_at": created_at or datetime.now(timezone.utc).isoformat(),
        "adapter": adapter,
        "adapter_version": adapter_version,
        "source_slug": source_slug,
        "source_version": source_version,
        "input_content_hashes": input_content_hashes,
        "counts": counts,
        "submission": submission,
        "validation": validation,
    }
    head = json.dumps(fields)
    counters = F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n"))))
    return anomaly_counters.agg(counters.alias("_c")).select(
        F.lit(run_id).alias("run_id"),
        F.to_json(
            F.parse_json(
                F.concat(F.lit(head[:-1] + ', "anomaly_counters": '), F.to_json("_c"), F.lit("}"))
            )
        ).alias("manifest"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(F.col("manifest").alias("value")).write.mode("append").text(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, source_slug, created_at, manifest`` of every manifest under a folder."""
    rows = spark.read.text(path).select(F.col("value").alias("manifest"))
    return rows.select(
        F.get_json_object("manifest", "$.run_id").alias("run_id"),
        F.get_json_object("manifest", "$.source_slug").alias("source_slug"),
        F.get_json_object("manifest", "$.created_at").cast("timestamp").alias("created_at"),
        "manifest",
    )
