"""State of the graph as it was known at a moment, from the two logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.history import current_claims, current_confidence, current_status


def as_of(
    claims: DataFrame, events: DataFrame, at: Column, calibration: DataFrame | None = None
) -> DataFrame:
    """Current claims as of ``at``: claims recorded and events that occurred by then.

    Both filters reach the scans of the logs; current tables are never consulted.
    ``calibration`` must hold the run active at that moment.
    """
    known = claims.where(F.col("recorded_at") <= at)
    past = events.where(F.col("occurred_at") <= at)
    return current_claims(
        known, current_status(past), current_confidence(known, past, calibration)
    )
