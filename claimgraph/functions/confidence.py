"""Confidence as column expressions. Unscored is absence: NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimgraph.schema import BAND_EDGES


def confidence_band(point: Column) -> Column:
    expr = F.when(point.isNull(), F.lit("unscored"))
    for edge, name in BAND_EDGES:
        expr = expr.when(point >= F.lit(edge), F.lit(name))
    return expr.otherwise(F.lit("very_weak"))


def effective_confidence(manual: Column, calibrated: Column, run_id: Column, source: Column) -> Column:
    """``struct<point, origin, calibration_run_id>``: manual, then calibration, then source."""
    return F.struct(
        F.coalesce(manual, calibrated, source).alias("point"),
        F.when(manual.isNotNull(), F.lit("manual"))
        .when(calibrated.isNotNull(), F.lit("calibration"))
        .when(source.isNotNull(), F.lit("source"))
        .otherwise(F.lit("unscored"))
        .alias("origin"),
        F.when(manual.isNull() & calibrated.isNotNull(), run_id).alias("calibration_run_id"),
    )


def wire_origin(origin: Column, point: Column) -> Column:
    """Origin as shown to readers: none for unscored, ``source_native`` by default."""
    return F.when(
        point.isNotNull(),
        F.when(origin.isin("calibration", "manual", "inferred"), origin).otherwise(
            F.lit("source_native")
        ),
    )


def passes_confidence(point: Column, threshold, include_unscored: bool) -> Column:
    scored = point.isNotNull() & F.coalesce(point >= F.lit(threshold), F.lit(False))
    return (scored | point.isNull()) if include_unscored else scored


def native_confidence(raw: Column, scale: str) -> Column:
    """A 0-100 source score as the confidence struct; NULL point when not an integer."""
    score = F.trim(raw.cast("string")).try_cast("int")
    return F.struct(
        F.lit("source_native_scalar").alias("kind"),
        F.lit(scale).alias("scale"),
        score.cast("string").alias("raw"),
        (score / F.lit(100.0)).alias("point"),
        F.lit(False).alias("calibrated"),
    )


def unscored() -> Column:
    return F.struct(
        F.lit("unscored").alias("kind"),
        F.lit(None).cast("string").alias("scale"),
        F.lit(None).cast("string").alias("raw"),
        F.lit(None).cast("double").alias("point"),
        F.lit(None).cast("boolean").alias("calibrated"),
    )


def origin_label(origin: Column, calibrated: Column, raw: Column) -> Column:
    """Reader-facing origin text; ``origin`` is the wire origin."""
    return (
        F.when(origin == "source_native", F.lit("source-native (uncalibrated)"))
        .when(
            (origin == "calibration") & calibrated & raw.isNotNull(),
            F.concat(F.lit("calibrated ("), raw, F.lit(")")),
        )
        .when(origin == "calibration", F.lit("calibrated"))
        .when(origin == "manual", F.lit("manual override"))
        .when(origin == "inferred", F.lit("inferred (algorithm)"))
        .otherwise(F.lit("origin unrecorded"))
    )


def confidence_text(point: Column, origin: Column, calibrated: Column, raw: Column) -> Column:
    """Number, band and origin together; an unscored claim shows no number."""
    label = origin_label(origin, calibrated, raw)
    band = F.translate(confidence_band(point), "_", " ")
    return F.when(point.isNull(), F.concat(F.lit("unscored · "), label)).otherwise(
        F.concat_ws(" · ", F.format_string("%.2f", point), band, label)
    )
