"""Calibration of confidence against labels, and evaluation splits by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reliability(labelled: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width score bin.

    ``labelled``: ``point`` in [0, 1] and boolean ``label``; unscored rows are left out.
    """
    scored = labelled.where(F.col("point").isNotNull())
    number = F.least(F.floor(F.col("point") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(number.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("point").alias("mean_point"),
        F.avg(F.col("label").cast("double")).alias("observed"),
    )


def monotone_map(bins: DataFrame) -> DataFrame:
    """``bin, point``: observed rates pooled so that they never fall with the score.

    Pool-adjacent-violators in closed form: the greatest over lower starts of the
    least over higher ends of the pooled rate. The input is one row per bin, a number
    the caller fixed, so it is folded as one array.
    """
    rows = F.array_sort(F.collect_list(F.struct("bin", "n", (F.col("observed") * F.col("n")).alias("hits"))))
    folded = bins.agg(rows.alias("r"))
    size = F.size("r")

    def pooled(lo: Column, hi: Column) -> Column:
        part = F.slice("r", lo, hi - lo + 1)
        hits = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["hits"])
        n = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x["n"])
        return hits / n

    def best(k: Column) -> Column:
        ends = F.sequence(k, size)
        return F.array_max(
            F.transform(
                F.sequence(F.lit(1), k),
                lambda lo: F.array_min(F.transform(ends, lambda hi: pooled(lo, hi))),
            )
        )

    mapped = F.transform(
        F.sequence(F.lit(1), size),
        lambda k: F.struct(F.element_at("r", k)["bin"].alias("bin"), best(k).alias("point")),
    )
    return folded.where(size > 0).select(F.inline(mapped))


def calibrate(claims: DataFrame, mapping: DataFrame, run_id: str, bins: int = 10) -> DataFrame:
    """``claim_id, point, run_id`` of every scored claim whose bin is mapped."""
    number = F.least(F.floor(F.col("confidence_point") * bins), F.lit(bins - 1)).cast("int")
    return (
        claims.where(F.col("confidence_point").isNotNull())
        .select("claim_id", number.alias("bin"))
        .join(mapping, "bin")
        .select("claim_id", "point", F.lit(run_id).alias("run_id"))
    )


def activate(runs: DataFrame, run_id: str) -> DataFrame:
    """Mark exactly one calibration run as active, or none when it is unknown."""
    return runs.withColumn("is_active", F.col("run_id") == run_id)


def active_calibration(calibration: DataFrame, runs: DataFrame) -> DataFrame:
    """Calibrated points of the active run."""
    return calibration.join(runs.where(F.col("is_active")), "run_id", "left_semi")


def forward_folds(df: DataFrame, date: str, cuts: list[str]) -> DataFrame:
    """Train and test rows of every forward-chaining fold; rows are never shuffled.

    Fold i tests on dates in [cut i, cut i+1) and trains on all earlier ones, so a
    row appears in as many folds as there are cuts after its date.
    """
    day = F.col(date)
    rows = []
    for i, cut in enumerate(cuts):
        start = F.lit(cut).cast("date")
        in_test = day >= start
        if i + 1 < len(cuts):
            in_test = in_test & (day < F.lit(cuts[i + 1]).cast("date"))
        rows.append(
            F.when(day < start, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("part")))
            .when(in_test, F.struct(F.lit(i).alias("fold"), F.lit("test").alias("part")))
        )
    parts = F.array_compact(F.array(*rows))
    return df.withColumn("_f", F.explode(parts)).select(*df.columns, "_f.fold", "_f.part")
