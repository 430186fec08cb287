"""Corpus statistics. Unscored and undated are always counted as their own class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.confidence import confidence_band
from claimgraph.functions.temporal import is_undated
from claimgraph.functions.text import literal_value
from claimgraph.operators.graph import adjacency, relationships
from claimgraph.schema import BANDS, EDGE_CAP


def with_status(claims: DataFrame, status: str | None = None) -> DataFrame:
    """The declared status filter of a statistic; ``None`` counts every status."""
    return claims if status is None else claims.where(F.col("status") == status)


def _one_row_to_rows(df: DataFrame, key: str, value: str, columns: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in columns]
    return df.select(F.inline(F.array(*rows)))


def _total_and_parts(df: DataFrame, column: str) -> DataFrame:
    parts = df.groupBy(F.col(column).alias("part")).agg(F.count("*").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return parts.unionByName(total.select(F.lit("total").alias("part"), "n"))


def entity_counts(entities: DataFrame) -> DataFrame:
    return _total_and_parts(entities, "entity_type")


def claim_counts(claims: DataFrame, status: str | None = None) -> DataFrame:
    return _total_and_parts(with_status(claims, status), "predicate")


def record_counts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records per source, sources without records included."""
    counted = records.groupBy("source_id").agg(F.count("*").alias("records"))
    return sources.join(counted, "source_id", "left").select(
        F.col("slug").alias("source_slug"), F.coalesce("records", F.lit(0)).alias("records")
    )


def registries(sources: DataFrame, relation_types: DataFrame, agents: DataFrame) -> DataFrame:
    """The three registries as one listing by kind and slug."""
    def part(kind: str, df: DataFrame, label: str, detail: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("registry"), "slug", F.col(label).alias("label"),
            detail.cast("string").alias("detail"),
        )

    return (
        part("source", sources, "title", F.col("license_confirmed"))
        .unionByName(part("relation_type", relation_types, "label", F.col("range_kind")))
        .unionByName(part("agent", agents, "display_name", F.col("kind")))
        .orderBy("registry", "slug")
    )


def confidence_histogram(claims: DataFrame, status: str | None = None) -> DataFrame:
    """Ties per band, six bins, empty bins kept."""
    ties = relationships(with_status(claims, status))
    band = confidence_band(F.col("confidence_point"))
    counts = ties.agg(*[F.count_if(band == b).alias(b) for b in BANDS])
    return _one_row_to_rows(counts, "band", "ties", list(BANDS))


def anomaly_totals(runs: DataFrame) -> DataFrame:
    """Anomaly counters summed over the run manifests (``manifest``: JSON)."""
    counters = F.from_json(
        F.get_json_object("manifest", "$.anomaly_counters"), "map<string,bigint>"
    )
    return (
        runs.where(F.col("manifest").isNotNull())
        .select(F.explode(counters).alias("counter", "n"))
        .groupBy("counter")
        .agg(F.sum("n").alias("n"))
    )


def gender_split(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Gender claims by value; unknown is the persons left over, never below zero."""
    value = F.lower(F.coalesce(literal_value(F.col("object_literal")), F.lit("unknown")))
    counted = claims.where(F.col("predicate") == "has-gender").agg(
        F.count_if(value == "male").alias("male"), F.count_if(value == "female").alias("female")
    )
    persons = entities.where(F.col("entity_type") == "person").agg(F.count("*").alias("persons"))
    left = F.greatest(F.lit(0), persons.scalar() - F.col("male") - F.col("female"))
    both = counted.withColumn("unknown", left)
    return _one_row_to_rows(both, "gender", "n", ["male", "female", "unknown"])


def code_share(claims: DataFrame, status: str | None = None) -> DataFrame:
    """Ties per source date code of their start, with their share of all ties."""
    code = F.coalesce(
        F.get_json_object("valid_time_original", "$.start.type_code"),
        F.get_json_object("valid_time_original", "$.type_code"),
        F.lit("none"),
    )
    counted = (
        relationships(with_status(claims, status))
        .groupBy(code.alias("code"))
        .agg(F.count("*").alias("ties"))
    )
    total = counted.agg(F.sum("ties").alias("total"))
    return counted.select("code", "ties", (F.col("ties") / total.scalar()).alias("share"))


def no_tie_share(summary: DataFrame) -> DataFrame:
    """Percent of persons without any tie; NULL when there are no persons."""
    lonely = (F.col("degree_scored") == 0) & (F.col("degree_unscored") == 0)
    return summary.where(F.col("entity_type") == "person").agg(
        F.count("*").alias("persons"),
        F.count_if(lonely).alias("without_ties"),
        (F.lit(100.0) * F.count_if(lonely) / F.nullif(F.count("*"), F.lit(0))).alias("percent"),
    )


def threshold_share(
    claims: DataFrame, thresholds=(0.6, 0.9), status: str | None = None
) -> DataFrame:
    """Share of all ties, unscored included in the base, at or above each threshold."""
    point = F.col("confidence_point")
    counts = relationships(with_status(claims, status)).agg(
        F.count("*").alias("ties"),
        *[F.count_if(point >= F.lit(t)).alias(f"_{i}") for i, t in enumerate(thresholds)],
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_{i}").alias("at_or_above"),
            (F.col(f"_{i}") / F.nullif(F.col("ties"), F.lit(0))).alias("share"),
        )
        for i, t in enumerate(thresholds)
    ]
    return counts.select(F.inline(F.array(*rows)))


def measured_span(claims: DataFrame, slice_start: int = 1500) -> DataFrame:
    """Years the corpus spans, and births before the display slice."""
    outer_first = F.year("start_earliest")
    outer_last = F.year(F.coalesce("end_latest", "start_latest"))
    born = F.col("predicate") == "born"
    early = born & (outer_first < slice_start)
    return claims.agg(
        F.min(outer_first).alias("first_year"),
        F.max(outer_last).alias("last_year"),
        F.count_if(early).alias("births_before"),
        (F.count_if(early) / F.nullif(F.count_if(born), F.lit(0))).alias("births_before_share"),
        F.min(F.when(born, outer_first)).alias("earliest_birth"),
    )


def import_runs(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Run history, newest first, or one run."""
    rows = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    return rows.orderBy(F.desc("started_at"), "run_id")


def degree_profile(summary: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """Median and 90th percentile of degree, and entities above the edge cap."""
    degree = F.col("degree_scored") + F.col("degree_unscored")
    counted = summary.groupBy(degree.alias("degree")).agg(F.count("*").alias("entities"))
    return counted.agg(
        F.percentile("degree", 0.5, F.col("entities")).alias("median"),
        F.percentile("degree", 0.9, F.col("entities")).alias("p90"),
        F.coalesce(F.sum(F.when(F.col("degree") > cap, F.col("entities"))), F.lit(0)).alias(
            "over_cap"
        ),
    )


def empty_ego_share(entities: DataFrame, claims: DataFrame, thresholds=(0.6, 0.9)) -> DataFrame:
    """Share of entities with no asserted tie at or above each threshold.

    Only the strongest tie of an entity matters, so one aggregate serves all
    thresholds.
    """
    ties = relationships(with_status(claims, "asserted")).select(
        "subject_entity_id", "object_entity_id", "confidence_point"
    )
    strongest = adjacency(ties).groupBy("entity_id").agg(F.max("confidence_point").alias("best"))
    best = F.col("best")
    counts = entities.join(strongest, "entity_id", "left").agg(
        F.count("*").alias("entities"),
        *[
            F.count_if(best.isNull() | (best < F.lit(t))).alias(f"_{i}")
            for i, t in enumerate(thresholds)
        ],
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_{i}").alias("empty"),
            (F.col(f"_{i}") / F.nullif(F.col("entities"), F.lit(0))).alias("share"),
        )
        for i, t in enumerate(thresholds)
    ]
    return counts.select(F.inline(F.array(*rows)))


def bound_profile(claims: DataFrame, status: str | None = None) -> DataFrame:
    """How complete the bounds of ties are, and how many could ever be certain."""
    start = F.coalesce("start_earliest", "start_latest").isNotNull()
    end = F.coalesce("end_earliest", "end_latest").isNotNull()
    certain = F.col("start_latest").isNotNull() & F.col("end_earliest").isNotNull()
    return relationships(with_status(claims, status)).agg(
        F.count("*").alias("ties"),
        F.count_if(start & end).alias("both_bounds"),
        F.count_if(start & ~end).alias("start_only"),
        F.count_if(certain).alias("able_to_be_certain"),
        F.count_if(is_undated()).alias("undated"),
    )


def multiplicity_profile(claims: DataFrame, status: str | None = None) -> DataFrame:
    """Pairs with more than one tie, and (subject, predicate) with more than one claim."""
    rows = with_status(claims, status)
    pairs = (
        relationships(rows)
        .groupBy(
            F.least("subject_entity_id", "object_entity_id"),
            F.greatest("subject_entity_id", "object_entity_id"),
        )
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("repeated"))
    )
    subjects = (
        rows.where(F.col("object_entity_id").isNull())
        .groupBy("subject_entity_id", "predicate")
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("n") > 1).alias("repeated"))
    )
    return pairs.select(F.lit("pair").alias("grouping"), "total", "repeated").unionByName(
        subjects.select(F.lit("subject_predicate").alias("grouping"), "total", "repeated")
    )


def both_figures(metric, claims: DataFrame, status: str = "asserted") -> DataFrame:
    """A statistic over every status and over one, side by side in rows."""
    every = metric(claims, status=None).withColumn("status_filter", F.lit("any"))
    return every.unionByName(metric(claims, status=status).withColumn("status_filter", F.lit(status)))
