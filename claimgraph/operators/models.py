"""Per-entity read models, rebuilt whole or for the touched entities only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import literal_value
from claimgraph.operators.graph import adjacency, relationships
from claimgraph.operators.history import asserted



def _value() -> Column:
    return literal_value(F.col("object_literal"))


def _name_kind() -> Column:
    return F.coalesce(F.get_json_object("method_detail", "$.name_kind"), F.lit("primary"))


def _is(predicate: str) -> Column:
    return F.col("predicate") == predicate


def _best_name() -> Column:
    """Scored before unscored, primary before other kinds, then the lowest claim."""
    named = _is("has-name") & _value().isNotNull()
    order = F.struct(F.col("confidence_point").isNull(), _name_kind() != "primary", "claim_id")
    return F.min_by(F.struct("claim_id", _value().alias("name")), F.when(named, order))


def _first(predicate: str, value: Column) -> Column:
    return F.min_by(value, F.when(_is(predicate), F.col("claim_id")))


def _by_subject(claims: DataFrame) -> DataFrame:
    return asserted(claims).withColumnRenamed("subject_entity_id", "entity_id").groupBy("entity_id")


def display_names(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_id, display_name, name_claim_id`` for every entity."""
    named = asserted(claims).where(_is("has-name"))
    best = _by_subject(named).agg(_best_name().alias("_n"))
    fallback = F.concat(F.lit("unnamed entity #"), F.col("entity_id").cast("string"))
    return entities.join(best, "entity_id", "left").select(
        "entity_id",
        F.coalesce("_n.name", fallback).alias("display_name"),
        F.col("_n.claim_id").alias("name_claim_id"),
    )


def first_literal(claims: DataFrame, predicate: str) -> DataFrame:
    """Value of the lowest asserted claim of a predicate, per subject."""
    return _by_subject(claims.where(_is(predicate))).agg(_first(predicate, _value()).alias("value"))


def life_bounds(claims: DataFrame) -> DataFrame:
    """Start bounds of the lowest asserted born and died claims, per subject."""
    bounds = F.struct("start_earliest", "start_latest")
    return (
        _by_subject(claims.where(F.col("predicate").isin("born", "died")))
        .agg(_first("born", bounds).alias("_b"), _first("died", bounds).alias("_d"))
        .select("entity_id", *_life_columns())
    )


def _life_columns() -> list[Column]:
    return [
        F.col("_b.start_earliest").alias("born_earliest"),
        F.col("_b.start_latest").alias("born_latest"),
        F.col("_d.start_earliest").alias("died_earliest"),
        F.col("_d.start_latest").alias("died_latest"),
    ]


def degrees(claims: DataFrame) -> DataFrame:
    """Scored and unscored asserted ties per entity; a tie to itself counts once."""
    ties = relationships(asserted(claims)).select(
        "subject_entity_id", "object_entity_id", "confidence_point"
    )
    return adjacency(ties).groupBy("entity_id").agg(
        F.count_if(F.col("confidence_point").isNotNull()).alias("degree_scored"),
        F.count_if(F.col("confidence_point").isNull()).alias("degree_unscored"),
    )


def rebuild_entity_summary(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """The read model of every entity, zero-filled where nothing is claimed.

    All attribute lookups share one aggregate over the subject; the degree
    aggregate and the entity frame meet it on the same key.
    """
    attributes = claims.where(
        F.col("predicate").isin("has-name", "has-description", "has-gender", "born", "died")
    )
    bounds = F.struct("start_earliest", "start_latest")
    facts = _by_subject(attributes).agg(
        _best_name().alias("_n"),
        _first("has-description", _value()).alias("description"),
        _first("has-gender", _value()).alias("gender"),
        _first("born", bounds).alias("_b"),
        _first("died", bounds).alias("_d"),
    )
    fallback = F.concat(F.lit("unnamed entity #"), F.col("entity_id").cast("string"))
    return (
        entities.join(facts, "entity_id", "left")
        .join(degrees(claims), "entity_id", "left")
        .select(
            "entity_id",
            "entity_type",
            F.coalesce("_n.name", fallback).alias("display_name"),
            F.col("_n.claim_id").alias("name_claim_id"),
            "description",
            "gender",
            *_life_columns(),
            F.coalesce("degree_scored", F.lit(0)).alias("degree_scored"),
            F.coalesce("degree_unscored", F.lit(0)).alias("degree_unscored"),
        )
    )


def rebuild_name_search(claims: DataFrame) -> DataFrame:
    """One row per asserted name claim: the surface that search reads."""
    return asserted(claims).where(_is("has-name") & _value().isNotNull()).select(
        "claim_id",
        F.col("subject_entity_id").alias("entity_id"),
        _value().alias("name"),
        _name_kind().alias("name_kind"),
    )


def touched_entities(changes: DataFrame, claims: DataFrame) -> DataFrame:
    """Entities a change batch concerns.

    ``changes``: ``aggregate`` (``claim`` or ``entity``) and ``aggregate_id``, which may be text for both.
    """
    kinds = {k: claims.schema[k].dataType for k in ("claim_id", "subject_entity_id")}
    changed_claims = changes.where(F.col("aggregate") == "claim").select(
        F.col("aggregate_id").cast(kinds["claim_id"]).alias("claim_id")
    )
    ends = (
        claims.select("claim_id", "subject_entity_id", "object_entity_id")
        .join(changed_claims, "claim_id", "left_semi")
        .select(
            F.explode(
                F.array_compact(F.array("subject_entity_id", "object_entity_id"))
            ).alias("entity_id")
        )
    )
    changed = changes.where(F.col("aggregate") == "entity").select(
        F.col("aggregate_id").cast(kinds["subject_entity_id"]).alias("entity_id")
    )
    return ends.unionByName(changed).distinct()


def claims_of(claims: DataFrame, touched: DataFrame) -> DataFrame:
    """Claims with a touched endpoint: two semi-joins, no disjunctive join."""
    by_subject = touched.select(F.col("entity_id").alias("subject_entity_id"))
    by_object = touched.select(F.col("entity_id").alias("object_entity_id"))
    mine = claims.join(by_subject, "subject_entity_id", "left_semi")
    theirs = claims.join(by_subject, "subject_entity_id", "left_anti").join(
        by_object, "object_entity_id", "left_semi"
    )
    return mine.unionByName(theirs)


def refresh_entities(
    summary: DataFrame, entities: DataFrame, claims: DataFrame, touched: DataFrame
) -> DataFrame:
    """The summary with touched entities recomputed; equals a full rebuild."""
    fresh = rebuild_entity_summary(
        entities.join(touched, "entity_id", "left_semi"), claims_of(claims, touched)
    )
    return summary.join(touched, "entity_id", "left_anti").unionByName(fresh)
