"""Person and relationship rows to interchange entities and claims.

Rows are all text. Each person row is read once: its claims are built as one array
of structs and spread, not as a union of passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.confidence import native_confidence, unscored
from claimgraph.functions.temporal import clean_code, coded_point, interpret_endpoint, inverted, parse_year
from claimgraph.functions.text import normalize_name
from claimgraph.functions.wire import json_object, member
from claimgraph.operators.ordered import once
from claimgraph.schema import (
    BOUNDS,
    INTERCHANGE_CLAIM,
    INTERCHANGE_ENTITY,
    LITERAL,
    REF,
    SCHEMA_VERSION,
    VALID_TIME,
)

ABSENT_IDS = ("", "0")


@dataclass(frozen=True)
class PeopleSource:
    """Names under which a people source is recorded."""

    authority: str = "sdfb"
    slug: str = "sdfb-2017-10-13"
    scale: str = "sdfb_max_certainty_0_100"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _null(dtype) -> Column:
    return F.lit(None).cast(dtype)


def entity_ref(authority: str, key: Column) -> Column:
    return F.struct(F.lit(authority).alias("authority"), key.alias("id")).cast(REF)


def literal(kind: str, value: Column, authority: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        value.cast("string").alias("value"),
        F.lit(authority).cast("string").alias("authority"),
    ).cast(LITERAL)


def claim_struct(
    subject: Column,
    predicate: str,
    support: Column,
    *,
    entity: Column | None = None,
    value: Column | None = None,
    valid_time: Column | None = None,
    confidence: Column | None = None,
    method_detail: Column | None = None,
) -> Column:
    """An interchange claim as one struct column."""
    return F.struct(
        F.lit(SCHEMA_VERSION),
        subject,
        F.lit(predicate),
        _null(REF) if entity is None else entity,
        _null(LITERAL) if value is None else value,
        _null(VALID_TIME) if valid_time is None else valid_time.cast(VALID_TIME),
        unscored() if confidence is None else confidence,
        F.lit("imported"),
        _null("string") if method_detail is None else method_detail,
        F.lit("pipeline"),
        support,
    ).cast(INTERCHANGE_CLAIM)


def row_support(df: DataFrame, source: PeopleSource, kind: str, key: Column) -> Column:
    """The verbatim source row as the claim's only supporting record."""
    columns = sorted(c for c in df.columns if c != "record_kind")
    raw = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.array(
        F.struct(
            F.lit(source.slug).alias("source"),
            F.lit(kind).alias("record_kind"),
            key.alias("external_id"),
            F.concat(F.lit("sha256:"), F.sha2(raw, 256)).alias("content_hash"),
            raw.alias("raw"),
        )
    )


def people_entities(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    """One entity record per person row, anchored on its own id."""
    ref = entity_ref(source.authority, _text("id"))
    record = F.struct(F.lit(SCHEMA_VERSION), ref, F.lit("person"), F.array(ref))
    return people.select(F.inline(F.array(record.cast(INTERCHANGE_ENTITY))))


def _prepared(people: DataFrame, source: PeopleSource) -> DataFrame:
    key = _text("id")
    return people.withColumns(
        {
            "_support": row_support(people, source, "person", key),
            "_subject": entity_ref(source.authority, key),
        }
    )


def _primary() -> Column:
    return normalize_name(F.col("display_name"))


def _name(value: Column, kind: str) -> Column:
    return claim_struct(
        F.col("_subject"), "has-name", F.col("_support"), value=literal("string", value),
        method_detail=F.lit(f'{{"name_kind":"{kind}"}}'),
    )


def _primary_names() -> Column:
    return F.array(F.when(_primary() != "", _name(_primary(), "primary")))


def aliases() -> Column:
    """Alternate names in first-seen order: no blanks, no repeats, not the primary."""
    parts = F.transform(
        F.split(F.coalesce(F.col("search_names_all"), F.lit("")), r"\|"), normalize_name
    )
    return F.array_distinct(F.filter(parts, lambda n: (n != "") & (n != _primary())))


def _alias_names() -> Column:
    return F.transform(aliases(), lambda n: _name(n, "alias"))


def _life_date(predicate: str, year_name: str, type_name: str) -> Column:
    year = parse_year(F.col(year_name))["year"]
    code = clean_code(F.col(type_name))
    point = interpret_endpoint(code, year)
    original = json_object(member("type_code", code), member("year", year.cast("string")))
    none = _null("date")
    valid_time = F.struct(
        point["earliest"], point["latest"], none, none, point["approximate"], original,
        F.lit("start"),
    )
    claim = claim_struct(
        F.col("_subject"), predicate, F.col("_support"), value=literal("year", year),
        valid_time=valid_time,
    )
    return F.when(year.isNotNull(), claim)


def _life_dates() -> Column:
    return F.array(
        _life_date("born", "birth_year", "birth_type"),
        _life_date("died", "death_year", "death_type"),
    )


def _plain(predicate: str, kind: str, column: str) -> Column:
    value = _text(column)
    claim = claim_struct(
        F.col("_subject"), predicate, F.col("_support"), value=literal(kind, value)
    )
    return F.array(F.when(value != "", claim))


def _external_ids() -> Column:
    value = _text("odnb_id")
    claim = claim_struct(
        F.col("_subject"), "has-external-id", F.col("_support"),
        value=literal("external-id", value, "odnb"),
    )
    return F.array(F.when(~value.isin(*ABSENT_IDS), claim))


def _emit(people: DataFrame, source: PeopleSource, *parts: Column) -> DataFrame:
    rows = F.array_compact(F.concat(*parts))
    return _prepared(people, source).select(F.inline(rows))


def primary_names(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _primary_names())


def alias_names(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _alias_names())


def life_dates(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _life_dates())


def gender_claims(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _plain("has-gender", "gender", "gender"))


def description_claims(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _plain("has-description", "string", "description"))


def external_id_claims(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    return _emit(people, source, _external_ids())


def person_claims(people: DataFrame, source: PeopleSource = PeopleSource()) -> DataFrame:
    """All claims of every person row in one pass."""
    return _emit(
        people,
        source,
        _primary_names(),
        _alias_names(),
        _life_dates(),
        _plain("has-gender", "gender", "gender"),
        _plain("has-description", "string", "description"),
        _external_ids(),
    )


def _known(people: DataFrame, name: str) -> DataFrame:
    return people.select(_text("id").alias(name))


def _with_endpoints(rels: DataFrame) -> DataFrame:
    return rels.withColumns({"_p1": _text("person1_id"), "_p2": _text("person2_id")})


def drop_dangling(rels: DataFrame, people: DataFrame) -> DataFrame:
    """Relationship rows whose two ends are both known people."""
    return (
        _with_endpoints(rels)
        .join(_known(people, "_p1"), "_p1", "left_semi")
        .join(_known(people, "_p2"), "_p2", "left_semi")
        .select(*rels.columns)
    )


def dangling(rels: DataFrame, people: DataFrame) -> DataFrame:
    """The rows :func:`drop_dangling` leaves out."""
    keyed = _with_endpoints(rels)
    first = keyed.join(_known(people, "_p1"), "_p1", "left_anti")
    second = keyed.join(_known(people, "_p1"), "_p1", "left_semi").join(
        _known(people, "_p2"), "_p2", "left_anti"
    )
    return first.select(*rels.columns).unionByName(second.select(*rels.columns))


def canonical_pair(p1: Column, p2: Column) -> Column:
    """``struct<a, b>`` in numeric order when both are integers, else in text order."""
    n1, n2 = p1.try_cast("decimal(38,0)"), p2.try_cast("decimal(38,0)")
    whole = p1.rlike(r"^[+-]?\d+$") & p2.rlike(r"^[+-]?\d+$")
    keep = F.when(whole, n1 <= n2).otherwise(p1 <= p2)
    return F.struct(
        F.when(keep, p1).otherwise(p2).alias("a"), F.when(keep, p2).otherwise(p1).alias("b")
    )


def duplicate_pairs(rels: DataFrame) -> DataFrame:
    """Pairs listed more than once, with the number of repeats after the first."""
    pair = canonical_pair(_text("person1_id"), _text("person2_id"))
    return (
        rels.select(pair.alias("_p"))
        .groupBy(F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
        .agg((F.count("*") - 1).alias("repeats"))
        .where(F.col("repeats") > 0)
    )


def _endpoints(rels: DataFrame) -> DataFrame:
    """Bounds and native form. Years, codes and bounds are each read many times, so each is worked out once a row."""
    read = {}
    for side in ("start", "end"):
        code = clean_code(F.col(f"{side}_type"))
        read |= {f"_{side}_year": parse_year(F.col(f"{side}_year"))["year"], f"_{side}_code": code, f"_{side}_key": F.upper(code)}

    def point(side: str) -> Column:
        return coded_point(F.col(f"_{side}_key"), F.col(f"_{side}_year"))

    def native(side: str) -> Column:
        year = F.col(f"_{side}_year")
        return F.when(year.isNotNull(), F.struct(F.col(f"_{side}_code").alias("type_code"), year.cast("string").alias("year")))

    points = once(once(rels, **read), _start=point("start"), _end=point("end"))
    start, end = F.col("_start"), F.col("_end")
    made = {
        BOUNDS[0]: start["earliest"],
        BOUNDS[1]: start["latest"],
        BOUNDS[2]: end["earliest"],
        BOUNDS[3]: end["latest"],
        "approximate": start["approximate"] | end["approximate"],
        "original": F.to_json(F.struct(native("end").alias("end"), native("start").alias("start"))),
    }
    return points.withColumns(made).select(*rels.columns, *made)


def build_interval(rels: DataFrame) -> DataFrame:
    """Add the four bounds, ``approximate`` and the native encoding of both ends."""
    return _endpoints(rels)


def drop_inverted(intervals: DataFrame) -> DataFrame:
    """Null all four bounds where they contradict each other; the native form stays."""
    return intervals.withColumn("_bad", inverted()).withColumns(
        {b: F.when(~F.col("_bad"), F.col(b)) for b in BOUNDS}
        | {
            "approximate": F.when(~F.col("_bad"), F.col("approximate")),
            "inverted": F.col("_bad"),
        }
    ).drop("_bad")


def relationship_claims(
    rels: DataFrame, people: DataFrame, source: PeopleSource = PeopleSource()
) -> DataFrame:
    """``associated-with`` claims; repeats are kept, dangling rows and bad scores are not."""
    p1, p2 = _text("person1_id"), _text("person2_id")
    own = F.coalesce(F.col("id").cast("string"), F.lit(""))
    key = F.when(own == "", F.concat(p1, F.lit("-"), p2)).otherwise(F.trim(own))
    kept = drop_dangling(rels, people)
    # Text and hash of a row cost far more than moving it, and a source file may be a single split.
    kept = kept.repartition(int(rels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    supported = kept.withColumns(
        {
            "_support": row_support(rels, source, "relationship", key),
            "_pair": canonical_pair(p1, p2),
            "_confidence": native_confidence(F.col("max_certainty"), source.scale),
        }
    ).where(F.col("_confidence.point").isNotNull())
    timed = drop_inverted(build_interval(supported))
    valid_time = F.struct(
        *BOUNDS,
        "approximate",
        "original",
        F.when(F.col("inverted"), F.lit("none")).otherwise(F.lit("both")),
    )
    claim = claim_struct(
        entity_ref(source.authority, F.col("_pair.a")),
        "associated-with",
        F.col("_support"),
        entity=entity_ref(source.authority, F.col("_pair.b")),
        valid_time=valid_time,
        confidence=F.col("_confidence"),
    )
    return timed.select(F.inline(F.array(claim)))


def anomaly_counters(people: DataFrame, rels: DataFrame) -> DataFrame:
    """``counter, n`` for the five anomalies that are counted, never repaired, and rows set aside for their score."""
    kept = drop_dangling(rels, people)

    def bad(name: str) -> Column:
        return F.count_if(parse_year(F.col(name))["bad"])

    of_people = people.agg(
        F.count_if(_text("odnb_id").isin(*ABSENT_IDS)).alias("odnb_zero_sentinel"),
        (bad("birth_year") + bad("death_year")).alias("bad_year_value"),
    )
    of_rels = _endpoints(kept).agg(
        F.count_if(inverted()).alias("valid_time_inverted_dropped_bounds"),
        (bad("start_year") + bad("end_year")).alias("bad_year_value"),
        F.count("*").alias("_kept"),
        F.count_if(native_confidence(F.col("max_certainty"), "")["point"].isNull()).alias("bad_score_set_aside"),
    )
    repeats = duplicate_pairs(kept).agg(
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_pair_kept")
    )
    listed = rels.agg(F.count("*").alias("_listed"))
    names = [
        "odnb_zero_sentinel",
        "relationship_dangling_endpoint_skipped",
        "valid_time_inverted_dropped_bounds",
        "bad_year_value",
        "duplicate_pair_kept",
        "bad_score_set_aside",
    ]
    parts = [of_people, of_rels, repeats, listed]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    totals = one.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in one.columns])
    totals = totals.withColumn(names[1], F.col("_listed") - F.col("_kept"))
    rows = [F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in names]
    return totals.select(F.inline(F.array(*rows)))


def transform(
    people: DataFrame, rels: DataFrame, source: PeopleSource = PeopleSource()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, claims and anomaly counters of a people source."""
    claims = person_claims(people, source).unionByName(relationship_claims(rels, people, source))
    return people_entities(people, source), claims, anomaly_counters(people, rels)
