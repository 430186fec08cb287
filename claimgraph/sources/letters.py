"""Letter metadata from XML: one row per correspondence description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.wire import json_object, member, raw_member
from claimgraph.operators.letters import DATE_KEYS, gnd_id
from claimgraph.operators.ordered import once

# Every attribute is read as text: inference would turn partial dates into NULL.
_TEXT_WITH_REF = "struct<_VALUE:string,_ref:string>"
_DATE = "struct<_VALUE:string,_when:string,_notBefore:string,_notAfter:string,_from:string,_to:string>"
ROW = "correspDesc"
XML_SCHEMA = (
    "_key string, _ref string, _source string, "
    f"correspAction array<struct<_type:string,persName:{_TEXT_WITH_REF},"
    f"placeName:{_TEXT_WITH_REF},date:{_DATE}>>"
)


def _blank_to_null(text: Column) -> Column:
    trimmed = F.btrim(text)
    return F.when(trimmed != "", trimmed)


def _action(role: str) -> Column:
    """The last action of a role, as the fields the mapping needs."""
    matching = F.filter("correspAction", lambda a: a["_type"] == role)
    one = F.element_at(matching, F.when(F.size(matching) > 0, F.lit(-1)))
    dates = [F.when(one["date"][f"_{k}"] != "", one["date"][f"_{k}"]).alias(k) for k in DATE_KEYS]
    fields = F.struct(
        gnd_id(one["persName"]["_ref"]).alias("gnd"),
        _blank_to_null(one["persName"]["_VALUE"]).alias("name"),
        one["placeName"]["_ref"].alias("place_ref"),
        _blank_to_null(one["placeName"]["_VALUE"]).alias("place_name"),
        *dates,
        one["persName"].isNotNull().alias("has_person"),
        one["placeName"].isNotNull().alias("has_place"),
    )
    return F.when(F.size(matching) > 0, fields)


def _action_json(name: str) -> Column:
    a = F.col(name)
    dates = {k: member(k, a[k], a[k].isNotNull()) for k in DATE_KEYS}
    person = {k: member(k, a[k], a["has_person"]) for k in ("gnd", "name")}
    place = {k: member(k, a[k], a["has_place"]) for k in ("place_name", "place_ref")}
    members = dates | person | place
    return F.when(a.isNotNull(), json_object(*[members[k] for k in sorted(members)]))


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """``element``: every row element as text, an empty one (``<.../>``) too.

    Files are cut at the closing tags, so one file is read by as many tasks as it has splits, wherever its lines
    break. The closing tag must stand in markup only, not in a comment.
    """
    chunks = spark.read.option("lineSep", f"</{ROW}>").text(path)
    empty = rf"<{ROW}(?=[\s/>])[^>]*/>"
    found = F.regexp_extract_all("value", F.lit(rf"(?s)({empty}|<{ROW}(?=[\s>]).*)"), F.lit(1))
    element = F.when(F.col("_e").rlike(f"^{empty}$"), F.col("_e")).otherwise(F.concat("_e", F.lit(f"</{ROW}>")))
    return chunks.select(F.explode(found).alias("_e")).select(element.alias("element"))


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """``key, ref, edition, sent, received, raw`` per letter; ``raw`` is canonical JSON."""
    parsed = once(_elements(spark, path), _row=F.from_xml("element", XML_SCHEMA))
    rows = parsed.select("_row.*")
    edition = F.ltrim(F.coalesce("_source", F.lit("")), F.lit("#"))
    letters = rows.select(
        F.col("_key").alias("key"),
        F.col("_ref").alias("ref"),
        F.when(edition != "", edition).alias("edition"),
        _action("sent").alias("sent"),
        _action("received").alias("received"),
    )
    raw = json_object(
        member("edition", F.col("edition")),
        member("key", F.col("key")),
        raw_member("received", _action_json("received")),
        member("record_kind", F.lit("letter")),
        member("ref", F.col("ref")),
        raw_member("sent", _action_json("sent")),
    )
    return letters.withColumn("raw", raw)
