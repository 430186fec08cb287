"""Interchange lines: one JSON object per line, keys sorted, no spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.wire import json_object, member, raw_member
from claimgraph.operators.ordered import numbered
from claimgraph.schema import BOUNDS


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: non-blank lines, good or bad, verbatim, ready to be imported.

    ``line_no`` counts all lines of all files, by file name and place in the file, whatever the size of the
    splits they are read in.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("offset"),  # orders the lines of one split
        F.col("value").alias("line"),
    )
    lines = numbered(rows, "file", "block", "offset")
    return lines.where(F.trim("line") != "").select("file", "line_no", "line")


def _ref(column: Column) -> Column:
    return F.when(
        column.isNotNull(),
        json_object(member("authority", column["authority"]), member("id", column["id"])),
    )


def _literal(column: Column) -> Column:
    number = member("value", column["value"].cast("long"))
    text = member("value", column["value"])
    return F.when(
        column.isNotNull(),
        json_object(
            member("authority", column["authority"], column["authority"].isNotNull()),
            member("kind", column["kind"]),
            F.when(column["kind"] == "year", number).otherwise(text),
        ),
    )


def _valid_time(v: Column) -> Column:
    start, any_bound = v["shape"].isin("start", "both"), v["shape"] == "both"
    present = dict(zip(BOUNDS, (start, start, any_bound, any_bound), strict=True))
    members = {b: member(b, v[b].cast("string"), p) for b, p in present.items()}
    members["approximate"] = member("approximate", v["approximate"], start)
    members["original"] = raw_member("original", v["original"])
    return F.when(v.isNotNull(), json_object(*[members[k] for k in sorted(members)]))


def _confidence(c: Column) -> Column:
    scored = c["kind"] == "source_native_scalar"
    return json_object(
        member("calibrated", c["calibrated"], scored),
        member("kind", c["kind"]),
        member("point", c["point"], scored),
        F.when(scored, raw_member("raw", c["raw"])),
        member("scale", c["scale"], scored),
    )


def _support(s: Column) -> Column:
    return json_object(
        member("content_hash", s["content_hash"]),
        member("external_id", s["external_id"]),
        raw_member("raw", s["raw"]),
        member("record_kind", s["record_kind"]),
        member("source", s["source"]),
    )


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def claim_lines(claims: DataFrame, *keep: str) -> DataFrame:
    """``line`` per interchange claim. Bounds keep their nulls, absent parts are left out; columns to ``keep`` stay."""
    line = json_object(
        member("asserted_by", F.col("asserted_by")),
        raw_member("confidence", _confidence(F.col("confidence"))),
        member("method", F.col("method")),
        raw_member("method_detail", F.col("method_detail")),
        raw_member(
            "object",
            json_object(
                raw_member("entity", _ref(F.col("object_entity"))),
                raw_member("literal", _literal(F.col("object_literal"))),
            ),
        ),
        member("predicate", F.col("predicate")),
        member("schema_version", F.col("schema_version")),
        raw_member("subject", _ref(F.col("subject"))),
        raw_member("support", _array(F.transform("support", _support))),
        raw_member("valid_time", _valid_time(F.col("valid_time"))),
    )
    return claims.select(*keep, line.alias("line"))


def entity_lines(entities: DataFrame) -> DataFrame:
    line = json_object(
        member("entity_type", F.col("entity_type")),
        raw_member("external_ids", _array(F.transform("external_ids", _ref))),
        raw_member("ref", _ref(F.col("ref"))),
        member("schema_version", F.col("schema_version")),
    )
    return entities.select(line.alias("line"))


def write_ndjson(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
