"""Record layouts and vocabularies of the claim graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "0.1.0"

# The four fuzzy bounds of a valid-time interval, in order.
BOUNDS = ("start_earliest", "start_latest", "end_earliest", "end_latest")

# Fixed values -------------------------------------------------------------
METHODS = ("manual", "imported", "extracted", "inferred")
LITERAL_KINDS = ("string", "year", "date", "gender", "external-id")
EVENT_TYPES = ("assert", "dispute", "undispute", "supersede", "adjust_confidence")
DISPUTE_GROUNDS = ("existence", "dating", "identity", "confidence", "source-reading")
# Lower edge of each band, inclusive, strongest first.
BAND_EDGES = (
    (0.90, "very_strong"),
    (0.70, "strong"),
    (0.40, "moderate"),
    (0.20, "weak"),
)
BANDS = ("very_strong", "strong", "moderate", "weak", "very_weak", "unscored")
# Predicate, label, category, range kind, symmetric.
RELATION_TYPES = (
    ("associated-with", "associated with", "relationship", "entity", False),
    ("corresponded-with", "corresponded with", "relationship", "entity", False),
    ("same-as", "same as", "relationship", "entity", True),
    ("has-name", "has name", "attribute", "literal", False),
    ("born", "born", "attribute", "literal", False),
    ("died", "died", "attribute", "literal", False),
    ("has-gender", "has gender", "attribute", "literal", False),
    ("has-description", "has description", "attribute", "literal", False),
    ("has-external-id", "has external id", "attribute", "literal", False),
)
# Date code -> (edge of the year that bounds below, edge that bounds above, circa).
DATE_CODES = {
    "IN": ("first", "last", False),
    "CA": ("first", "last", True),
    "AF/IN": ("first", None, False),
    "BF/IN": (None, "last", False),
    "AF": ("last", None, False),
    "BF": (None, "first", False),
}
THRESHOLD_LADDER = (0.0, 0.2, 0.4, 0.6, 0.8, 0.9)
EARLIEST_DATE = "0001-01-01"
LATEST_DATE = "9999-12-31"
EDGE_CAP = 500
NAME_SIMILARITY_FLOOR = 0.3
# Registries of the two source mappings: predicate, label, range kind, symmetric.
PEOPLE_TYPES = (
    ("associated-with", "associated with", "entity", True),
    ("has-name", "has name", "literal", False),
    ("born", "born", "literal", False),
    ("died", "died", "literal", False),
    ("has-gender", "has gender", "literal", False),
    ("has-description", "has description", "literal", False),
    ("has-external-id", "has external id", "literal", False),
)
LETTER_TYPES = (("corresponded-with", "corresponded with", "entity", False),)
# Authority, label, whether its ids are one-to-one identity anchors.
PEOPLE_AUTHORITIES = (
    ("sdfb", "Six Degrees of Francis Bacon", True),
    ("odnb", "Oxford Dictionary of National Biography", False),
)
LETTER_AUTHORITIES = (
    ("gnd", "Gemeinsame Normdatei (GND)", True),
    ("correspsearch", "correspSearch letter id", True),
)
# Columns every source row has, all text.
PEOPLE_COLUMNS = (
    "id",
    "display_name",
    "search_names_all",
    "birth_year",
    "birth_type",
    "death_year",
    "death_type",
    "gender",
    "description",
    "odnb_id",
)
TIE_COLUMNS = (
    "id",
    "person1_id",
    "person2_id",
    "max_certainty",
    "start_year",
    "start_type",
    "end_year",
    "end_type",
)
# --------------------------------------------------------------------------

ENTITY_RANGED = tuple(r[0] for r in RELATION_TYPES if r[3] == "entity")
LITERAL_RANGED = tuple(r[0] for r in RELATION_TYPES if r[3] == "literal")

REF = T.StructType(
    [T.StructField("authority", T.StringType()), T.StructField("id", T.StringType())]
)
LITERAL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("authority", T.StringType()),
    ]
)
SUPPORT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("record_kind", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)
# ``shape`` says which bound keys the record carries: both pairs, only the start
# pair (life dates), or none (dropped because they contradicted each other).
VALID_TIME = T.StructType(
    [T.StructField(b, T.DateType()) for b in BOUNDS]
    + [
        T.StructField("approximate", T.BooleanType()),
        T.StructField("original", T.StringType()),
        T.StructField("shape", T.StringType()),
    ]
)
CONFIDENCE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("scale", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("point", T.DoubleType()),
        T.StructField("calibrated", T.BooleanType()),
    ]
)
INTERCHANGE_CLAIM = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("subject", REF),
        T.StructField("predicate", T.StringType()),
        T.StructField("object_entity", REF),
        T.StructField("object_literal", LITERAL),
        T.StructField("valid_time", VALID_TIME),
        T.StructField("confidence", CONFIDENCE),
        T.StructField("method", T.StringType()),
        T.StructField("method_detail", T.StringType()),
        T.StructField("asserted_by", T.StringType()),
        T.StructField("support", T.ArrayType(SUPPORT)),
    ]
)
INTERCHANGE_ENTITY = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("ref", REF),
        T.StructField("entity_type", T.StringType()),
        T.StructField("external_ids", T.ArrayType(REF)),
    ]
)


def _small(spark: SparkSession, rows, layout: str) -> DataFrame:
    """A table of a few rows whose size the planner can tell; of rows handed over as a list it cannot."""
    fields = [part.split() for part in layout.split(", ")]
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def relation_types(spark: SparkSession) -> DataFrame:
    """The predicate vocabulary: nine rows, so safe to broadcast."""
    return _small(
        spark, RELATION_TYPES,
        "slug string, label string, category string, range_kind string, is_symmetric boolean",
    )


def source_types(spark: SparkSession, rows=PEOPLE_TYPES) -> DataFrame:
    """Relation types a source mapping registers."""
    return _small(spark, rows, "slug string, label string, range_kind string, is_symmetric boolean")


def source_authorities(spark: SparkSession, rows=PEOPLE_AUTHORITIES) -> DataFrame:
    """Naming authorities a source mapping refers to."""
    return _small(spark, rows, "slug string, label string, identity_bearing boolean")
