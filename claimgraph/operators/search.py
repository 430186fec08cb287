"""Name search: trigram similarity or substring, found through an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import (
    contains_ignoring_case,
    gram_similarity,
    trigrams,
    windows_of,
)
from claimgraph.operators.ingest import key_bucket, opened
from claimgraph.schema import NAME_SIMILARITY_FLOOR
from claimgraph.session import materialise
from claimgraph.sources.runs import Commit, RunLog


def _query_keys(queries: DataFrame, frequencies: DataFrame, floor: float) -> DataFrame:
    """The index keys that together reach every possible match of each query.

    A name as similar as ``floor`` shares at least ``ceil(floor * n)`` of the
    query's n grams, so it holds one of the n - ceil(floor * n) + 1 rarest. A name
    containing the query holds all its substrings, so the rarest one is enough.
    ``before`` holds the grams of the query that come before the key: a name with one of them is met there.
    """
    keys = queries.select("q", F.explode(_keys_of_query()).alias("key"))
    keys = keys.select("q", "key.*").join(frequencies, ["kind", "gram"], "left")
    order = Window.partitionBy("q", "kind").orderBy(F.coalesce("names", F.lit(0)), "gram")
    size = F.count("*").over(Window.partitionBy("q", "kind"))
    needed = F.when(
        F.col("kind") == "gram", size - F.ceil(F.round(size * F.lit(floor), 9)) + 1
    ).otherwise(F.lit(1))
    kept = keys.withColumns({"_i": F.row_number().over(order), "_n": needed}).where(F.col("_i") <= F.col("_n"))
    # As many as the query has grams.
    grams = F.collect_list(F.when(F.col("kind") == "gram", F.struct("_i", "gram"))).over(Window.partitionBy("q"))
    earlier = F.filter("_grams", lambda g: (F.col("kind") == "part") | (g["_i"] < F.col("_i")))
    return kept.withColumn("_grams", grams).select("q", "kind", "gram", earlier["gram"].alias("before"))


def _tag(kind: str, grams):
    return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def _keys_of_query():
    q = F.col("q")
    width = F.least(F.length(q), F.lit(3))
    return F.concat(_tag("gram", trigrams(q)), _tag("part", windows_of(q, width)))


def _index(names: DataFrame) -> DataFrame:
    """Index rows of a name: its trigrams, and its 2- and 3-character substrings, each once."""
    keys = F.concat(
        _tag("gram", F.col("grams")),
        _tag("part", windows_of(F.col("name"), F.lit(3))),
        _tag("part", windows_of(F.col("name"), F.lit(2))),
    )
    return names.select("name", "grams", F.explode(keys).alias("_k")).select(
        "name", "grams", "_k.kind", "_k.gram"
    )


def match_names(
    queries: DataFrame, names: DataFrame, floor: float = NAME_SIMILARITY_FLOOR
) -> DataFrame:
    """``q, name, similarity`` of every distinct name matching each query.

    ``queries``: ``q``, at least two characters. A match is as similar as ``floor``
    or contains the query, ignoring case. Repeated names are matched once.
    """
    distinct = names.select("name").distinct().withColumn("grams", trigrams(F.col("name")))
    return _matched(queries, _index(distinct), floor)


def _asked(queries: DataFrame) -> DataFrame:
    """Queries of two characters or more, each once."""
    return queries.where(F.length(F.trim("q")) >= 2).select("q").distinct()


def _wanted(queries: DataFrame) -> DataFrame:
    """The index keys that queries may be found under."""
    return _asked(queries).select(F.explode(_keys_of_query()).alias("_k")).select("_k.*").distinct()


def _matched(queries: DataFrame, index: DataFrame, floor: float) -> DataFrame:
    """:func:`match_names` on index rows, which are cut to the queries' keys first."""
    queries, posting = _asked(queries), index.join(_wanted(queries), ["kind", "gram"], "left_semi")
    frequencies = posting.groupBy("kind", "gram").agg(F.count("*").alias("names"))
    keys = _query_keys(queries, frequencies, floor)
    # A name meets a query at their first common key only, so pairs come out once and nobody has to gather them.
    candidates = posting.join(keys, ["kind", "gram"]).where(~F.arrays_overlap("before", "grams")).select("q", "name", "grams")
    similarity = gram_similarity(trigrams(F.col("q")), F.col("grams"))
    return (
        candidates.withColumn("similarity", similarity)
        .where(
            (F.col("similarity") >= F.lit(floor))
            | contains_ignoring_case(F.col("name"), F.col("q"))
        )
        .select("q", "name", "similarity")
    )


# The kept index ------------------------------------------------------------------------
PARTS = {"name_index": "bucket", "indexed_names": "bucket"}
_INDEX = "kind string, gram string, name string, grams array<string>, bucket int"
_INDEXED = "name string, bucket int"


def publish_names(log: RunLog, run_id: str, names: DataFrame) -> Commit:
    """Add names (``name``) to the published index, such as those of the entities that a change has touched.

    Names that are indexed already are looked up in the parts that can hold them and not written again. A name that
    nobody bears any more stays: a search joins what it finds to the names of the day.
    """
    def build(at: int) -> dict[str, DataFrame]:
        fresh = names.select("name").where("name IS NOT NULL").distinct()
        known = opened(log.table("indexed_names", at, schema=_INDEXED), fresh)
        fresh = materialise(fresh.join(known, "name", "left_anti"), "names")
        index = _index(fresh.withColumn("grams", trigrams(F.col("name")))).select("kind", "gram", "name", "grams")
        return {
            "name_index": index.withColumn("bucket", key_bucket("kind", "gram")),
            "indexed_names": fresh.withColumn("bucket", key_bucket("name")),
        }

    return log.publish(run_id, build, PARTS)


def match_published(
    log: RunLog, queries: DataFrame, floor: float = NAME_SIMILARITY_FLOOR, at: int | None = None
) -> DataFrame:
    """:func:`match_names` on the published index: only the parts with the queries' own keys are read."""
    index = opened(log.table("name_index", at, schema=_INDEX), _wanted(queries).select("kind", "gram"))
    return _matched(queries, index, floor)


def search_entities(
    queries: DataFrame,
    name_rows: DataFrame,
    summary: DataFrame,
    entity_type: str | None = None,
    offset: int = 0,
    limit: int = 20,
    floor: float = NAME_SIMILARITY_FLOOR,
) -> DataFrame:
    """A page of entities per query: best similarity first, then lowest id."""
    entities = summary.select("entity_id", "entity_type", "display_name")
    if entity_type:
        entities = entities.where(F.col("entity_type") == entity_type)
    hits = (
        match_names(queries, name_rows, floor)
        .join(name_rows.select("name", "entity_id"), "name")
        .groupBy("q", "entity_id")
        .agg(F.max("similarity").alias("similarity"))
        .join(entities, "entity_id")
    )
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "entity_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= offset + limit + 1
    )
    more = F.max("rank").over(Window.partitionBy("q")) > offset + limit
    return ranked.withColumn("more", more).where(
        (F.col("rank") > offset) & (F.col("rank") <= offset + limit)
    )
