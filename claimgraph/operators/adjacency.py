"""The ties of all entities as a published table that reads need not shuffle.

Rows are bucketed and sorted by entity. An entity with very many ties is a *hub*: its rows are dealt into pieces of
bounded size, and a small directory says how many. A read repeats a hub's key once per piece and every other key
once, so it is the short side that moves, and a hub's ties are read by as many tasks as it has pieces.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimgraph.functions.confidence import passes_confidence
from claimgraph.functions.temporal import certainly_active, is_undated, possibly_active, window_bounds
from claimgraph.operators.graph import adjacency, relationships
from claimgraph.operators.history import asserted
from claimgraph.schema import BOUNDS
from claimgraph.session import materialise

#: Ties of one entity that stay together.
HUB_ROWS = 100_000
COLUMNS = (
    "entity_id", "counterpart_id", "claim_id", "predicate", "subject_entity_id", "object_entity_id", *BOUNDS,
    "approximate", "confidence_point",
)


def hub_directory(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """``key, pieces`` of the keys with more than ``limit`` rows: one for every ``limit`` rows of the table at most."""
    limit = HUB_ROWS if limit is None else limit
    counted = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    return counted.select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("pieces"))


def dealt(rows: DataFrame, hubs: DataFrame, key: str, by: str) -> DataFrame:
    """Add ``piece``: 0, or the piece of a hub that the row goes to."""
    piece = F.coalesce(F.pmod(F.xxhash64(by), F.col("pieces")), F.lit(0)).cast("int")
    return rows.join(hubs, key, "left").withColumn("piece", piece).drop("pieces")


def for_every_piece(rows: DataFrame, hubs: DataFrame, key: str) -> DataFrame:
    """Rows that look up a key: those of a hub once for each of its pieces."""
    pieces = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
    return rows.join(hubs, key, "left").withColumn("piece", F.explode(pieces)).drop("pieces")


class Adjacency:
    """A published table and its directory. ``name`` is the table's name in the session's catalogue."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        layout = json.loads(spark.read.text(f"{self.path}/layout").first()["value"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(layout["columns"]))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (entity_id, piece) "
            f"SORTED BY (entity_id) INTO {layout['buckets']} BUCKETS LOCATION '{self.path}/ties'"
        )

    @property
    def ties(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def hubs(self) -> DataFrame:
        return self.spark.read.schema("entity_id bigint, pieces int").parquet(f"{self.path}/hubs")

    def of(self, focus: DataFrame) -> DataFrame:
        """Ties of the entities in ``focus`` (``entity_id``)."""
        keys = for_every_piece(focus.select("entity_id").distinct(), self.hubs, "entity_id")
        return self.ties.join(keys, ["entity_id", "piece"], "left_semi")

    def ego_network(
        self, focus: DataFrame, threshold: float = 0.0, start: str | None = None, end: str | None = None,
        include_unscored: bool = False,
    ) -> DataFrame:
        """As ``graph.ego_network``: asserted ties that pass the filter and may be active in the window."""
        w0, w1 = window_bounds(start, end)
        passing = possibly_active(w0, w1) & passes_confidence(F.col("confidence_point"), threshold, include_unscored)
        return self.of(focus).where(passing).withColumns(
            {"certainly_active": certainly_active(w0, w1), "undated": is_undated()}
        )

    def edges(self, threshold: float = 0.0, start: str | None = None, end: str | None = None) -> DataFrame:
        """``node, piece, next, claim_id, confidence_point`` of scored ties, bucketed by node and piece."""
        w0, w1 = window_bounds(start, end)
        passing = possibly_active(w0, w1) & passes_confidence(F.col("confidence_point"), threshold, False)
        return self.ties.where(passing).select(
            F.col("entity_id").alias("node"), "piece", F.col("counterpart_id").alias("next"), "claim_id", "confidence_point"
        )


def publish_adjacency(
    claims: DataFrame, path: str, name: str, buckets: int | None = None, limit: int | None = None
) -> Adjacency:
    """Publish the asserted ties of current ``claims`` below ``path``. Another session opens them with :class:`Adjacency`."""
    spark = claims.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hubs are counted first, so the ties are written once before they are spread to their ends.
    ties = materialise(relationships(asserted(claims)).select(*COLUMNS[2:]), "ties")
    ends = adjacency(ties).select(*COLUMNS)
    hub_directory(ends, "entity_id", limit).write.parquet(f"{path}/hubs")
    hubs = spark.read.schema("entity_id bigint, pieces int").parquet(f"{path}/hubs")
    rows = dealt(ends, hubs, "entity_id", "claim_id")
    # Dealt as the buckets are, so each bucket is one file.
    (
        rows.repartition(buckets, "entity_id", "piece").write.bucketBy(buckets, "entity_id", "piece").sortBy("entity_id")
        .option("path", f"{path}/ties").saveAsTable(name)
    )
    layout = json.dumps({"buckets": buckets, "columns": rows.schema.jsonValue()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/layout")
    return Adjacency(spark, path, name)
