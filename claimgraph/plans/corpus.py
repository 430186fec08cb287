"""Claim tables derived from the driver's star-schema tables.

Customers, suppliers and parts are entities; order lines are ties between customers
and suppliers; a customer's columns become its attribute claims; user events become
the governance log of those attribute claims. Everything is a projection of whole
tables, so every query built on it grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.temporal import inverted
from claimgraph.operators import history, models
from claimgraph.schema import BOUNDS, relation_types
from claimgraph.session import materialise


def customer_id(key: Column) -> Column:
    return key


def supplier_id(key: Column) -> Column:
    """Negative and odd, so that no number of customers or parts reaches it."""
    return -2 * key - 1


def part_id(key: Column) -> Column:
    """Negative and even."""
    return -2 * key - 2


def attribute_id(subject: Column, slot: Column) -> Column:
    return F.concat_ws("-", F.lit("a"), subject, slot)


def line_external_id(order: Column, line: Column) -> Column:
    """Key of an order line's record."""
    return F.concat_ws("-", order, line)


def line_content_hash(part: Column, supplier: Column, shipped: Column) -> Column:
    return F.md5(F.concat_ws("|", part, supplier, shipped.cast("string")).cast("binary"))


def entity_record_id(entity: Column) -> Column:
    return F.concat_ws("-", F.lit("e"), entity)


LOADED_AT = "2023-01-01 00:00:00"
CODES = ("IN", "CA", "AF/IN", "BF/IN", "AF", "BF")


def _day(name: str) -> Column:
    return F.to_date(name)


def _plus_days(column: Column, days: int) -> Column:
    return F.date_add(column, days).cast("timestamp_ntz")


class Corpus:
    """Lazily derived claim tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Dimensions ------------------------------------------------------------
    @cached_property
    def relation_types(self) -> DataFrame:
        return relation_types(self.spark)

    @cached_property
    def sources(self) -> DataFrame:
        key, name = F.col("r_regionkey"), F.col("r_name")
        return self.table("region").select(
            key.cast("long").alias("source_id"),
            F.lower(name).alias("slug"),
            name.alias("title"),
            F.concat(F.lit("v"), key.cast("string")).alias("version"),
            F.concat(F.lit("https://example.org/"), F.lower(name)).alias("retrieval_uri"),
            F.lit("open").alias("license"),
            (key % 2 == 0).alias("license_confirmed"),
        )

    @cached_property
    def agents(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(
            key.cast("long").alias("agent_id"),
            F.lower("n_name").alias("slug"),
            F.when(key % 3 == 0, "human").when(key % 3 == 1, "pipeline").otherwise("model").alias("kind"),
            F.col("n_name").alias("display_name"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        def part(table: str, key: str, ident, kind: str) -> DataFrame:
            return self.table(table).select(
                ident(F.col(key)).alias("entity_id"), F.lit(kind).alias("entity_type")
            )

        return (
            part("customer", "c_custkey", customer_id, "person")
            .unionByName(part("supplier", "s_suppkey", supplier_id, "organization"))
            .unionByName(part("part", "p_partkey", part_id, "document"))
        )

    @cached_property
    def anchors(self) -> DataFrame:
        def part(table: str, key: str, ident, authority: str, prefix: str = "") -> DataFrame:
            text = F.concat(F.lit(prefix), F.col(key).cast("string"))
            return self.table(table).select(
                F.lit(authority).alias("authority"),
                text.alias("external_id"),
                ident(F.col(key)).alias("entity_id"),
            )

        return (
            part("customer", "c_custkey", customer_id, "registry")
            .unionByName(part("customer", "c_custkey", customer_id, "household", "h"))
            .unionByName(part("supplier", "s_suppkey", supplier_id, "ledger"))
            .unionByName(part("part", "p_partkey", part_id, "catalogue"))
        )

    # Ties from order lines --------------------------------------------------
    @cached_property
    def ties(self) -> DataFrame:
        """Current tie claims, with the source and record columns they rest on."""
        line, order = self.table("lineitem"), self.table("orders")
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        # Lines that agree in the named keys are told apart by their other columns, equal ones by a count. They are dealt
        # by the order alone, which also serves the join with it; since every read of ties needs the same columns for
        # this, a query that reads ties several times moves the lines once.
        keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        rest = (
            "l_discount", "l_extendedprice", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate", "l_tax"
        )
        line = line.select(*keys, *rest).repartition("l_orderkey").withColumn(
            "_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
        )
        # The nations are joined one by one, so that the size of the suppliers can be told beforehand.
        rows = (
            line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        )
        claim_id = F.concat_ws("-", F.lit("t"), *keys, F.col("_n"))
        returned, final = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
        placed, shipped = _day("o_orderdate"), _day("l_shipdate")
        number = F.col("l_linenumber")
        code = F.element_at(F.array(*[F.lit(c) for c in CODES]), number)
        original = F.when(number <= 6, F.concat(F.lit('{"start":{"type_code":"'), code, F.lit('"}}'))).when(
            F.col("l_returnflag") == "A", F.lit('{"type_code":"CA"}')
        )
        raw_bounds = rows.select(
            claim_id.alias("claim_id"),
            F.col("o_custkey").alias("subject_entity_id"),
            supplier_id(F.col("l_suppkey")).alias("object_entity_id"),
            F.when(returned, "corresponded-with").otherwise("associated-with").alias("predicate"),
            F.when(~returned, F.abs(F.round(F.col("l_discount") * 10, 1))).alias("confidence_point"),
            placed.alias(BOUNDS[0]),
            F.when(final, F.date_add(placed, 30)).alias(BOUNDS[1]),
            F.when(final, F.date_sub(shipped, 30)).alias(BOUNDS[2]),
            shipped.alias(BOUNDS[3]),
            (number == 7).alias("approximate"),
            original.alias("valid_time_original"),
            F.when(final, "imported").otherwise("extracted").alias("method"),
            F.col("s_nationkey").cast("long").alias("asserted_by_agent_id"),
            F.concat(F.lit("run-"), F.year(placed).cast("string")).alias("import_run_id"),
            _plus_days(placed, 1).alias("recorded_at"),
            F.when(F.col("l_quantity") >= 50, "superseded")
            .when(F.col("l_quantity") >= 46, "disputed")
            .otherwise("asserted")
            .alias("status"),
            F.col("n_regionkey").cast("long").alias("source_id"),
            line_external_id(F.col("l_orderkey"), number).alias("external_id"),
            line_content_hash(F.col("l_partkey"), F.col("l_suppkey"), shipped).alias("content_hash"),
            # What these two are made of, for rows that are moved before they are needed.
            F.col("l_orderkey").alias("order_key"),
            number.alias("line_number"),
            F.col("l_partkey").alias("part_key"),
            shipped.alias("shipped"),
            (F.col("l_tax") >= 0.04).alias("second_support"),
            F.col("l_quantity").alias("quantity"),
        )
        dropped = raw_bounds.withColumn("inverted", inverted())
        return dropped.withColumns(
            {b: F.when(~F.col("inverted"), F.col(b)) for b in BOUNDS}
            | {
                "origin": F.when(F.col("confidence_point").isNotNull(), "source").otherwise("unscored"),
                "object_literal": F.lit(None).cast("string"),
                "method_detail": F.lit(None).cast("string"),
                "confidence_kind": F.when(
                    F.col("confidence_point").isNull(), "unscored"
                ).otherwise("source_native_scalar"),
            }
        )

    # Attribute claims --------------------------------------------------------
    @cached_property
    def attributes(self) -> DataFrame:
        """Attribute and same-as claims before any governance event."""
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        born = F.lit(1500) + (key % 120).cast("int")
        died = born + 40 + nation

        def literal(kind: str, value: Column) -> Column:
            return F.concat(F.lit(f'{{"kind":"{kind}","value":"'), value, F.lit('"}'))

        def number(kind: str, value: Column) -> Column:
            return F.concat(F.lit(f'{{"kind":"{kind}","value":'), value.cast("string"), F.lit("}"))

        none, no_date = F.lit(None), F.lit(None).cast("date")

        def row(k: int, predicate: str, when: Column, *, text: Column = none, other: Column = none,
                se: Column = no_date, sl: Column = no_date, detail: Column = none,
                point: Column = none) -> Column:
            built = F.struct(
                F.lit(k).alias("k"), F.lit(predicate).alias("predicate"),
                text.cast("string").alias("object_literal"),
                other.cast("long").alias("object_entity_id"),
                se.alias(BOUNDS[0]), sl.alias(BOUNDS[1]),
                detail.cast("string").alias("method_detail"),
                point.cast("double").alias("confidence_point"),
            )
            return F.when(when, built)

        def first(y: Column) -> Column:
            return F.make_date(y, F.lit(1), F.lit(1))

        def last(y: Column) -> Column:
            return F.make_date(y, F.lit(12), F.lit(31))

        always = F.lit(True)
        alias = F.concat(F.lower("c_mktsegment"), F.lit(" account "), nation.cast("string"))
        people = F.array(
            row(0, "has-name", always, text=literal("string", F.col("c_name")),
                detail=F.lit('{"name_kind":"primary"}')),
            row(1, "has-name", always, text=literal("string", alias),
                detail=F.lit('{"name_kind":"alias"}')),
            row(2, "born", always, text=number("year", born), se=first(born), sl=last(born)),
            row(3, "died", F.col("c_acctbal") >= 0, text=number("year", died),
                se=first(died), sl=last(died)),
            row(4, "has-gender", key % 3 != 2,
                text=literal("gender", F.when(key % 3 == 0, "male").otherwise("female"))),
            row(5, "has-description", F.col("c_acctbal") > 5000,
                text=literal("string", F.col("c_mktsegment"))),
            row(6, "has-external-id", key % 7 != 0,
                text=literal("external-id", (key + 500).cast("string"))),
            row(7, "born", key % 11 == 0, text=number("year", born + 1),
                se=first(born + 1), sl=last(born + 1), point=F.lit(0.45)),
            row(9, "same-as", (key % 10).isin(1, 2, 3), other=key - 1, point=F.lit(0.8)),
        )
        customers = self.table("customer").select(
            key.alias("subject_entity_id"), nation.alias("_n"), F.explode(F.array_compact(people)).alias("_r")
        )

        def named(table: str, key: str, ident, text: Column, k: int, kind: str) -> DataFrame:
            built = row(k, "has-name", always, text=literal("string", text),
                        detail=F.lit(f'{{"name_kind":"{kind}"}}'))
            return self.table(table).select(
                ident(F.col(key)).alias("subject_entity_id"),
                (F.col(key) % 25).alias("_n"),
                built.alias("_r"),
            )

        both = F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_brand"))
        rows = (
            customers
            .unionByName(named("supplier", "s_suppkey", supplier_id, F.col("s_name"), 0, "primary"))
            .unionByName(named("part", "p_partkey", part_id, F.col("p_name"), 0, "primary"))
            .unionByName(named("part", "p_partkey", part_id, both, 1, "alias"))
        )
        point = F.col("_r.confidence_point")
        return rows.select(
            attribute_id(F.col("subject_entity_id"), F.col("_r.k")).alias("claim_id"),
            "subject_entity_id",
            "_r.object_entity_id",
            "_r.predicate",
            point.alias("confidence_point"),
            *[F.col(f"_r.{b}").alias(b) for b in BOUNDS[:2]],
            *[no_date.alias(b) for b in BOUNDS[2:]],
            F.lit(False).alias("approximate"),
            F.lit(None).cast("string").alias("valid_time_original"),
            F.lit("imported").alias("method"),
            F.col("_n").cast("long").alias("asserted_by_agent_id"),
            F.lit("run-attributes").alias("import_run_id"),
            F.lit(LOADED_AT).cast("timestamp_ntz").alias("recorded_at"),
            F.col("_r.object_literal"),
            F.col("_r.method_detail"),
            F.when(point.isNull(), "unscored").otherwise("source_native_scalar").alias("confidence_kind"),
        )

    # Logs --------------------------------------------------------------------
    @cached_property
    def user_events(self) -> DataFrame:
        """Governance events aimed at attribute claims, some of unknown claims."""
        kind = F.col("event_type")
        point = F.round(F.col("value") / 500, 2)
        return self.table("events").select(
            F.concat_ws("-", F.lit("u"), "event_id").alias("id"),
            attribute_id(F.col("user_id"), F.col("event_id") % 10).alias("claim_id"),
            F.when(kind == "signup", "assert")
            .when(kind == "error", "dispute")
            .when(kind == "view", "undispute")
            .when((kind == "click") & (F.col("event_id") % 97 == 0), "supersede")
            .otherwise("adjust_confidence")
            .alias("event_type"),
            F.col("ts").alias("occurred_at"),
            (F.col("user_id") % 25).alias("actor_agent_id"),
            F.concat(F.lit('{"point":'), point.cast("string"), F.lit("}")).alias("payload"),
        )

    @staticmethod
    def _asserts(claims: DataFrame) -> DataFrame:
        return claims.select(
            F.concat_ws("/", "claim_id", F.lit("0")).alias("id"),
            "claim_id",
            F.lit("assert").alias("event_type"),
            F.col("recorded_at").alias("occurred_at"),
            F.col("asserted_by_agent_id").alias("actor_agent_id"),
            F.lit("{}").alias("payload"),
        )

    @cached_property
    def attribute_events(self) -> DataFrame:
        known = self.user_events.join(self.attributes, "claim_id", "left_semi")
        return self._asserts(self.attributes).unionByName(known)

    @cached_property
    def tie_events(self) -> DataFrame:
        """Asserts of every tie, and the disputes and supersedes their quantity implies."""
        q = F.col("quantity")

        def event(step: int, kind: str, days: int, when: Column) -> Column:
            return F.when(
                when,
                F.struct(
                    F.concat_ws("/", "claim_id", F.lit(str(step))).alias("id"),
                    F.lit(kind).alias("event_type"),
                    _plus_days(F.to_date("recorded_at"), days).alias("occurred_at"),
                ),
            )

        steps = F.array_compact(
            F.array(
                event(0, "assert", 0, F.lit(True)),
                event(1, "dispute", 10, (q >= 41) & (q < 50)),
                event(2, "undispute", 20, (q >= 41) & (q < 46)),
                event(3, "supersede", 30, q >= 50),
            )
        )
        return self.ties.select(
            "claim_id", "asserted_by_agent_id", F.explode(steps).alias("_e")
        ).select(
            "_e.id", "claim_id", "_e.event_type", "_e.occurred_at",
            F.col("asserted_by_agent_id").alias("actor_agent_id"), F.lit("{}").alias("payload"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.tie_events.unionByName(self.attribute_events)

    # Current claims ------------------------------------------------------------
    @cached_property
    def current_attributes(self) -> DataFrame:
        claims, events = self.attributes, self.attribute_events
        return history.current_claims(
            claims, history.current_status(events), history.current_confidence(claims, events)
        )

    @cached_property
    def claims(self) -> DataFrame:
        """All claims with current status and confidence."""
        return self.ties.select(self.current_attributes.columns).unionByName(self.current_attributes)

    def keep(self, *more: str, columns: tuple[str, ...] | None = None) -> None:
        """Write the current claims, for a query that reads them many times; ``more`` are columns of ties besides.

        ``columns`` are those of claims that the query reads, all of them if not given.
        """
        held = self.current_attributes if columns is None else self.current_attributes.select(*columns)
        self.current_attributes = materialise(held, "current-attributes")
        self.ties = materialise(self.ties.select(*self.current_attributes.columns, *more), "ties")

    @cached_property
    def recorded_claims(self) -> DataFrame:
        """All claims as recorded: source confidence, no status."""
        return self.ties.select(self.attributes.columns).unionByName(self.attributes)

    @cached_property
    def summary(self) -> DataFrame:
        return models.rebuild_entity_summary(self.entities, self.claims)

    # Provenance ----------------------------------------------------------------
    @cached_property
    def records(self) -> DataFrame:
        ties = self.ties.select(
            F.col("claim_id").alias("source_record_id"), "source_id",
            F.lit("relationship").alias("record_kind"), "external_id", "content_hash",
            F.concat(F.lit('{"line":"'), F.col("external_id"), F.lit('"}')).alias("raw"),
        )
        people = self.entities.select(
            entity_record_id(F.col("entity_id")).alias("source_record_id"),
            (F.abs("entity_id") % 5).alias("source_id"),
            F.col("entity_type").alias("record_kind"),
            F.col("entity_id").cast("string").alias("external_id"),
            F.md5(F.col("entity_id").cast("string").cast("binary")).alias("content_hash"),
            F.concat(F.lit('{"entity":'), F.col("entity_id").cast("string"), F.lit("}")).alias("raw"),
        )
        return ties.unionByName(people)

    @cached_property
    def record_sources(self) -> DataFrame:
        """``source_record_id, source_id`` of :attr:`records`, for reads that need no more of them."""
        ties = self.ties.select(F.col("claim_id").alias("source_record_id"), "source_id")
        people = self.entities.select(
            entity_record_id(F.col("entity_id")).alias("source_record_id"), (F.abs("entity_id") % 5).alias("source_id")
        )
        return ties.unionByName(people)

    @cached_property
    def support(self) -> DataFrame:
        own = self.ties.select("claim_id", F.col("claim_id").alias("source_record_id"))
        second = self.ties.where(F.col("second_support")).select(
            "claim_id", entity_record_id(F.col("subject_entity_id")).alias("source_record_id")
        )
        attributes = self.attributes.select(
            "claim_id", entity_record_id(F.col("subject_entity_id")).alias("source_record_id")
        )
        return own.unionByName(second).unionByName(attributes)
