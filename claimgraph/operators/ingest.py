"""Bulk import: lines to entities, records, claims, support and events.

Ids are ``batch << 40 | line``: unique, ordered by arrival and free of collisions at
any size, which a 64-bit hash is not. Source records are keyed by the hash of their
natural key and content. Everything a batch writes follows from the batch and the
tables it is given, so a repeated run writes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.ordered import carry_before, first_per_key, sequence_bucket
from claimgraph.operators.validate import (
    parse_claims,
    parse_entities,
    validate_claims,
    validate_entities,
)
from claimgraph.schema import BOUNDS
from claimgraph.session import materialise

RECORD_KEY = ["source", "record_kind", "external_id"]
# What makes two claims the same claim, besides the record they rest on.
IDENTITY = [
    "subject_entity_id",
    "predicate",
    "object_entity_id",
    "object_literal",
    "start_earliest",
    "end_latest",
    "confidence_point",
]
# Parts of a stored table. A store keeps the number it was written with.
STORE_BUCKETS = 64
REPORT = ("received", "inserted", "duplicates", "superseded", "rejected")


def line_id(batch_no: int, line: Column) -> Column:
    """An id of a line of a batch. Batches hold fewer than 2**40 lines and there are fewer than 2**23 batches."""
    if not 0 <= batch_no < 1 << 23:
        raise ValueError("batch_no is outside [0, 2**23)")
    inside = (line >= 0) & (line < F.lit(1 << 40))
    return F.when(
        inside, F.shiftleft(F.lit(batch_no).cast("long"), 40) + line.cast("long")
    ).otherwise(F.raise_error(F.lit("line_no is outside [0, 2**40); number the lines densely")).cast("long"))


def key_bucket(*names: str) -> Column:
    """The part of a stored table that holds a key."""
    return F.pmod(F.xxhash64(*names), F.lit(STORE_BUCKETS)).cast("int")


def opened(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The parts of a stored table that can hold the keys (one row each, in the order of the table's layout).

    A table that is laid out by key has a column ``bucket``, which the scan is cut by; another is read whole.
    """
    if "bucket" not in stored.columns:
        return stored
    rows = keys.select(key_bucket(*keys.columns).alias("bucket")).distinct().collect()  # STORE_BUCKETS at most
    return stored.where(F.col("bucket").isin([r["bucket"] for r in rows])).drop("bucket")


def accept_in_order(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``line_no`` of the rows accepted when keys are granted in line order.

    ``wanted``: one row per key (its first line). ``held``: keys a line holds once
    accepted. A line is refused when an earlier *accepted* line holds its key. Only
    lines blocked by another line need a round; usually there are none.
    """
    pairs = [F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    earlier = F.col("h.line_no") < F.col("w.line_no")
    candidates = wanted.select("line_no")
    blocks = (
        wanted.alias("w")
        .join(held.join(candidates, "line_no", "left_semi").alias("h"), [*pairs, earlier])
        .select(F.col("w.line_no").alias("line_no"), F.col("h.line_no").alias("blocker"))
        .distinct()
    )
    blocks = materialise(blocks, "blocks")
    if blocks.isEmpty():
        return candidates
    refused = blocks.select("line_no").limit(0)
    while True:
        # A blocker is settled as accepted once nothing still open blocks it.
        open_lines = blocks.select("line_no").distinct()
        settled = blocks.join(
            open_lines.withColumnRenamed("line_no", "blocker"), "blocker", "left_anti"
        )
        newly = settled.select("line_no").distinct()
        if newly.isEmpty():
            return candidates.join(refused, "line_no", "left_anti")
        refused = materialise(refused.unionByName(newly), "refused")
        # Refused lines block nobody; their own rows are done.
        blocks = materialise(
            blocks.join(refused, "line_no", "left_anti").join(
                refused.withColumnRenamed("line_no", "blocker"), "blocker", "left_anti"
            ),
            "blocks",
        )


def check_predicate(claims: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Add ``known_predicate``. The vocabulary is a small table."""
    known = relation_types.select(
        F.col("slug").alias("predicate"), F.lit(True).alias("known_predicate")
    )
    return claims.join(known, "predicate", "left").withColumn(
        "known_predicate", F.coalesce("known_predicate", F.lit(False))
    )


def resolve_refs(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``subject_entity_id`` and ``object_entity_id``, NULL when unresolved."""
    def side(name: str) -> DataFrame:
        return anchors.select(
            F.col("authority").alias(f"{name}_authority"),
            F.col("external_id").alias(f"{name}_key"),
            F.col("entity_id").alias(f"{name}_entity_id"),
        )

    return claims.join(side("subject"), ["subject_authority", "subject_key"], "left").join(
        side("object"), ["object_authority", "object_key"], "left"
    )


def _unresolved(name: str) -> Column:
    ref = F.concat(F.col(f"{name}_authority"), F.lit(":"), F.col(f"{name}_key"))
    return F.concat(F.lit(f"unresolvable {name} ref "), ref)


def reject_reason() -> Column:
    """First failure in the order predicate, subject, object; NULL when none."""
    return (
        F.when(
            ~F.col("known_predicate"),
            F.concat(F.lit("unknown predicate '"), F.col("predicate"), F.lit("'")),
        )
        .when(F.col("subject_entity_id").isNull(), _unresolved("subject"))
        .when(
            F.col("object_key").isNotNull() & F.col("object_entity_id").isNull(),
            _unresolved("object"),
        )
    )


def schema_reason() -> Column:
    first = F.get("errors", F.lit(0))
    return F.when(first == "invalid JSON", first).otherwise(F.concat(F.lit("schema: "), first))


def classify_lines(lines: DataFrame, relation_types: DataFrame, anchors: DataFrame) -> DataFrame:
    """Parsed and resolved lines, each with the ``reason`` it fails for, or NULL.

    ``lines``: ``line_no`` (order in the batch, blank lines not counted) and ``line``.
    """
    parsed = parse_claims(validate_claims(lines))
    if "bucket" in anchors.columns:
        parsed = materialise(parsed, "parsed-lines")
        refs = F.array(*[F.struct(F.col(f"{n}_authority").alias("authority"), F.col(f"{n}_key").alias("external_id")) for n in ("subject", "object")])
        anchors = opened(anchors, parsed.select(F.inline(refs)))
    resolved = resolve_refs(check_predicate(parsed, relation_types), anchors)
    return resolved.withColumn("reason", F.coalesce(schema_reason(), reject_reason())).drop(
        "errors", "known_predicate"
    )


def split_rejects(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims that go on, and ``line_no, reason`` of the lines that do not."""
    good = classified.where(F.col("reason").isNull()).drop("reason")
    return good, classified.where(F.col("reason").isNotNull()).select("line_no", "reason")


def import_entities(
    lines: DataFrame, anchors: DataFrame, batch_no: int
) -> dict[str, DataFrame]:
    """New entities with their anchors, duplicates and rejects of an entity batch.

    A reference some earlier entity already answers to is a duplicate. Declared
    anchors that are taken are ignored.
    """
    checked = validate_entities(lines)
    rejects = checked.where(F.size("errors") > 0).select(
        "line_no", schema_reason().alias("reason")
    )
    parsed = parse_entities(checked)
    ref = ["authority", "external_id"]
    fresh = parsed.join(anchors, ref, "left_anti")
    wanted = first_per_key(fresh, ref, "line_no")
    held = wanted.select("line_no", F.explode("anchors").alias("_a")).select(
        "line_no", F.col("_a.authority").alias("authority"), F.col("_a.id").alias("external_id")
    )
    created = wanted.join(accept_in_order(wanted, held, ref), "line_no", "left_semi")
    entities = created.select(line_id(batch_no, F.col("line_no")).alias("entity_id"), "entity_type", "line_no")
    new_anchors = first_per_key(
        held.join(created.select("line_no"), "line_no", "left_semi"), ref, "line_no"
    ).join(anchors, ref, "left_anti")
    return {
        "entities": entities.drop("line_no"),
        "anchors": new_anchors.select(*ref, line_id(batch_no, F.col("line_no")).alias("entity_id")),
        "created_lines": entities.select("line_no"),
        "duplicates": parsed.join(created, "line_no", "left_anti").select("line_no"),
        "rejects": rejects,
    }


def support_rows(claims: DataFrame) -> DataFrame:
    """One row per claim line and supporting record, position 0 being the primary."""
    return claims.select("line_no", F.posexplode("support").alias("position", "_s")).select(
        "line_no", "position", "_s.*"
    )


def upsert_sources(support: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources named for the first time: licence unconfirmed, version unknown."""
    return (
        support.select(F.col("source").alias("slug"))
        .distinct()
        .join(sources, "slug", "left_anti")
        .select(
            "slug",
            F.col("slug").alias("title"),
            F.lit("unknown").alias("version"),
            F.lit(None).cast("string").alias("retrieval_uri"),
            F.lit(None).cast("string").alias("license"),
            F.lit(False).alias("license_confirmed"),
        )
    )


def record_id(of: Column | None = None) -> Column:
    """Key of a source record (columns, or a struct of them): its natural key and content, hashed to 128 bits."""
    parts = [F.col(n) if of is None else of[n].alias(n) for n in (*RECORD_KEY, "content_hash")]
    return F.md5(F.to_json(F.struct(*parts)).cast("binary"))


def version_records(
    support: DataFrame, existing: DataFrame, batch_no: int
) -> tuple[DataFrame, DataFrame]:
    """New source records, and the outcome of every support row.

    Same key and content is a duplicate. New content under a known key supersedes the
    version that arrived last. ``existing``: record columns with ``source_record_id``
    and ``arrival``; only records whose keys the batch names take part, so a small batch does not
    shuffle the store.
    """
    arrival = line_id(batch_no, F.col("line_no"))
    rows = support.withColumns({"source_record_id": record_id(), "arrival": arrival})
    # The winners first, by their places alone; their records are fetched afterwards. A place is one number, lines
    # being under 2**40, so the least of them is found by hash and nothing is sorted for it.
    step = 1 << 23
    fits = (F.col("line_no") >= 0) & (F.col("line_no") < F.lit(1 << 40)) & (F.col("position") < step)
    order = F.when(fits, F.col("line_no").cast("long") * step + F.col("position")).otherwise(
        F.raise_error(F.lit("line_no or position is out of range")).cast("long")
    )
    place = ["line_no", "position"]  # of one row only; the ids, which say the key once more, are made after the join
    winners = rows.groupBy("source_record_id").agg(F.min(order).alias("_w")).select(
        F.shiftright("_w", 23).alias("line_no"), F.col("_w").bitwiseAND(F.lit(step - 1)).cast("int").alias("position")
    )
    firsts = support.join(winners, place, "left_semi").select(
        record_id().alias("source_record_id"), *place, *RECORD_KEY, "content_hash", "raw", arrival.alias("arrival")
    )
    existing = opened(existing, rows.select(*RECORD_KEY))
    held = existing.select("source_record_id", *RECORD_KEY, "arrival").join(
        rows.select(*RECORD_KEY).distinct(), RECORD_KEY, "left_semi"
    )
    # Written before the chain is told, which reads them twice.
    new = materialise(firsts.join(held.select("source_record_id"), "source_record_id", "left_anti"), "new-records")
    last_known = held.groupBy(*RECORD_KEY).agg(
        F.max_by("source_record_id", "arrival").alias("_known")
    )
    chained = carry_before(
        new, RECORD_KEY, sequence_bucket("line_no"), ["line_no", "position"],
        {"_prior": F.col("source_record_id")},
    )
    records = (
        chained.join(last_known, RECORD_KEY, "left")
        .withColumn("supersedes_record_id", F.coalesce("_prior", "_known"))
        .select(
            "source_record_id", *RECORD_KEY, "content_hash", "raw", "arrival",
            "supersedes_record_id", "line_no", "position",
        )
    )
    records = materialise(records, "records")  # also what the outcomes are told by
    first_use = records.select(
        *place,
        F.when(F.col("supersedes_record_id").isNull(), F.lit("INSERTED"))
        .otherwise(F.lit("SUPERSEDED"))
        .alias("_outcome"),
    )
    outcomes = rows.select(*place, "source_record_id").join(first_use, place, "left").select(
        *place, "source_record_id",
        F.coalesce("_outcome", F.lit("DUPLICATE")).alias("outcome"),
    )
    return records.drop("line_no", "position"), outcomes


def stored_identities(claim: DataFrame, support: DataFrame) -> DataFrame:
    """``claim_id``, what makes it the same claim, and each record it rests on."""
    return claim.select("claim_id", *IDENTITY).join(support.select("claim_id", "source_record_id"), "claim_id")


def dedupe_claims(
    claims: DataFrame, outcomes: DataFrame, claim: DataFrame, support: DataFrame
) -> DataFrame:
    """Claims not imported before: neither in the store nor earlier in the batch.

    A claim repeats another when it agrees on :data:`IDENTITY` and its primary record
    supports that other claim. The inner pair of bounds is not compared.
    """
    primary = outcomes.where(F.col("position") == 0).select("source_record_id").distinct()
    # Only stored claims that rest on a record of the batch can be repeated.
    touching = support.join(primary, "source_record_id", "left_semi")
    return dedupe_by_identity(claims, outcomes, stored_identities(claim, touching))


def dedupe_by_identity(claims: DataFrame, outcomes: DataFrame, identities: DataFrame) -> DataFrame:
    """:func:`dedupe_claims` on the store's table of identities, of which only the parts that the batch names are read."""
    key = IDENTITY + ["source_record_id"]
    # The primary record is the first that a line names, so a claim need not be joined with it.
    keyed = claims.where(F.size("support") > 0).withColumn("source_record_id", record_id(F.get("support", F.lit(0))))
    stored = opened(identities, keyed.select("source_record_id"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    fresh = keyed.alias("n").join(stored.alias("s"), same, "left_anti")
    # Written, being read for what its lines hold and once more for what is accepted.
    wanted = materialise(fresh.groupBy(*key).agg(F.min("line_no").alias("line_no")), "wanted")
    further = outcomes.where(F.col("position") > 0).select("line_no", "source_record_id")
    held = wanted.drop("source_record_id").join(further, "line_no").select("line_no", *key)
    accepted = accept_in_order(wanted, held, key)
    return claims.join(accepted, "line_no", "left_semi")


def append_claims(
    claims: DataFrame, batch_no: int, agent_id: int, run_id: str, recorded_at: Column
) -> DataFrame:
    """Store rows of accepted claims."""
    return claims.select(
        line_id(batch_no, F.col("line_no")).alias("claim_id"),
        "subject_entity_id",
        "predicate",
        "object_entity_id",
        "object_literal",
        *BOUNDS,
        "approximate",
        "valid_time_original",
        "confidence_kind",
        "confidence_point",
        "confidence_scale",
        "confidence_raw",
        "method",
        "method_detail",
        F.lit(agent_id).cast("long").alias("asserted_by_agent_id"),
        F.lit(run_id).alias("import_run_id"),
        recorded_at.alias("recorded_at"),
    )


def support_links(claims: DataFrame, batch_no: int) -> DataFrame:
    """``claim_id, source_record_id``, each pair once. All records of a claim stand in its own line."""
    return claims.select(
        line_id(batch_no, F.col("line_no")).alias("claim_id"),
        F.explode(F.array_distinct(F.transform("support", record_id))).alias("source_record_id"),
    )


def claim_identities(claims: DataFrame, batch_no: int) -> DataFrame:
    """:func:`stored_identities` of accepted claims, all of which stand in their own lines, so nothing is joined."""
    return claims.select(
        line_id(batch_no, F.col("line_no")).alias("claim_id"), *IDENTITY,
        F.explode(F.array_distinct(F.transform("support", record_id))).alias("source_record_id"),
    )


def assert_events(claims: DataFrame) -> DataFrame:
    """One assert event per new claim (``claims``: store rows). Ids name their writer, here the import."""
    return claims.select(
        F.concat_ws("-", F.lit("assert"), "claim_id").alias("id"),
        "claim_id",
        F.lit("assert").alias("event_type"),
        F.col("recorded_at").alias("occurred_at"),
        F.col("asserted_by_agent_id").alias("actor_agent_id"),
        F.lit("{}").alias("payload"),
    )


def initial_confidence(claims: DataFrame) -> DataFrame:
    """Current confidence of new claims: the source's, also when it gave none."""
    return claims.select(
        "claim_id",
        "confidence_point",
        F.lit("source").alias("origin"),
        F.lit(None).cast("string").alias("calibration_run_id"),
    )


@dataclass
class Store:
    """The tables an import reads and adds to."""

    relation_types: DataFrame
    anchors: DataFrame
    sources: DataFrame
    records: DataFrame
    claims: DataFrame | None = None
    support: DataFrame | None = None
    identities: DataFrame | None = None  # instead of claims and support


def import_claims(
    lines: DataFrame,
    store: Store,
    *,
    batch_no: int,
    agent_id: int,
    run_id: str,
    recorded_at: Column,
    check_duplicates: bool = True,
) -> dict[str, DataFrame]:
    """Everything one claim batch adds, as frames to append.

    The parsed batch is written once and read by each of the outputs; a failing line
    never stops the others. With ``check_duplicates=False`` every valid line becomes
    a claim.
    """
    classified = classify_lines(lines, store.relation_types, store.anchors)
    good, rejects = split_rejects(materialise(classified, "parsed"))
    support = support_rows(good)
    records, outcomes = version_records(support, store.records, batch_no)
    outcomes = materialise(outcomes, "outcomes")
    if not check_duplicates:
        accepted = good
    elif store.identities is not None:
        accepted = dedupe_by_identity(good, outcomes, store.identities)
    else:
        accepted = dedupe_claims(good, outcomes, store.claims, store.support)
    accepted = materialise(accepted, "accepted")
    claims = append_claims(accepted, batch_no, agent_id, run_id, recorded_at)
    return {
        "sources": upsert_sources(support, store.sources),
        "records": records,
        "claims": claims,
        "support": support_links(accepted, batch_no),
        "identities": claim_identities(accepted, batch_no),
        "events": assert_events(claims),
        "confidence": initial_confidence(claims),
        "rejects": rejects,
        "report": import_report(lines, good, accepted, outcomes, rejects),
    }


def import_report(
    lines: DataFrame, good: DataFrame, accepted: DataFrame, outcomes: DataFrame, rejects: DataFrame
) -> DataFrame:
    """One row of totals. ``superseded`` counts records, also those of duplicate claims."""
    def tally(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    superseded = outcomes.where(F.col("outcome") == "SUPERSEDED")
    parts = (
        tally("received", lines)
        .unionByName(tally("good", good))
        .unionByName(tally("inserted", accepted))
        .unionByName(tally("superseded", superseded))
        .unionByName(tally("rejected", rejects))
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0))

    return parts.agg(
        total("received").alias("received"),
        total("inserted").alias("inserted"),
        (total("good") - total("inserted")).alias("duplicates"),
        total("superseded").alias("superseded"),
        total("rejected").alias("rejected"),
    )


def tally_runs(batches: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Run totals over the append-only batch log, with the run's manifest if there is one.

    ``batches``: ``run_id, source_slug, started_at`` and the report columns.
    """
    runs = batches.groupBy("run_id").agg(
        F.min_by("source_slug", "started_at").alias("source_slug"),
        F.min("started_at").alias("started_at"),
        F.count("*").alias("batches"),
        *[F.sum(c).alias(c) for c in REPORT],
    )
    if manifests is None:
        return runs
    return runs.join(manifests.select("run_id", "manifest"), "run_id", "left")
