"""Queries for search, read models, streams, actions and statistics: N, P, T, A, C."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import trigram_similarity, trigrams
from claimgraph.operators import actions as acts
from claimgraph.operators import models, search, stats
from claimgraph.operators.ingest import tally_runs
from claimgraph.plans.corpus import Corpus, attribute_id
from claimgraph.plans.oracle import BAND, UNDATED, oracle
from claimgraph.plans.registry import query
from claimgraph.session import fresh_path, materialise
from claimgraph.sources.runs import RunLog
from claimgraph.streaming import projection

# Search ----------------------------------------------------------------------
NAME_ROWS = """SELECT claim_id, subject_entity_id AS entity_id, value AS name, name_kind
 FROM current_attributes WHERE predicate='has-name' AND status='asserted'"""
GRAMS = """SELECT DISTINCT t, substr('  '||w||' ', CAST(i AS INTEGER), 3) AS g FROM
 (SELECT t, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS w FROM texts), unnest(range(1, length(w)+2)) AS r(i) WHERE w<>''"""
ASKED = """SELECT DISTINCT split_part(p_name,' ',1) AS q FROM part UNION SELECT DISTINCT lower(substr(p_type,1,2)) FROM part
 UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT lower(p_type)||' '||p_brand FROM part"""
SEARCH = {
    "namerow": NAME_ROWS,
    "asked": ASKED,
    "texts": "SELECT q AS t FROM asked UNION SELECT name FROM namerow",
    "gram": GRAMS,
    "sizes": "SELECT t, count(*) AS n FROM gram GROUP BY t",
    "shared": """SELECT a.t AS q, b.t AS name, count(*) AS k FROM gram a JOIN gram b ON a.g=b.g
 WHERE a.t IN (SELECT q FROM asked) AND b.t IN (SELECT name FROM namerow) GROUP BY 1,2""",
    "sims": """SELECT q.q, n.name, coalesce(k,0)/(coalesce(sa.n,0)+coalesce(sb.n,0)-coalesce(k,0)) AS similarity
 FROM asked q JOIN (SELECT DISTINCT name FROM namerow) n ON true LEFT JOIN shared s ON s.q=q.q AND s.name=n.name
 LEFT JOIN sizes sa ON sa.t=q.q LEFT JOIN sizes sb ON sb.t=n.name""",
    "hits": "SELECT * FROM sims WHERE similarity>=0.3 OR contains(lower(name), lower(q))",
}


def asked(c: Corpus) -> DataFrame:
    """Search texts found in the part table: words, prefixes, names, type and brand."""
    part = c.table("part")
    texts = F.array(
        F.split("p_name", " ")[0],
        F.lower(F.substring("p_type", 1, 2)),
        F.col("p_name"),
        F.concat(F.lower("p_type"), F.lit(" "), F.col("p_brand")),
    )
    return part.select(F.explode(texts).alias("q")).distinct()


def name_rows(c: Corpus) -> DataFrame:
    return models.rebuild_name_search(c.current_attributes)


@query(
    "n01_trigrams",
    oracle(
        "SELECT t AS name, g AS gram FROM gram",
        {"namerow": NAME_ROWS, "texts": "SELECT DISTINCT name AS t FROM namerow", "gram": GRAMS},
    ),
)
def _(c: Corpus) -> DataFrame:
    names = name_rows(c).select("name").distinct()
    return names.select("name", F.explode(trigrams(F.col("name"))).alias("gram"))


@query(
    "n01b_trigram_similarity",
    oracle(
        """SELECT p_partkey, round(coalesce((SELECT count(*) FROM gram x JOIN gram y ON x.g=y.g WHERE x.t=p_name AND y.t=other),0)
 /((SELECT count(*) FROM gram WHERE t=p_name)+(SELECT count(*) FROM gram WHERE t=other)
 -coalesce((SELECT count(*) FROM gram x JOIN gram y ON x.g=y.g WHERE x.t=p_name AND y.t=other),0)),9) AS similarity
 FROM (SELECT p_partkey, p_name, lower(p_type)||' '||split_part(p_name,' ',2) AS other FROM part)""",
        {
            "texts": "SELECT p_name AS t FROM part UNION SELECT lower(p_type)||' '||split_part(p_name,' ',2) FROM part",
            "gram": GRAMS,
        },
    ),
)
def _(c: Corpus) -> DataFrame:
    other = F.concat(F.lower("p_type"), F.lit(" "), F.split("p_name", " ")[1])
    return c.table("part").select(
        "p_partkey", F.round(trigram_similarity(F.col("p_name"), other), 9).alias("similarity")
    )


@query("n02_match_names", oracle("SELECT q, name, round(similarity,9) AS similarity FROM hits", SEARCH))
def _(c: Corpus) -> DataFrame:
    return search.match_names(asked(c), name_rows(c)).withColumn("similarity", F.round("similarity", 9))


@query("n02b_match_on_kept_index", oracle("SELECT q, name, round(similarity,9) AS similarity FROM hits", SEARCH))
def _(c: Corpus) -> DataFrame:
    """The same matches from a published index, built from half of the entities and brought up to date with the rest."""
    log, names = RunLog(c.spark, fresh_path(c.spark, "index")), name_rows(c)
    half = F.pmod(F.abs("entity_id"), F.lit(2)) == 0
    search.publish_names(log, "base", names.where(half))
    search.publish_names(log, "increment", names.where(~half))
    return search.match_published(log, asked(c)).withColumn("similarity", F.round("similarity", 9))


@query(
    "n03_search_entities",
    oracle(
        """SELECT q, entity_id, similarity, CAST(rank AS INTEGER) AS rank, n>15 AS more FROM (SELECT q, entity_id, similarity,
 row_number() OVER (PARTITION BY q ORDER BY similarity DESC, entity_id) AS rank, count(*) OVER (PARTITION BY q) AS n FROM (
 SELECT h.q, r.entity_id, max(round(h.similarity,9)) AS similarity FROM hits h JOIN namerow r ON r.name=h.name
 JOIN ent e ON e.entity_id=r.entity_id WHERE e.entity_type='document' GROUP BY 1,2)) WHERE rank>5 AND rank<=15""",
        SEARCH,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Second page of documents for every search text."""
    page = search.search_entities(asked(c), name_rows(c), c.summary, "document", offset=5, limit=10)
    return page.select("q", "entity_id", F.round("similarity", 9).alias("similarity"), "rank", "more")


# Read models -------------------------------------------------------------------
@query(
    "p01_display_names",
    oracle("SELECT entity_id, display_name, name_claim_id FROM summary"),
)
def _(c: Corpus) -> DataFrame:
    return models.display_names(c.current_attributes, c.entities)


@query("p02_first_literal", oracle("SELECT entity_id, gender AS value FROM facts WHERE gender IS NOT NULL"))
def _(c: Corpus) -> DataFrame:
    return models.first_literal(c.current_attributes, "has-gender")


@query(
    "p03_life_bounds",
    oracle("""SELECT entity_id, born_earliest, born_latest, died_earliest, died_latest FROM facts
 WHERE born_earliest IS NOT NULL OR died_earliest IS NOT NULL"""),
)
def _(c: Corpus) -> DataFrame:
    return models.life_bounds(c.current_attributes)


@query("p04_degrees", oracle("SELECT entity_id, degree_scored, degree_unscored FROM deg"))
def _(c: Corpus) -> DataFrame:
    return models.degrees(c.claims)


@query("p05_entity_summary", oracle("SELECT * FROM summary"))
def _(c: Corpus) -> DataFrame:
    return c.summary


@query("p06_name_search", oracle("SELECT * FROM namerow", {"namerow": NAME_ROWS}))
def _(c: Corpus) -> DataFrame:
    return name_rows(c)


CHANGES = "SELECT DISTINCT claim_id FROM user_events WHERE event_type IN ('dispute','supersede')"


def changes(c: Corpus) -> DataFrame:
    """Claims disputed or superseded, and every supplier entity."""
    disputed = c.user_events.where(F.col("event_type").isin("dispute", "supersede")).select(
        F.lit("claim").alias("aggregate"), F.col("claim_id").alias("aggregate_id")
    )
    suppliers = c.entities.where(F.col("entity_type") == "organization").select(
        F.lit("entity").alias("aggregate"), F.col("entity_id").cast("string").alias("aggregate_id")
    )
    return disputed.unionByName(suppliers)


TOUCHED = """SELECT subject_entity_id AS entity_id FROM attributes WHERE claim_id IN (SELECT claim_id FROM changed)
 UNION SELECT object_entity_id FROM attributes WHERE claim_id IN (SELECT claim_id FROM changed) AND object_entity_id IS NOT NULL
 UNION SELECT entity_id FROM ent WHERE entity_type='organization'"""


@query("p07_touched_entities", oracle(f"SELECT entity_id FROM ({TOUCHED})", {"changed": CHANGES}))
def _(c: Corpus) -> DataFrame:
    return models.touched_entities(changes(c), c.claims)


@query("p08_refresh_entities", oracle("SELECT * FROM summary"))
def _(c: Corpus) -> DataFrame:
    """A summary stale for all touched entities, refreshed: equals the full rebuild."""
    c.keep()
    touched = materialise(models.touched_entities(changes(c), c.claims), "touched")
    marked = c.summary.join(touched.withColumn("_touched", F.lit(True)), "entity_id", "left")
    name = F.when(F.col("_touched"), F.lit("stale")).otherwise(F.col("display_name"))
    stale = marked.withColumn("display_name", name).drop("_touched")
    return models.refresh_entities(stale, c.entities, c.claims, touched)


# Streams -------------------------------------------------------------------------
@query("t01_projection", oracle(f"SELECT * FROM summary WHERE entity_id IN ({TOUCHED})", {"changed": CHANGES}))
def _(c: Corpus) -> DataFrame:
    """The change feed drained as a stream; the summaries it published."""
    feed, target = fresh_path(c.spark, "feed"), fresh_path(c.spark, "published")
    changes(c).write.parquet(feed)
    stream = projection.read_feed(c.spark, feed, "aggregate string, aggregate_id string")
    run = projection.start_projection(
        stream, lambda: Corpus(c.spark, c.sf_dir).entities, lambda: Corpus(c.spark, c.sf_dir).claims,
        target, fresh_path(c.spark, "progress"),
    )
    run.awaitTermination()
    return projection.latest_versions(c.spark, target, "entity_id").select(*c.summary.columns)


@query("t02_stream_status", oracle("SELECT claim_id, status FROM attribute_status"))
def _(c: Corpus) -> DataFrame:
    """The event log folded as a stream; the statuses it published."""
    log, target = fresh_path(c.spark, "log"), fresh_path(c.spark, "statuses")
    c.attribute_events.repartition(4).write.parquet(log)
    stream = projection.read_feed(c.spark, log, c.attribute_events.schema, files_per_trigger=2)
    projection.stream_status(stream, target, fresh_path(c.spark, "progress")).awaitTermination()
    return projection.latest_versions(c.spark, target, "claim_id")


@query(
    "t03_feed_lag",
    """SELECT count(*) AS pending, CAST(date_diff('microsecond', min(ts), (SELECT max(ts) FROM events)) // 1000000 AS BIGINT) AS oldest_age_seconds
 FROM events WHERE event_type='error'""",
)
def _(c: Corpus) -> DataFrame:
    """Events not handled yet, taking all but errors as handled."""
    events = c.table("events")
    feed = events.select(F.col("event_id").alias("change_id"), F.col("ts").alias("changed_at"))
    done = events.where(F.col("event_type") != "error").select(F.col("event_id").alias("change_id"))
    return projection.feed_lag(feed, done, events.agg(F.max("ts")).scalar())


# Actions -----------------------------------------------------------------------
def action_rows(c: Corpus) -> DataFrame:
    """User events read as governed actions, legal and illegal alike."""
    kind, number = F.col("event_type"), F.col("event_id")
    grounds = F.array(*[F.lit(g) for g in ("existence", "dating", "confidence", "source-reading", "rumour")])
    return c.table("events").select(
        number.alias("seq"),
        F.when(kind.isin("error", "signup"), "dispute")
        .when(kind == "view", "undispute")
        .when((kind == "click") & (number % 97 == 0), "supersede")
        .otherwise("adjust_confidence")
        .alias("kind"),
        attribute_id(F.col("user_id"), number % 10).alias("claim_id"),
        F.when(kind == "signup", F.lit("identity"))
        .when(kind == "error", F.element_at(grounds, (number % 5 + 1).cast("int")))
        .alias("ground"),
        F.concat(F.lit("event "), number.cast("string")).alias("reason"),
        F.when((kind != "purchase") | (number % 13 != 0), F.round(F.col("value") / 300, 2)).alias("point"),
        (F.col("user_id") % 25).alias("agent_id"),
        F.col("ts").alias("occurred_at"),
        F.when(number % 29 == 0, "1990-01-01").alias("as_of"),
    )


ACTIONS = {
    "acts": """SELECT event_id AS seq, CASE WHEN event_type IN ('error','signup') THEN 'dispute' WHEN event_type='view' THEN 'undispute'
 WHEN event_type='click' AND event_id%97=0 THEN 'supersede' ELSE 'adjust_confidence' END AS kind,
 'a-'||user_id||'-'||(event_id%10) AS claim_id, CASE WHEN event_type='signup' THEN 'identity' WHEN event_type='error' THEN
 (['existence','dating','confidence','source-reading','rumour'])[event_id%5+1] END AS ground,
 CASE WHEN event_type<>'purchase' OR event_id%13<>0 THEN round(value/300,2) END AS point, event_id%29=0 AS past FROM events""",
    "opening": """SELECT claim_id, CASE right(claim_id,1) WHEN '5' THEN 'superseded' WHEN '4' THEN 'disputed' ELSE 'asserted' END AS status FROM attributes""",
    "live": "SELECT a.*, o.status FROM acts a LEFT JOIN opening o USING (claim_id) WHERE NOT past",
    "seen": """SELECT *, coalesce(bool_or(kind='supersede') OVER w, false) OR coalesce(status='superseded',false) AS gone,
 coalesce(last_value(CASE WHEN kind='undispute' OR (kind='dispute' AND ground NOT IN ('identity','rumour')) THEN kind END IGNORE NULLS) OVER w='dispute', status='disputed') AS flagged
 FROM live WINDOW w AS (PARTITION BY claim_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "verdict": """SELECT *, CASE WHEN status IS NULL THEN 'no such claim'
 WHEN kind='dispute' AND ground='rumour' THEN 'unknown ground' WHEN kind='dispute' AND gone THEN 'claim is superseded'
 WHEN kind='undispute' AND (gone OR NOT flagged) THEN 'claim is not disputed'
 WHEN kind='adjust_confidence' AND point IS NULL THEN 'a numeric point is needed'
 WHEN kind='adjust_confidence' AND (point<0 OR point>1) THEN 'point is outside [0, 1]'
 WHEN kind='supersede' AND gone THEN 'claim is superseded' END AS refusal FROM seen""",
}


def opening_status(c: Corpus) -> DataFrame:
    slot = F.right("claim_id", F.lit(1))
    return c.attributes.select(
        "claim_id",
        F.when(slot == "5", "superseded").when(slot == "4", "disputed").otherwise("asserted").alias("status"),
    )


def judged(c: Corpus) -> DataFrame:
    live, _ = acts.refuse_time_travel(action_rows(c))
    return acts.judge(live, opening_status(c))


def both_sides(sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Events and refusals of one kind of action as one frame."""
    events, refused = sides
    accepted = events.select(
        F.substring_index("id", "-", -1).cast("long").alias("seq"), "claim_id", F.col("event_type").alias("kind"),
        F.lit(None).cast("string").alias("refusal"),
    )
    return accepted.unionByName(refused.select("seq", "claim_id", "kind", "refusal"))


def verdict_sql(kind: str) -> str:
    return oracle(
        f"SELECT seq, claim_id, kind, refusal FROM verdict WHERE kind='{kind}' AND (refusal IS NOT NULL OR coalesce(ground,'')<>'identity')",
        ACTIONS,
    )


@query("a01_dispute", verdict_sql("dispute"))
def _(c: Corpus) -> DataFrame:
    return both_sides(acts.dispute(judged(c)))


@query(
    "a02_route_identity",
    oracle(
        """SELECT entity_a, entity_b, score, features, state FROM (
 SELECT CAST(coalesce(q.a, n.a) AS VARCHAR) AS entity_a, CAST(coalesce(q.b, n.b) AS VARCHAR) AS entity_b, coalesce(q.score,0) AS score,
 coalesce(n.features, q.features) AS features, coalesce(q.state,'queued') AS state FROM
 (SELECT c_custkey AS a, c_custkey+1 AS b, CAST(0.5 AS DOUBLE) AS score, '{}' AS features, 'accepted' AS state FROM customer WHERE c_custkey%10 IN (0,1)) q
 FULL JOIN (SELECT a, b, arg_max('{"reason":"event '||seq||'","sourceClaim":"'||claim_id||'","routedFrom":"dispute"}', seq) AS features FROM
  (SELECT seq, claim_id, least(subject_entity_id,object_entity_id) AS a, greatest(subject_entity_id,object_entity_id) AS b
   FROM verdict JOIN attributes USING (claim_id) WHERE kind='dispute' AND ground='identity' AND refusal IS NULL AND object_entity_id IS NOT NULL)
  GROUP BY a,b) n ON n.a=q.a AND n.b=q.b)
 UNION ALL SELECT CAST(seq AS VARCHAR), claim_id, NULL, 'identity ground applies to relationship claims', 'refused'
 FROM verdict JOIN attributes USING (claim_id) WHERE kind='dispute' AND ground='identity' AND refusal IS NULL AND object_entity_id IS NULL""",
        ACTIONS,
    ),
)
def _(c: Corpus) -> DataFrame:
    """The review queue after identity disputes, refused rows appended."""
    key = F.col("c_custkey")
    queue = c.table("customer").where((key % 10).isin(0, 1)).select(
        key.alias("entity_a"), (key + 1).alias("entity_b"), F.lit(0.5).alias("score"),
        F.lit("{}").alias("features"), F.lit("accepted").alias("state"),
    )
    merged, refused = acts.route_identity(judged(c), c.attributes, queue)
    text = {k: F.col(k).cast("string") for k in ("entity_a", "entity_b")}
    return merged.withColumns(text).unionByName(
        refused.select(
            F.col("seq").cast("string").alias("entity_a"), F.col("claim_id").alias("entity_b"),
            F.lit(None).cast("double").alias("score"), F.col("refusal").alias("features"),
            F.lit("refused").alias("state"),
        )
    )


@query("a03_undispute", verdict_sql("undispute"))
def _(c: Corpus) -> DataFrame:
    return both_sides(acts.undispute(judged(c)))


@query("a04_adjust_confidence", verdict_sql("adjust_confidence"))
def _(c: Corpus) -> DataFrame:
    return both_sides(acts.adjust_confidence(judged(c)))


@query(
    "a07_merge_entities",
    """SELECT c_nationkey AS group_id, c_custkey AS entity_id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical_id, c_mktsegment
 FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) >= 2""",
)
def _(c: Corpus) -> DataFrame:
    """Customers of one nation and segment merged, alone-standing ones refused."""
    group = F.concat_ws("/", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))
    members = c.table("customer").select(group.alias("group_id"), F.col("c_custkey").alias("entity_id"))
    accepted, _ = acts.merge_entities(members)
    parts = F.split("group_id", "/")
    return accepted.select(
        parts[0].cast("int").alias("group_id"), "entity_id", "canonical_id", parts[1].alias("c_mktsegment")
    )


@query(
    "a08_lifespan_warning",
    oracle("""SELECT c_nationkey AS group_id, coalesce(max(born_earliest) > min(died_latest), false) AS warn
 FROM customer LEFT JOIN summary ON entity_id=c_custkey GROUP BY 1"""),
)
def _(c: Corpus) -> DataFrame:
    groups = c.table("customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("entity_id"))
    return acts.lifespan_warning(groups, c.summary)


@query(
    "a09_refuse_time_travel",
    oracle(
        "SELECT seq, kind, claim_id, CASE WHEN past THEN 'writes to a past state are refused' END AS refusal FROM acts",
        ACTIONS,
    ),
)
def _(c: Corpus) -> DataFrame:
    live, refused = acts.refuse_time_travel(action_rows(c))
    kept = live.select("seq", "kind", "claim_id", F.lit(None).cast("string").alias("refusal"))
    return kept.unionByName(refused)


# Statistics ----------------------------------------------------------------------
@query(
    "c01_entity_counts",
    oracle("SELECT entity_type AS part, count(*) AS n FROM ent GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM ent"),
)
def _(c: Corpus) -> DataFrame:
    return stats.entity_counts(c.entities)


@query(
    "c02_claim_counts",
    oracle("SELECT predicate AS part, count(*) AS n FROM claims GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM claims"),
)
def _(c: Corpus) -> DataFrame:
    return stats.claim_counts(c.claims)


@query(
    "c03_record_counts",
    oracle("SELECT s.slug AS source_slug, count(r.source_record_id) AS records FROM src s LEFT JOIN rec r USING (source_id) GROUP BY 1"),
)
def _(c: Corpus) -> DataFrame:
    return stats.record_counts(c.records, c.sources)


@query(
    "c04_registries",
    oracle("""SELECT 'source' AS registry, slug, title AS label, CAST(license_confirmed AS VARCHAR) AS detail FROM src
 UNION ALL SELECT 'agent', slug, display_name, kind FROM agt
 UNION ALL SELECT 'relation_type', s, replace(s,'-',' '), CASE WHEN s IN ('associated-with','corresponded-with','same-as') THEN 'entity' ELSE 'literal' END
 FROM (VALUES ('associated-with'),('corresponded-with'),('same-as'),('has-name'),('born'),('died'),('has-gender'),('has-description'),('has-external-id')) v(s)"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.registries(c.sources, c.relation_types, c.agents)


@query(
    "c05_confidence_histogram",
    oracle(f"""SELECT b AS band, count(claim_id) AS ties FROM
 (VALUES ('very_strong'),('strong'),('moderate'),('weak'),('very_weak'),('unscored')) v(b)
 LEFT JOIN (SELECT claim_id, {BAND} AS band FROM rels) r ON r.band=b GROUP BY 1"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.confidence_histogram(c.claims)


BATCHES = {
    "batch": """SELECT 'run-'||year(o_orderdate) AS run_id, lower(min(o_orderpriority)) AS source_slug,
 date_trunc('month', o_orderdate) AS started_at, count(*) AS received, count(*) FILTER (o_orderstatus='F') AS inserted,
 count(*) FILTER (o_orderstatus='O') AS duplicates, count(*) FILTER (o_orderpriority LIKE '1%') AS superseded,
 count(*) FILTER (o_orderstatus='P') AS rejected FROM orders GROUP BY year(o_orderdate), date_trunc('month', o_orderdate)""",
    "counters": """SELECT import_run_id AS run_id, count(*) FILTER (inverted) AS dropped, count(*) FILTER (approximate) AS circa
 FROM (SELECT 'run-'||year(se0) AS import_run_id, inverted, approximate FROM ties) GROUP BY 1""",
}


def batches(c: Corpus) -> DataFrame:
    """Months of orders read as the batch log of yearly import runs."""
    status = F.col("o_orderstatus")
    month = F.trunc("o_orderdate", "month")
    return (
        c.table("orders")
        .groupBy(F.year("o_orderdate").alias("_y"), month.alias("_m"))
        .agg(
            F.lower(F.min("o_orderpriority")).alias("source_slug"),
            F.count("*").alias("received"),
            F.count_if(status == "F").alias("inserted"),
            F.count_if(status == "O").alias("duplicates"),
            F.count_if(F.col("o_orderpriority").startswith("1")).alias("superseded"),
            F.count_if(status == "P").alias("rejected"),
        )
        .withColumn("run_id", F.concat(F.lit("run-"), F.col("_y").cast("string")))
        .withColumn("started_at", F.col("_m").cast("timestamp_ntz"))
        .drop("_y", "_m")
    )


def manifests(c: Corpus) -> DataFrame:
    """Manifests of the yearly runs, counting dropped and circa intervals."""
    counted = c.ties.groupBy(F.col("import_run_id").alias("run_id")).agg(
        F.count_if("inverted").alias("dropped"), F.count_if("approximate").alias("circa")
    )
    counters = F.struct("dropped", "circa")
    return counted.select("run_id", F.to_json(F.struct(counters.alias("anomaly_counters"))).alias("manifest"))


@query(
    "c06_anomaly_totals",
    oracle(
        "SELECT 'dropped' AS counter, CAST(sum(dropped) AS BIGINT) AS n FROM counters UNION ALL SELECT 'circa', CAST(sum(circa) AS BIGINT) FROM counters",
        BATCHES,
    ),
)
def _(c: Corpus) -> DataFrame:
    return stats.anomaly_totals(tally_runs(batches(c), manifests(c)))


@query(
    "c07_gender_split",
    oracle("""SELECT 'male' AS gender, count(*) AS n FROM claims WHERE predicate='has-gender' AND value='male'
 UNION ALL SELECT 'female', count(*) FROM claims WHERE predicate='has-gender' AND value='female'
 UNION ALL SELECT 'unknown', greatest(0,(SELECT count(*) FROM customer)-(SELECT count(*) FROM claims WHERE predicate='has-gender'))"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.gender_split(c.claims, c.entities)


@query(
    "c08_code_share",
    oracle("""SELECT coalesce(code,'none') AS code, count(*) AS ties, round(count(*)/sum(count(*)) OVER (),9) AS share
 FROM (SELECT code FROM ties UNION ALL SELECT NULL FROM attributes WHERE object_entity_id IS NOT NULL) GROUP BY 1"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.code_share(c.claims).withColumn("share", F.round("share", 9))


@query(
    "c09_no_tie_share",
    oracle("""SELECT count(*) AS persons, count(*) FILTER (degree_scored+degree_unscored=0) AS without_ties,
 round(100.0*count(*) FILTER (degree_scored+degree_unscored=0)/count(*),6) AS percent FROM summary WHERE entity_type='person'"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.no_tie_share(c.summary).withColumn("percent", F.round("percent", 6))


@query(
    "c10_threshold_share",
    oracle("""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (confidence_point>=CAST(t AS DOUBLE)) AS at_or_above,
 round(count(*) FILTER (confidence_point>=CAST(t AS DOUBLE))/count(*),9) AS share FROM rels, (VALUES (0.6),(0.9)) v(t) GROUP BY t"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.threshold_share(c.claims).withColumn("share", F.round("share", 9))


@query(
    "c11_measured_span",
    oracle("""SELECT CAST(min(year(start_earliest)) AS INTEGER) AS first_year,
 CAST(max(year(coalesce(end_latest,start_latest))) AS INTEGER) AS last_year,
 count(*) FILTER (predicate='born' AND year(start_earliest)<1550) AS births_before,
 round(count(*) FILTER (predicate='born' AND year(start_earliest)<1550)/count(*) FILTER (predicate='born'),9) AS births_before_share,
 CAST(min(year(start_earliest)) FILTER (predicate='born') AS INTEGER) AS earliest_birth FROM claims"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.measured_span(c.claims, 1550).withColumn(
        "births_before_share", F.round("births_before_share", 9)
    )


RUNS = """SELECT run_id, arg_min(source_slug, started_at) AS source_slug, CAST(min(started_at) AS DATE) AS started_on, count(*) AS batches,
 CAST(sum(received) AS BIGINT) AS received, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(duplicates) AS BIGINT) AS duplicates,
 CAST(sum(superseded) AS BIGINT) AS superseded, CAST(sum(rejected) AS BIGINT) AS rejected FROM batch GROUP BY run_id"""


def runs(c: Corpus) -> DataFrame:
    return tally_runs(batches(c), manifests(c))


@query("c12_import_runs", oracle(RUNS, BATCHES))
def _(c: Corpus) -> DataFrame:
    return stats.import_runs(runs(c)).withColumn("started_on", F.to_date("started_at")).drop("started_at", "manifest")


@query(
    "i16_tally_runs",
    oracle(
        f"SELECT r.*, '{{\"anomaly_counters\":{{\"dropped\":'||k.dropped||',\"circa\":'||k.circa||'}}}}' AS manifest FROM runs r LEFT JOIN counters k USING (run_id)",
        BATCHES | {"runs": RUNS},
    ),
)
def _(c: Corpus) -> DataFrame:
    return runs(c).withColumn("started_on", F.to_date("started_at")).drop("started_at")


@query(
    "c13_degree_profile",
    oracle("""SELECT quantile_cont(d, 0.5) AS median, round(quantile_cont(d, 0.9),6) AS p90, count(*) FILTER (d>40) AS over_cap
 FROM (SELECT CAST(degree_scored+degree_unscored AS DOUBLE) AS d FROM summary)"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.degree_profile(c.summary, 40).withColumn("p90", F.round("p90", 6))


@query(
    "c14_empty_ego_share",
    oracle("""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (NOT coalesce(best>=CAST(t AS DOUBLE),false)) AS empty,
 round(count(*) FILTER (NOT coalesce(best>=CAST(t AS DOUBLE),false))/count(*),9) AS share FROM
 (SELECT e.entity_id, max(confidence_point) AS best FROM ent e LEFT JOIN (SELECT * FROM adj WHERE status='asserted') a USING (entity_id) GROUP BY 1),
 (VALUES (0.6),(0.9)) v(t) GROUP BY t"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.empty_ego_share(c.entities, c.claims).withColumn("share", F.round("share", 9))


BOUND_COUNTS = f"""count(*) AS ties,
 count(*) FILTER (coalesce(start_earliest,start_latest) IS NOT NULL AND coalesce(end_earliest,end_latest) IS NOT NULL) AS both_bounds,
 count(*) FILTER (coalesce(start_earliest,start_latest) IS NOT NULL AND coalesce(end_earliest,end_latest) IS NULL) AS start_only,
 count(*) FILTER (start_latest IS NOT NULL AND end_earliest IS NOT NULL) AS able_to_be_certain,
 count(*) FILTER ({UNDATED}) AS undated"""


@query("c15_bound_profile", oracle(f"SELECT {BOUND_COUNTS} FROM rels"))
def _(c: Corpus) -> DataFrame:
    return stats.bound_profile(c.claims)


@query(
    "c16_multiplicity_profile",
    oracle("""SELECT 'pair' AS grouping, count(*) AS total, count(*) FILTER (n>1) AS repeated FROM
 (SELECT count(*) AS n FROM rels GROUP BY least(subject_entity_id,object_entity_id), greatest(subject_entity_id,object_entity_id))
 UNION ALL SELECT 'subject_predicate', count(*), count(*) FILTER (n>1) FROM
 (SELECT count(*) AS n FROM claims WHERE object_entity_id IS NULL GROUP BY subject_entity_id, predicate)"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.multiplicity_profile(c.claims)


@query(
    "c17_both_figures",
    oracle(f"""SELECT 'any' AS status_filter, {BOUND_COUNTS} FROM rels
 UNION ALL SELECT 'asserted', {BOUND_COUNTS} FROM rels WHERE status='asserted'"""),
)
def _(c: Corpus) -> DataFrame:
    return stats.both_figures(stats.bound_profile, c.claims)
