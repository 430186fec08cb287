"""Queries for graph and claim reads: R operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.operators import claims as reads
from claimgraph.operators import graph
from claimgraph.operators.adjacency import Adjacency, publish_adjacency
from claimgraph.operators.paths import find_paths, path_steps
from claimgraph.plans.columns import Y98, YEAR_98
from claimgraph.plans.corpus import Corpus, supplier_id
from claimgraph.plans.oracle import BAND, UNDATED, certainly, oracle, possibly
from claimgraph.plans.registry import ORACLES, query
from claimgraph.session import fresh_path

EGO = f"""SELECT *, {certainly(*Y98)} AS certain, {UNDATED} AS undated FROM adj
 WHERE status='asserted' AND {possibly(*Y98)} AND confidence_point >= 0.6
 AND entity_id IN (SELECT c_custkey FROM customer)"""
EGO_ALL = f"""SELECT *, {certainly(*Y98)} AS certain, {UNDATED} AS undated FROM adj
 WHERE status='asserted' AND {possibly(*Y98)}"""


def customers(c: Corpus) -> DataFrame:
    return c.table("customer").select(F.col("c_custkey").alias("entity_id"))


def ego(c: Corpus, threshold: float = 0.6, include_unscored: bool = False) -> DataFrame:
    return graph.ego_network(
        c.claims, customers(c), threshold, *YEAR_98, include_unscored=include_unscored
    )


@query(
    "r01_claim_detail",
    oracle("""SELECT c.claim_id, c.predicate, c.status, c.confidence_point, a.slug AS agent_slug, a.kind AS agent_kind,
 s.display_name AS subject_name, s.entity_type AS subject_type, o.display_name AS object_name, o.entity_type AS object_type
 FROM claims c JOIN agt a ON a.agent_id=c.asserted_by_agent_id
 LEFT JOIN summary s ON s.entity_id=c.subject_entity_id LEFT JOIN summary o ON o.entity_id=c.object_entity_id"""),
)
def _(c: Corpus) -> DataFrame:
    return reads.claim_detail(c.claims, c.agents, c.summary).select(
        "claim_id", "predicate", "status", "confidence_point", "agent_slug", "agent_kind",
        "subject_name", "subject_type", "object_name", "object_type",
    )


@query(
    "r02_evidence",
    oracle("""SELECT c.claim_id, r.source_record_id, src.slug AS source_slug, src.license_confirmed, r.record_kind,
 r.external_id, r.content_hash, r.raw, s.display_name AS subject_name
 FROM claims c LEFT JOIN summary s ON s.entity_id=c.subject_entity_id
 JOIN sup u ON u.claim_id=c.claim_id JOIN rec r USING (source_record_id) JOIN src ON src.source_id=r.source_id"""),
)
def _(c: Corpus) -> DataFrame:
    detail = reads.claim_detail(c.claims, c.agents, c.summary)
    return reads.evidence(detail, c.support, c.records, c.sources).select(
        "claim_id", "source_record_id", "source_slug", "license_confirmed", "record_kind",
        "external_id", "content_hash", "raw", "subject_name",
    )


@query("r03_ego_network", oracle(f"SELECT entity_id, counterpart_id, claim_id, certain, undated FROM ({EGO})"))
def _(c: Corpus) -> DataFrame:
    return ego(c).select(
        "entity_id", "counterpart_id", "claim_id", F.col("certainly_active").alias("certain"), "undated"
    )


@query("r04_adjacency", oracle("SELECT entity_id, counterpart_id, claim_id FROM adj"))
def _(c: Corpus) -> DataFrame:
    return graph.adjacency(graph.relationships(c.claims)).select("entity_id", "counterpart_id", "claim_id")


@query(
    "r05_network_counts",
    oracle(f"""SELECT c_custkey AS entity_id, count(e.claim_id) AS possibly,
 count(e.claim_id) FILTER (NOT e.undated) AS possibly_dated, count(e.claim_id) FILTER (e.certain) AS certainly,
 count(e.claim_id) FILTER (e.undated) AS undated
 FROM customer LEFT JOIN ({EGO}) e ON e.entity_id=c_custkey GROUP BY 1"""),
)
def _(c: Corpus) -> DataFrame:
    """Every customer: ties possible in 1998 at confidence 0.6 or more."""
    focus = customers(c)
    ties = graph.active_ties(c.claims, 0.6, *YEAR_98)
    network = graph.adjacency(ties).join(focus, "entity_id", "left_semi")
    return graph.network_counts(network, focus)


def published(c: Corpus) -> Adjacency:
    """All asserted ties in buckets; entities with more than 50 ties are hubs here."""
    path = fresh_path(c.spark, "adjacency")
    return publish_adjacency(c.claims, path, f"ties_{uuid.uuid4().hex}", limit=50)


@query("r05b_counts_on_adjacency", ORACLES["r05_network_counts"])
def _(c: Corpus) -> DataFrame:
    """The counts of every customer, read from the published adjacency."""
    focus = customers(c)
    return graph.network_counts(published(c).ego_network(focus, 0.6, *YEAR_98), focus)


@query(
    "r06_cap_edges",
    oracle(f"""SELECT entity_id, claim_id, edge_rank, n > 40 AS truncated FROM (
 SELECT entity_id, claim_id, count(*) OVER (PARTITION BY entity_id) AS n, CAST(row_number() OVER (PARTITION BY entity_id
   ORDER BY confidence_point DESC NULLS LAST, claim_id) AS INTEGER) AS edge_rank FROM ({EGO_ALL})) WHERE edge_rank<=40"""),
)
def _(c: Corpus) -> DataFrame:
    """Strongest 40 ties of every entity, unscored last."""
    network = graph.ego_network(c.claims, c.entities, 0.0, *YEAR_98, include_unscored=True)
    return graph.cap_edges(network, 40).select("entity_id", "claim_id", "edge_rank", "truncated")


@query(
    "r07_decorate_edges",
    oracle(f"""SELECT e.entity_id, e.claim_id, e.certain, e.undated, e.confidence_point IS NOT NULL AS scored, {BAND} AS band,
 s.display_name AS counterpart_name, s.entity_type AS counterpart_type
 FROM ({EGO_ALL}) e LEFT JOIN summary s ON s.entity_id=e.counterpart_id
 WHERE e.entity_id IN (SELECT c_custkey FROM customer)"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.decorate_edges(ego(c, 0.0, True), c.summary).select(
        "entity_id", "claim_id", F.col("certainly_active").alias("certain"), "undated", "scored",
        "band", "counterpart_name", "counterpart_type",
    )


@query(
    "r08_ranked_ties",
    oracle(f"""SELECT entity_id, claim_id, scored, CAST(row_number() OVER (PARTITION BY entity_id, scored
   ORDER BY confidence_point DESC NULLS LAST, claim_id) AS INTEGER) AS tie_rank FROM (
 SELECT *, confidence_point IS NOT NULL AS scored FROM ({EGO_ALL}))
 WHERE entity_id IN (SELECT c_custkey FROM customer)"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.ranked_ties(ego(c, 0.0, True)).select("entity_id", "claim_id", "scored", "tie_rank")


@query(
    "r09_edges_by_threshold",
    oracle("""SELECT CAST(t AS DOUBLE) AS threshold, count(claim_id) AS edges
 FROM (VALUES (0.0),(0.2),(0.4),(0.6),(0.8),(0.9)) v(t) LEFT JOIN rels ON confidence_point>=CAST(t AS DOUBLE) GROUP BY 1"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.edges_by_threshold(graph.relationships(c.claims))


@query(
    "r10_decade_counts",
    oracle(f"""SELECT CAST(d AS INTEGER) AS decade_start, d||'s' AS label, count(claim_id) AS ties
 FROM range(1900,2020,10) g(d) LEFT JOIN (SELECT * FROM ties WHERE status='asserted' AND NOT {UNDATED}) t
 ON (start_earliest IS NULL OR year(start_earliest)<=d+9) AND (end_latest IS NULL OR year(end_latest)>=d) GROUP BY d"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.decade_counts(graph.asserted(c.ties), 1900, 2020)


PAIRS = """SELECT min(o_custkey) AS a, -2*l_suppkey-1 AS b FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_suppkey"""


def supplier_pairs(c: Corpus) -> DataFrame:
    rows = c.table("lineitem").join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        rows.groupBy("l_suppkey")
        .agg(F.min("o_custkey").alias("a"))
        .select("a", supplier_id(F.col("l_suppkey")).alias("b"))
    )


@query(
    "r11_pair_dossier",
    oracle(
        "SELECT p.a, p.b, c.claim_id, c.predicate, c.status FROM claims c JOIN pairs p"
        " ON (c.subject_entity_id=p.a AND c.object_entity_id=p.b) OR (c.subject_entity_id=p.b AND c.object_entity_id=p.a)",
        {"pairs": PAIRS},
    ),
)
def _(c: Corpus) -> DataFrame:
    """Every claim between each supplier and its lowest-numbered customer."""
    return graph.pair_dossier(c.claims, supplier_pairs(c)).select("a", "b", "claim_id", "predicate", "status")


@query(
    "r12_attribute_groups",
    oracle("SELECT subject_entity_id, predicate, claim_id, value FROM current_attributes WHERE status<>'superseded' AND object_entity_id IS NULL"),
)
def _(c: Corpus) -> DataFrame:
    return reads.attribute_groups(c.claims).select("subject_entity_id", "predicate", "claim_id", "value")


@query(
    "r13_competing_claims",
    oracle("""SELECT subject_entity_id, predicate, shown, hidden_unscored, unscored_shown FROM (
 SELECT subject_entity_id, predicate, count(*) FILTER (confidence_point IS NOT NULL) AS shown,
  count(*) FILTER (confidence_point IS NULL) AS hidden_unscored, false AS unscored_shown
 FROM current_attributes WHERE status<>'superseded' AND object_entity_id IS NULL GROUP BY 1,2
 UNION ALL SELECT subject_entity_id, predicate, count(*), 0, true
 FROM current_attributes WHERE status<>'superseded' AND object_entity_id IS NULL GROUP BY 1,2) WHERE shown>1"""),
)
def _(c: Corpus) -> DataFrame:
    groups = reads.attribute_groups(c.claims)
    hidden = reads.competing_claims(groups, show_unscored=False).withColumn("unscored_shown", F.lit(False))
    shown = reads.competing_claims(groups, show_unscored=True).withColumn("unscored_shown", F.lit(True))
    return hidden.unionByName(shown)


TOUCH = """SELECT subject_entity_id AS entity_id, * FROM claims
 UNION ALL SELECT object_entity_id, * FROM claims WHERE object_entity_id IS NOT NULL AND object_entity_id<>subject_entity_id"""


@query(
    "r14_list_claims",
    oracle(
        f"""SELECT entity_id, claim_id, position, n>10 AS more FROM (
 SELECT entity_id, claim_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY claim_id) AS INTEGER) AS position,
 count(*) OVER (PARTITION BY entity_id) AS n FROM touch
 WHERE status='asserted' AND (confidence_point>=0.3 OR confidence_point IS NULL) AND {possibly(*Y98)}) WHERE position<=10""",
        {"touch": TOUCH},
    ),
)
def _(c: Corpus) -> DataFrame:
    return reads.list_claims(
        c.claims, c.entities, threshold=0.3, start="1998", end="1998", after=None, limit=10
    ).select("entity_id", "claim_id", "position", "more")


# What the parts of an entity page read of a claim.
VIEW_COLUMNS = (
    "claim_id", "subject_entity_id", "object_entity_id", "predicate", "status", "confidence_point", "object_literal",
    "method_detail", "start_earliest", "start_latest",
)


@query(
    "r15_entity_view",
    oracle(
        """SELECT s.entity_id, s.display_name, s.entity_type,
 (SELECT count(*) FROM anchor a WHERE a.entity_id=s.entity_id) AS external_ids,
 (SELECT count(DISTINCT predicate) FROM current_attributes t WHERE t.subject_entity_id=s.entity_id AND status<>'superseded' AND object_entity_id IS NULL) AS groups,
 (SELECT count(DISTINCT r.source_id) FROM touch t JOIN sup USING (claim_id) JOIN rec r USING (source_record_id) WHERE t.entity_id=s.entity_id) AS sources,
 (SELECT count(*) FROM touch t WHERE t.entity_id=s.entity_id AND confidence_point IS NOT NULL) AS scored,
 (SELECT count(*) FROM touch t WHERE t.entity_id=s.entity_id AND confidence_point IS NULL) AS unscored
 FROM summary s""",
        {"touch": TOUCH},
    ),
)
def _(c: Corpus) -> DataFrame:
    """The parts of every entity page, counted into one row per entity."""
    # All parts read the claims, and the links to sources read the ties three times more.
    c.keep("second_support", "source_id", columns=VIEW_COLUMNS)
    view = reads.entity_view(
        c.entities, c.summary, c.anchors, c.claims, c.support, c.record_sources, c.sources
    )
    ids = view["external_ids"].groupBy("entity_id").agg(F.count("*").alias("external_ids"))
    groups = (
        view["attributes"].groupBy(F.col("subject_entity_id").alias("entity_id"), "predicate").count()
        .groupBy("entity_id").agg(F.count("*").alias("groups"))
    )
    covered = view["coverage"].groupBy("entity_id").agg(F.count("*").alias("sources"))
    rows = view["summary"].select("entity_id", "display_name", "entity_type")
    for part in (ids, groups, covered, view["split"]):
        rows = rows.join(part, "entity_id", "left")
    return rows.fillna(0, ["external_ids", "groups", "sources", "scored", "unscored"])


@query(
    "r16_coverage_by_source",
    oracle(
        """SELECT t.entity_id, s.slug AS source_slug,
 count(DISTINCT t.claim_id) FILTER (t.predicate IN ('associated-with','corresponded-with','same-as')) AS relationship_claims,
 count(DISTINCT t.claim_id) FILTER (t.predicate NOT IN ('associated-with','corresponded-with','same-as')) AS attribute_claims
 FROM touch t JOIN sup USING (claim_id) JOIN rec r USING (source_record_id) JOIN src s ON s.source_id=r.source_id GROUP BY 1,2""",
        {"touch": TOUCH},
    ),
)
def _(c: Corpus) -> DataFrame:
    return reads.coverage_by_source(c.claims, c.support, c.records, c.sources)


@query(
    "r17_scored_split",
    oracle(
        """SELECT entity_id, count(*) FILTER (confidence_point IS NOT NULL) AS scored,
 count(*) FILTER (confidence_point IS NULL) AS unscored FROM touch GROUP BY 1""",
        {"touch": TOUCH},
    ),
)
def _(c: Corpus) -> DataFrame:
    return reads.scored_split(c.claims)


@query("r18_external_ids", oracle("SELECT entity_id, authority, external_id FROM anchor"))
def _(c: Corpus) -> DataFrame:
    return reads.external_ids(c.anchors, c.entities)


@query(
    "r19_lookup",
    oracle("""SELECT authority, external_id, entity_id, display_name, degree_scored FROM
 (SELECT DISTINCT 'registry' AS authority, CAST(o_custkey AS VARCHAR) AS external_id FROM orders
  UNION SELECT DISTINCT 'catalogue', CAST(l_partkey AS VARCHAR) FROM lineitem) q
 JOIN anchor USING (authority, external_id) JOIN summary USING (entity_id)"""),
)
def _(c: Corpus) -> DataFrame:
    """Look up everyone who ordered and everything that was ordered."""
    people = c.table("orders").select(
        F.lit("registry").alias("authority"), F.col("o_custkey").cast("string").alias("external_id")
    )
    things = c.table("lineitem").select(
        F.lit("catalogue").alias("authority"), F.col("l_partkey").cast("string").alias("external_id")
    )
    refs = people.unionByName(things).distinct()
    return reads.lookup(c.anchors, c.summary, refs).select(
        "authority", "external_id", "entity_id", "display_name", "degree_scored"
    )


@query(
    "r20_sample_entity",
    oracle("""SELECT entity_id, display_name FROM summary WHERE degree_scored>=20 AND entity_type='person'
 ORDER BY md5('7:'||entity_id), entity_id LIMIT 1"""),
)
def _(c: Corpus) -> DataFrame:
    return reads.sample_entity(c.summary, "person", 20, "7").select("entity_id", "display_name")


@query(
    "r21_neighbors",
    oracle(f"""SELECT entity_id, counterpart_id, claim_id, confidence_point, predicate FROM adj
 WHERE status='asserted' AND {possibly(*Y98)} AND confidence_point>=0.7"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.neighbors(c.claims, c.entities.select("entity_id"), 0.7, *YEAR_98)


PATH_PARTS = {
    "edges": f"""SELECT entity_id AS node, counterpart_id AS next, claim_id, confidence_point AS p FROM adj
 WHERE status='asserted' AND {possibly(*Y98)} AND confidence_point>=0.9""",
    "pairs": """SELECT c_custkey AS source, -2*min(s_suppkey)-1 AS target FROM customer
 JOIN supplier ON s_nationkey=c_nationkey GROUP BY c_custkey""",
    "l1": """SELECT source, target, e.next AS node, least(1.0, e.p) AS w, [claim_id] AS ids, [next] AS ents
 FROM pairs JOIN edges e ON e.node=source""",
    "f1": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source,target,node ORDER BY w DESC, ids) AS r
 FROM l1 WHERE node<>target AND node<>source) WHERE r=1""",
    "l2": """SELECT source, target, e.next AS node, least(w, e.p) AS w, list_append(ids, claim_id) AS ids, list_append(ents, next) AS ents
 FROM f1 JOIN edges e ON e.node=f1.node""",
    "f2": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source,target,node ORDER BY w DESC, ids) AS r
 FROM l2 WHERE node<>target AND node<>source AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.source=l2.source AND f1.target=l2.target AND f1.node=l2.node)) WHERE r=1""",
    "l3": """SELECT source, target, e.next AS node, least(w, e.p) AS w, list_append(ids, claim_id) AS ids, list_append(ents, next) AS ents
 FROM f2 JOIN edges e ON e.node=f2.node AND e.next=f2.target""",
    "found": """SELECT *, 1 AS hops FROM l1 WHERE node=target UNION ALL SELECT *, 2 FROM l2 WHERE node=target
 UNION ALL SELECT *, 3 FROM l3""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY source,target ORDER BY hops, w DESC, ids) AS path_rank FROM found""",
}


def nation_pairs(c: Corpus) -> DataFrame:
    """Each customer and the lowest-numbered supplier of the same nation."""
    first = c.table("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    return c.table("customer").join(first, F.col("c_nationkey") == F.col("s_nationkey")).select(
        F.col("c_custkey").alias("source"), supplier_id(F.col("s")).alias("target")
    )


def _path_rows(paths: DataFrame) -> DataFrame:
    return paths.select(
        "source", "target", "path_rank", "hops", "weakest",
        F.array_join(F.col("claim_ids").cast("array<string>"), ">").alias("claim_path"),
        F.array_join(F.col("entity_ids").cast("array<string>"), ">").alias("entity_path"),
        "truncated",
    )


@query(
    "r22_find_paths",
    oracle(
        """SELECT source, target, CAST(path_rank AS INTEGER) AS path_rank, CAST(hops AS INTEGER) AS hops, w AS weakest,
 array_to_string(ids,'>') AS claim_path, array_to_string(ents,'>') AS entity_path,
 max(path_rank) OVER (PARTITION BY source,target) >= 3 AS truncated
 FROM ranked WHERE path_rank<=3""",
        PATH_PARTS,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Three best paths of at most three ties at 0.9 or more, for every customer."""
    return _path_rows(find_paths(c.claims, nation_pairs(c), 0.9, *YEAR_98, max_depth=3, max_paths=3))


@query("r22c_paths_on_adjacency", ORACLES["r22_find_paths"])
def _(c: Corpus) -> DataFrame:
    """The same paths over the published adjacency."""
    return _path_rows(find_paths(published(c), nation_pairs(c), 0.9, *YEAR_98, max_depth=3, max_paths=3))


@query(
    "r22b_path_steps",
    oracle(
        """SELECT source, target, path_rank, CAST(position AS INTEGER) AS position, entity_id, claim_id, display_name FROM (
 SELECT source, target, CAST(path_rank AS INTEGER) AS path_rank, 0 AS position, source AS entity_id, NULL::VARCHAR AS claim_id FROM ranked WHERE path_rank<=3
 UNION ALL SELECT source, target, CAST(path_rank AS INTEGER), i, ents[i], ids[i] FROM ranked, range(1,4) g(i) WHERE path_rank<=3 AND i<=hops)
 LEFT JOIN summary USING (entity_id)""",
        PATH_PARTS,
    ),
)
def _(c: Corpus) -> DataFrame:
    paths = find_paths(c.claims, nation_pairs(c), 0.9, *YEAR_98, max_depth=3, max_paths=3)
    return path_steps(paths, c.summary).select(
        "source", "target", "path_rank", "position", "entity_id", "claim_id", "display_name"
    )


@query(
    "r23_blocked_sources",
    oracle("""SELECT slug FROM src WHERE NOT license_confirmed AND EXISTS
 (SELECT 1 FROM rec JOIN sup USING (source_record_id) WHERE rec.source_id=src.source_id)"""),
)
def _(c: Corpus) -> DataFrame:
    return graph.blocked_sources(c.sources, c.records, c.support).select("slug")
