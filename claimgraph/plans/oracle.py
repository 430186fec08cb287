"""The corpus as plain SQL, shared by the check queries of every operator."""

from __future__ import annotations

import re

# Named parts in dependency order; a check query gets only the ones it mentions.
# The columns that tell lines of one key apart, in the order of their names.
LINE_REST = "l_discount, l_extendedprice, l_linestatus, l_quantity, l_returnflag, l_shipdate, l_tax"

PARTS = {
    "ties0": f"""
SELECT concat_ws('-','t',l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey,row_number() OVER (
         PARTITION BY l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey ORDER BY {LINE_REST})) AS claim_id,
       o.o_custkey AS subject_entity_id, -2*l.l_suppkey-1 AS object_entity_id,
       CASE WHEN l.l_returnflag='R' THEN 'corresponded-with' ELSE 'associated-with' END AS predicate,
       CASE WHEN l.l_returnflag<>'R' THEN abs(round(l.l_discount*10,1)) END AS confidence_point,
       CAST(o.o_orderdate AS DATE) AS se0,
       CASE WHEN l.l_linestatus='F' THEN CAST(o.o_orderdate AS DATE) + 30 END AS sl0,
       CASE WHEN l.l_linestatus='F' THEN CAST(l.l_shipdate AS DATE) - 30 END AS ee0,
       CAST(l.l_shipdate AS DATE) AS el0,
       l.l_linenumber = 7 AS approximate,
       CASE WHEN l.l_linenumber <= 6 THEN
              (['IN','CA','AF/IN','BF/IN','AF','BF'])[l.l_linenumber]
            WHEN l.l_returnflag='A' THEN 'CA' END AS code,
       CASE WHEN l.l_linestatus='F' THEN 'imported' ELSE 'extracted' END AS method,
       CAST(s.s_nationkey AS BIGINT) AS asserted_by_agent_id,
       CAST(o.o_orderdate AS DATE) + 1 AS recorded_day,
       CASE WHEN l.l_quantity>=50 THEN 'superseded' WHEN l.l_quantity>=46 THEN 'disputed'
            ELSE 'asserted' END AS status,
       CAST(n.n_regionkey AS BIGINT) AS source_id,
       concat(l.l_orderkey,'-',l.l_linenumber) AS external_id,
       md5(concat(l.l_partkey,'|',l.l_suppkey,'|',CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR))) AS content_hash,
       l.l_tax >= 0.04 AS second_support, l.l_quantity AS quantity
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN nation n ON s.s_nationkey=n.n_nationkey""",
    "ties1": """
SELECT *, coalesce(se0>sl0,false) OR coalesce(ee0>el0,false) OR coalesce(se0>el0,false) AS inverted
FROM ties0""",
    "ties": """
SELECT *, CASE WHEN NOT inverted THEN se0 END AS start_earliest,
       CASE WHEN NOT inverted THEN sl0 END AS start_latest,
       CASE WHEN NOT inverted THEN ee0 END AS end_earliest,
       CASE WHEN NOT inverted THEN el0 END AS end_latest FROM ties1""",
    "cust": """
SELECT c_custkey AS c, c_name, lower(c_mktsegment) || ' account ' || c_nationkey AS alias,
       c_mktsegment, c_acctbal, CAST(c_nationkey AS BIGINT) AS nation,
       CAST(1500 + c_custkey % 120 AS INTEGER) AS born,
       CAST(1500 + c_custkey % 120 + 40 + c_nationkey AS INTEGER) AS died FROM customer""",
    "attributes": """
SELECT 'a-'||c||'-0' AS claim_id, c AS subject_entity_id, NULL::BIGINT AS object_entity_id, 'has-name' AS predicate,
       c_name AS value, 'primary' AS name_kind, NULL::INTEGER AS year, NULL::DOUBLE AS source_point, nation AS agent FROM cust
UNION ALL SELECT 'a-'||c||'-1', c, NULL, 'has-name', alias, 'alias', NULL, NULL, nation FROM cust
UNION ALL SELECT 'a-'||c||'-2', c, NULL, 'born', CAST(born AS VARCHAR), NULL, born, NULL, nation FROM cust
UNION ALL SELECT 'a-'||c||'-3', c, NULL, 'died', CAST(died AS VARCHAR), NULL, died, NULL, nation FROM cust WHERE c_acctbal>=0
UNION ALL SELECT 'a-'||c||'-4', c, NULL, 'has-gender', CASE WHEN c%3=0 THEN 'male' ELSE 'female' END, NULL, NULL, NULL, nation FROM cust WHERE c%3<>2
UNION ALL SELECT 'a-'||c||'-5', c, NULL, 'has-description', c_mktsegment, NULL, NULL, NULL, nation FROM cust WHERE c_acctbal>5000
UNION ALL SELECT 'a-'||c||'-6', c, NULL, 'has-external-id', CAST(c+500 AS VARCHAR), NULL, NULL, NULL, nation FROM cust WHERE c%7<>0
UNION ALL SELECT 'a-'||c||'-7', c, NULL, 'born', CAST(born+1 AS VARCHAR), NULL, born+1, 0.45, nation FROM cust WHERE c%11=0
UNION ALL SELECT 'a-'||c||'-9', c, c-1, 'same-as', NULL, NULL, NULL, 0.8, nation FROM cust WHERE c%10 IN (1,2,3)
UNION ALL SELECT 'a-'||(-2*s_suppkey-1)||'-0', -2*s_suppkey-1, NULL, 'has-name', s_name, 'primary', NULL, NULL, s_suppkey%25 FROM supplier
UNION ALL SELECT 'a-'||(-2*p_partkey-2)||'-0', -2*p_partkey-2, NULL, 'has-name', p_name, 'primary', NULL, NULL, p_partkey%25 FROM part
UNION ALL SELECT 'a-'||(-2*p_partkey-2)||'-1', -2*p_partkey-2, NULL, 'has-name', lower(p_type)||' '||lower(p_brand), 'alias', NULL, NULL, p_partkey%25 FROM part""",
    "user_events": """
SELECT 'u-'||event_id AS id, 'a-'||user_id||'-'||(event_id%10) AS claim_id, ts AS occurred_at,
       CASE event_type WHEN 'signup' THEN 'assert' WHEN 'error' THEN 'dispute' WHEN 'view' THEN 'undispute'
            ELSE CASE WHEN event_type='click' AND event_id%97=0 THEN 'supersede' ELSE 'adjust_confidence' END END AS event_type,
       user_id%25 AS actor_agent_id, round(value/500,2) AS point FROM events""",
    "attribute_events": """
SELECT claim_id||'/0' AS id, claim_id, TIMESTAMP '2023-01-01 00:00:00' AS occurred_at, 'assert' AS event_type,
       agent AS actor_agent_id, NULL::DOUBLE AS point FROM attributes
UNION ALL SELECT id, claim_id, occurred_at, event_type, actor_agent_id, point FROM user_events
WHERE claim_id IN (SELECT claim_id FROM attributes)""",
    "tie_events": """
SELECT claim_id||'/0' AS id, claim_id, CAST(recorded_day AS TIMESTAMP) AS occurred_at, 'assert' AS event_type,
       asserted_by_agent_id AS actor_agent_id, NULL::DOUBLE AS point FROM ties
UNION ALL SELECT claim_id||'/1', claim_id, CAST(recorded_day+10 AS TIMESTAMP), 'dispute', asserted_by_agent_id, NULL FROM ties WHERE quantity>=41 AND quantity<50
UNION ALL SELECT claim_id||'/2', claim_id, CAST(recorded_day+20 AS TIMESTAMP), 'undispute', asserted_by_agent_id, NULL FROM ties WHERE quantity>=41 AND quantity<46
UNION ALL SELECT claim_id||'/3', claim_id, CAST(recorded_day+30 AS TIMESTAMP), 'supersede', asserted_by_agent_id, NULL FROM ties WHERE quantity>=50""",
    "log": "SELECT * FROM tie_events UNION ALL SELECT * FROM attribute_events",
    # Replays of a log one event at a time, as text of what happened so far.
    "attribute_replay": """
SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY occurred_at, id) AS rn FROM attribute_events""",
    "attribute_walk": """
SELECT claim_id, rn, event_type,
       max(CASE WHEN event_type='assert' THEN rn END) OVER w AS a,
       max(CASE WHEN event_type='supersede' THEN rn END) OVER w AS s FROM attribute_replay
WINDOW w AS (PARTITION BY claim_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "attribute_legal": """
SELECT *, event_type='dispute' AND coalesce(s > coalesce(a,0), false) AS illegal FROM attribute_walk""",
    "attribute_last": """
SELECT claim_id, max_by(event_type, rn) FILTER (event_type IN ('assert','dispute','supersede') AND NOT illegal) AS l,
       max(rn) FILTER (event_type IN ('assert','dispute','supersede') AND NOT illegal) AS lr,
       max(rn) FILTER (event_type='undispute') AS ur, bool_or(illegal) AS any_illegal
FROM attribute_legal GROUP BY claim_id""",
    "attribute_status": """
SELECT claim_id, any_illegal, CASE WHEN l='assert' THEN 'asserted' WHEN l='supersede' THEN 'superseded'
       WHEN l='dispute' THEN CASE WHEN coalesce(ur,0)>lr THEN 'asserted' ELSE 'disputed' END END AS status
FROM attribute_last""",
    "attribute_points": """
SELECT claim_id, arg_max(point, row(occurred_at,id)) AS manual FROM attribute_events
WHERE event_type='adjust_confidence' GROUP BY claim_id""",
    "current_attributes": """
SELECT t.*, s.status, coalesce(p.manual, t.source_point) AS confidence_point,
       CASE WHEN p.manual IS NOT NULL THEN 'manual' WHEN t.source_point IS NOT NULL THEN 'source' ELSE 'unscored' END AS origin,
       make_date(t.year,1,1) AS start_earliest, make_date(t.year,12,31) AS start_latest
FROM attributes t JOIN attribute_status s USING (claim_id) LEFT JOIN attribute_points p USING (claim_id)""",
    "claims": """
SELECT claim_id, subject_entity_id, object_entity_id, predicate, NULL::VARCHAR AS value, NULL::VARCHAR AS name_kind, confidence_point,
       CASE WHEN confidence_point IS NULL THEN 'unscored' ELSE 'source' END AS origin, status,
       start_earliest, start_latest, end_earliest, end_latest, approximate, method, asserted_by_agent_id,
       recorded_day, confidence_point AS source_point FROM ties
UNION ALL SELECT claim_id, subject_entity_id, object_entity_id, predicate, value, name_kind, confidence_point,
       origin, status, start_earliest, start_latest, NULL, NULL, false, 'imported', agent, DATE '2023-01-01', source_point
FROM current_attributes""",
    "rels": "SELECT * FROM claims WHERE object_entity_id IS NOT NULL",
    "adj": """
SELECT subject_entity_id AS entity_id, object_entity_id AS counterpart_id, * FROM rels
UNION ALL SELECT object_entity_id, subject_entity_id, * FROM rels WHERE subject_entity_id<>object_entity_id""",
    "ent": """
SELECT c_custkey AS entity_id, 'person' AS entity_type FROM customer
UNION ALL SELECT -2*s_suppkey-1, 'organization' FROM supplier
UNION ALL SELECT -2*p_partkey-2, 'document' FROM part""",
    "anchor": """
SELECT 'registry' AS authority, CAST(c_custkey AS VARCHAR) AS external_id, c_custkey AS entity_id FROM customer
UNION ALL SELECT 'household', 'h'||c_custkey, c_custkey FROM customer
UNION ALL SELECT 'ledger', CAST(s_suppkey AS VARCHAR), -2*s_suppkey-1 FROM supplier
UNION ALL SELECT 'catalogue', CAST(p_partkey AS VARCHAR), -2*p_partkey-2 FROM part""",
    "src": """
SELECT CAST(r_regionkey AS BIGINT) AS source_id, lower(r_name) AS slug, r_name AS title, 'v'||r_regionkey AS version,
       'https://example.org/'||lower(r_name) AS retrieval_uri, r_regionkey%2=0 AS license_confirmed FROM region""",
    "agt": """
SELECT CAST(n_nationkey AS BIGINT) AS agent_id, lower(n_name) AS slug, n_name AS display_name,
       CASE n_nationkey%3 WHEN 0 THEN 'human' WHEN 1 THEN 'pipeline' ELSE 'model' END AS kind FROM nation""",
    "rec": """
SELECT claim_id AS source_record_id, source_id, 'relationship' AS record_kind, external_id, content_hash,
       '{"line":"'||external_id||'"}' AS raw FROM ties
UNION ALL SELECT 'e-'||entity_id, abs(entity_id)%5, entity_type, CAST(entity_id AS VARCHAR), md5(CAST(entity_id AS VARCHAR)),
       '{"entity":'||entity_id||'}' FROM ent""",
    "sup": """
SELECT claim_id, claim_id AS source_record_id FROM ties
UNION ALL SELECT claim_id, 'e-'||subject_entity_id FROM ties WHERE second_support
UNION ALL SELECT claim_id, 'e-'||subject_entity_id FROM attributes""",
    "names": """
SELECT subject_entity_id AS entity_id, min_by(value, row(confidence_point IS NULL, name_kind<>'primary', claim_id)) AS display_name,
       min_by(claim_id, row(confidence_point IS NULL, name_kind<>'primary', claim_id)) AS name_claim_id
FROM claims WHERE predicate='has-name' AND status='asserted' GROUP BY 1""",
    "deg": """
SELECT entity_id, count(*) FILTER (confidence_point IS NOT NULL) AS degree_scored,
       count(*) FILTER (confidence_point IS NULL) AS degree_unscored FROM adj WHERE status='asserted' GROUP BY 1""",
    "facts": """
SELECT subject_entity_id AS entity_id,
       min_by(value, claim_id) FILTER (predicate='has-description') AS description,
       min_by(value, claim_id) FILTER (predicate='has-gender') AS gender,
       min_by(start_earliest, claim_id) FILTER (predicate='born') AS born_earliest,
       min_by(start_latest, claim_id) FILTER (predicate='born') AS born_latest,
       min_by(start_earliest, claim_id) FILTER (predicate='died') AS died_earliest,
       min_by(start_latest, claim_id) FILTER (predicate='died') AS died_latest
FROM claims WHERE status='asserted' AND object_entity_id IS NULL GROUP BY 1""",
    "summary": """
SELECT e.entity_id, e.entity_type, coalesce(n.display_name, 'unnamed entity #'||e.entity_id) AS display_name,
       n.name_claim_id, f.description, f.gender, f.born_earliest, f.born_latest, f.died_earliest, f.died_latest,
       coalesce(d.degree_scored,0) AS degree_scored, coalesce(d.degree_unscored,0) AS degree_unscored
FROM ent e LEFT JOIN names n USING (entity_id) LEFT JOIN facts f USING (entity_id) LEFT JOIN deg d USING (entity_id)""",
}


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the parts it mentions, directly or through other parts."""
    parts = PARTS | (extra or {})
    order = list(parts)
    needed: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text, flags=re.IGNORECASE))
        for name in words & set(order) - needed:
            needed.add(name)
            visit(parts[name])

    visit(body)
    ctes = ", ".join(f"{n} AS ({parts[n]})" for n in order if n in needed)
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body


POSSIBLY = "(start_earliest IS NULL OR start_earliest <= DATE '{1}') AND (end_latest IS NULL OR end_latest >= DATE '{0}')"
CERTAINLY = "coalesce(start_latest <= DATE '{1}' AND end_earliest >= DATE '{0}', false)"
UNDATED = (
    "(start_earliest IS NULL AND start_latest IS NULL AND end_earliest IS NULL AND end_latest IS NULL)"
)


def possibly(w0: str, w1: str) -> str:
    return POSSIBLY.format(w0, w1)


def certainly(w0: str, w1: str) -> str:
    return CERTAINLY.format(w0, w1)


BAND = """CASE WHEN confidence_point IS NULL THEN 'unscored' WHEN confidence_point>=0.9 THEN 'very_strong'
 WHEN confidence_point>=0.7 THEN 'strong' WHEN confidence_point>=0.4 THEN 'moderate'
 WHEN confidence_point>=0.2 THEN 'weak' ELSE 'very_weak' END"""
