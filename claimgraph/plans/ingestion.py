"""Queries for sources, mapping and import: S, M and I operators.

Customers and order lines are read as the rows of a people source, orders as letters,
and order lines once more as a batch of interchange lines with every kind of defect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import temporal as time
from claimgraph.functions.confidence import native_confidence
from claimgraph.functions.text import content_hash, normalize_name
from claimgraph.operators import actions as acts
from claimgraph.operators import ingest, letters, people, validate
from claimgraph.operators.graph import blocked_sources
from claimgraph.operators.ordered import numbered
from claimgraph.plans.corpus import Corpus, line_content_hash, line_external_id
from claimgraph.plans.oracle import oracle
from claimgraph.plans.registry import query
from claimgraph.schema import (
    BOUNDS,
    LETTER_AUTHORITIES,
    LETTER_TYPES,
    PEOPLE_AUTHORITIES,
    PEOPLE_COLUMNS,
    PEOPLE_TYPES,
    source_authorities,
    source_types,
)
from claimgraph.session import fresh_path, materialise
from claimgraph.sources import delimited, export, manifest, ndjson
from claimgraph.sources.letters import read_letters

CODE_LIST = ("", "IN", "CA", "AF/IN", "BF/IN", "AF", "BF", "zz")
CODE_SQL = "(['','IN','CA','AF/IN','BF/IN','AF','BF','zz'])"


def _code(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CODE_LIST]), (number % 8 + 1).cast("int"))


# People and relationship rows ----------------------------------------------------
def people_rows(c: Corpus) -> DataFrame:
    """Customers as the text rows of a people source."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    born = 1500 + key % 120
    name = F.replace("c_name", F.lit("#"), F.lit("  #"))
    primary = F.replace("c_name", F.lit("#"), F.lit(" #"))
    return c.table("customer").select(
        key.cast("string").alias("id"),
        F.concat(F.lit(" "), name, F.lit(" ")).alias("display_name"),
        F.concat_ws("|", "c_name", "c_mktsegment", primary, F.lit(""), "c_mktsegment").alias("search_names_all"),
        F.when(key % 13 == 0, "circ").when(key % 17 == 0, "").otherwise(born.cast("string")).alias("birth_year"),
        _code(key).alias("birth_type"),
        F.when(F.col("c_acctbal") >= 0, (born + 40 + nation).cast("string")).otherwise("").alias("death_year"),
        _code(nation).alias("death_type"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").otherwise("").alias("gender"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("").alias("description"),
        F.when(key % 7 == 0, "0").when(key % 5 == 0, "").otherwise((key + 500).cast("string")).alias("odnb_id"),
    )


def tie_rows(c: Corpus) -> DataFrame:
    """Order lines as relationship rows between a customer and the person numbered like the part.

    Parts outnumber customers, so some rows point at nobody.
    """
    line, number = c.table("lineitem"), F.col("l_linenumber")
    rows = line.join(c.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    returned = F.col("l_returnflag") == "R"
    return rows.select(
        F.when(number == 7, "").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("id"),
        F.col("o_custkey").cast("string").alias("person1_id"),
        F.col("l_partkey").cast("string").alias("person2_id"),
        F.round(F.abs(F.col("l_discount")) * 1000).cast("int").cast("string").alias("max_certainty"),
        F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.year("o_orderdate").cast("string")).alias("start_year"),
        _code(number).alias("start_type"),
        F.when(number == 3, "n.d.")
        .otherwise((F.year("l_shipdate") - F.when(returned, 10).otherwise(0)).cast("string"))
        .alias("end_year"),
        _code(F.col("l_suppkey")).alias("end_type"),
    )


PEOPLE = {
    "people0": f"""SELECT c_custkey AS c, CAST(c_custkey AS VARCHAR) AS id, replace(c_name,'#',' #') AS pname, c_name, c_mktsegment,
 ' '||replace(c_name,'#','  #')||' ' AS display_name, c_name||'|'||c_mktsegment||'|'||replace(c_name,'#',' #')||'||'||c_mktsegment AS search_names_all,
 CASE WHEN c_custkey%13=0 THEN 'circ' WHEN c_custkey%17=0 THEN '' ELSE CAST(1500+c_custkey%120 AS VARCHAR) END AS birth_year,
 {CODE_SQL}[c_custkey%8+1] AS birth_type, CASE WHEN c_acctbal>=0 THEN CAST(1540+c_custkey%120+c_nationkey AS VARCHAR) ELSE '' END AS death_year,
 {CODE_SQL}[c_nationkey%8+1] AS death_type, CASE c_custkey%3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE '' END AS gender,
 CASE WHEN c_acctbal>5000 THEN c_mktsegment ELSE '' END AS description,
 CASE WHEN c_custkey%7=0 THEN '0' WHEN c_custkey%5=0 THEN '' ELSE CAST(c_custkey+500 AS VARCHAR) END AS odnb_id FROM customer""",
    "rows0": f"""SELECT CASE WHEN l_linenumber=7 THEN '' ELSE concat_ws('-',l_orderkey,l_linenumber,l_partkey) END AS id,
 o_custkey AS p1, l_partkey AS p2, CAST(round(abs(l_discount)*1000) AS INTEGER) AS score,
 CASE WHEN l_linestatus<>'O' THEN year(o_orderdate) END AS sy, CASE WHEN l_linestatus='O' THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS start_year,
 {CODE_SQL}[l_linenumber%8+1] AS start_type,
 CASE WHEN l_linenumber<>3 THEN year(l_shipdate)-CASE WHEN l_returnflag='R' THEN 10 ELSE 0 END END AS ey, l_linenumber=3 AS bad_end,
 CASE WHEN l_linenumber=3 THEN 'n.d.' ELSE CAST(year(l_shipdate)-CASE WHEN l_returnflag='R' THEN 10 ELSE 0 END AS VARCHAR) END AS end_year,
 {CODE_SQL}[l_suppkey%8+1] AS end_type FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "rowscode": """SELECT *, CASE start_type WHEN '' THEN 'IN' ELSE start_type END AS sc, CASE end_type WHEN '' THEN 'IN' ELSE end_type END AS ec FROM rows0""",
    "rows1": """SELECT *,
 CASE WHEN sc IN ('IN','CA','AF/IN','zz') THEN make_date(sy,1,1) WHEN sc='AF' THEN make_date(sy,12,31) END AS se0,
 CASE WHEN sc IN ('IN','CA','BF/IN','zz') THEN make_date(sy,12,31) WHEN sc='BF' THEN make_date(sy,1,1) END AS sl0,
 CASE WHEN ec IN ('IN','CA','AF/IN','zz') THEN make_date(ey,1,1) WHEN ec='AF' THEN make_date(ey,12,31) END AS ee0,
 CASE WHEN ec IN ('IN','CA','BF/IN','zz') THEN make_date(ey,12,31) WHEN ec='BF' THEN make_date(ey,1,1) END AS el0,
 (sc='CA' AND sy IS NOT NULL) OR (ec='CA' AND ey IS NOT NULL) AS circa FROM rowscode""",
    "rows2": """SELECT *, coalesce(se0>sl0,false) OR coalesce(ee0>el0,false) OR coalesce(se0>el0,false) AS inv,
 p1 IN (SELECT c_custkey FROM customer) AND p2 IN (SELECT c_custkey FROM customer) AS known FROM rows1""",
}


def flat(claims: DataFrame) -> DataFrame:
    """The plain columns of interchange claims."""
    v = F.col("valid_time")
    return claims.select(
        F.col("subject.id").alias("subject"),
        "predicate",
        F.col("object_literal.kind").alias("kind"),
        F.col("object_literal.value").alias("value"),
        v["start_earliest"].alias("se"),
        v["start_latest"].alias("sl"),
        v["approximate"].alias("circa"),
        v["original"].alias("original"),
        "method_detail",
    )


FLAT_NULLS = "NULL::DATE AS se, NULL::DATE AS sl, NULL::BOOLEAN AS circa, NULL::VARCHAR AS original"


@query("m01_people_entities", oracle("SELECT 'person' AS entity_type, 'sdfb' AS authority, id, 1 AS anchors FROM people0", PEOPLE))
def _(c: Corpus) -> DataFrame:
    return people.people_entities(people_rows(c)).select(
        "entity_type", "ref.authority", "ref.id", F.size("external_ids").alias("anchors")
    )


@query("m02_normalize_name", oracle("SELECT id, pname AS name FROM people0", PEOPLE))
def _(c: Corpus) -> DataFrame:
    return people_rows(c).select("id", normalize_name(F.col("display_name")).alias("name"))


PRIMARY = f"""SELECT id AS subject, 'has-name' AS predicate, 'string' AS kind, pname AS value, {FLAT_NULLS}, '{{"name_kind":"primary"}}' AS method_detail FROM people0"""
ALIAS = f"""SELECT id AS subject, 'has-name' AS predicate, 'string' AS kind, unnest([c_name,c_mktsegment]) AS value, {FLAT_NULLS},
 '{{"name_kind":"alias"}}' AS method_detail FROM people0"""
LIFE = """SELECT id AS subject, predicate, 'year' AS kind, CAST(y AS VARCHAR) AS value,
 CASE WHEN code IN ('IN','CA','AF/IN','zz') THEN make_date(y,1,1) WHEN code='AF' THEN make_date(y,12,31) END AS se,
 CASE WHEN code IN ('IN','CA','BF/IN','zz') THEN make_date(y,12,31) WHEN code='BF' THEN make_date(y,1,1) END AS sl,
 code='CA' AS circa, '{"type_code":"'||code||'","year":"'||y||'"}' AS original, NULL AS method_detail FROM (
 SELECT id, 'born' AS predicate, CASE birth_type WHEN '' THEN 'IN' ELSE birth_type END AS code, try_cast(birth_year AS INTEGER) AS y FROM people0
 UNION ALL SELECT id, 'died', CASE death_type WHEN '' THEN 'IN' ELSE death_type END, try_cast(death_year AS INTEGER) FROM people0) WHERE y IS NOT NULL"""
GENDER = f"""SELECT id AS subject, 'has-gender' AS predicate, 'gender' AS kind, gender AS value, {FLAT_NULLS}, NULL AS method_detail FROM people0 WHERE gender<>''"""
DESCRIPTION = f"""SELECT id AS subject, 'has-description' AS predicate, 'string' AS kind, description AS value, {FLAT_NULLS}, NULL AS method_detail FROM people0 WHERE description<>''"""
EXTERNAL = f"""SELECT id AS subject, 'has-external-id' AS predicate, 'external-id' AS kind, odnb_id AS value, {FLAT_NULLS}, NULL AS method_detail FROM people0 WHERE odnb_id NOT IN ('','0')"""


@query("m03_primary_names", oracle(PRIMARY, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.primary_names(people_rows(c)))


@query("m04_alias_names", oracle(ALIAS, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.alias_names(people_rows(c)))


@query("m05_life_dates", oracle(LIFE, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.life_dates(people_rows(c)))


@query(
    "m06_parse_year",
    oracle("SELECT id, try_cast(birth_year AS INTEGER) AS year, birth_year='circ' AS bad FROM people0", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    return people_rows(c).select("id", time.parse_year(F.col("birth_year")).alias("_y")).select("id", "_y.*")


@query(
    "m07_interpret_endpoint",
    oracle("SELECT id, se0 AS earliest, sl0 AS latest, sc='CA' AND sy IS NOT NULL AS approximate FROM rows1 WHERE id<>''", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    year = time.parse_year(F.col("start_year"))["year"]
    point = time.interpret_endpoint(F.col("start_type"), year)
    return tie_rows(c).where(F.col("id") != "").select("id", point.alias("_p")).select("id", "_p.*")


@query("m08_gender_claims", oracle(GENDER, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.gender_claims(people_rows(c)))


@query("m09_description_claims", oracle(DESCRIPTION, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.description_claims(people_rows(c)))


@query("m10_external_id_claims", oracle(EXTERNAL, PEOPLE))
def _(c: Corpus) -> DataFrame:
    return flat(people.external_id_claims(people_rows(c)))


@query(
    "m11_drop_dangling",
    oracle("SELECT id, CAST(p1 AS VARCHAR) AS person1_id, CAST(p2 AS VARCHAR) AS person2_id, known AS kept FROM rows2", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    rels, persons = tie_rows(c), people_rows(c)
    kept = people.drop_dangling(rels, persons).withColumn("kept", F.lit(True))
    lost = people.dangling(rels, persons).withColumn("kept", F.lit(False))
    return kept.unionByName(lost).select("id", "person1_id", "person2_id", "kept")


@query(
    "m12_canonical_pair",
    oracle("SELECT CAST(least(p1,p2) AS VARCHAR) AS a, CAST(greatest(p1,p2) AS VARCHAR) AS b, count(*) AS n FROM rows0 GROUP BY 1,2", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    pair = people.canonical_pair(F.col("person1_id"), F.col("person2_id"))
    return tie_rows(c).select(pair.alias("_p")).groupBy("_p.a", "_p.b").agg(F.count("*").alias("n"))


@query(
    "m13_duplicate_pairs",
    oracle("SELECT CAST(least(p1,p2) AS VARCHAR) AS a, CAST(greatest(p1,p2) AS VARCHAR) AS b, count(*)-1 AS repeats FROM rows0 GROUP BY 1,2 HAVING count(*)>1", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    return people.duplicate_pairs(tie_rows(c))


@query("m14_native_confidence", oracle("SELECT id, 'source_native_scalar' AS kind, CAST(score AS VARCHAR) AS raw, score/100.0::DOUBLE AS point, false AS calibrated FROM rows0", PEOPLE))
def _(c: Corpus) -> DataFrame:
    confidence = native_confidence(F.col("max_certainty"), "score_0_100")
    return tie_rows(c).select("id", confidence.alias("_c")).select(
        "id", "_c.kind", "_c.raw", "_c.point", "_c.calibrated"
    )


ORIGINAL = """'{'||concat_ws(',', CASE WHEN ey IS NOT NULL THEN '"end":{"type_code":"'||ec||'","year":"'||ey||'"}' END,
 CASE WHEN sy IS NOT NULL THEN '"start":{"type_code":"'||sc||'","year":"'||sy||'"}' END)||'}'"""


@query(
    "m15_build_interval",
    oracle(f"SELECT id, se0 AS start_earliest, sl0 AS start_latest, ee0 AS end_earliest, el0 AS end_latest, circa AS approximate, {ORIGINAL} AS original FROM rows1", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    return people.build_interval(tie_rows(c)).select("id", *BOUNDS, "approximate", "original")


@query(
    "m16_drop_inverted",
    oracle(f"""SELECT id, CASE WHEN NOT inv THEN se0 END AS start_earliest, CASE WHEN NOT inv THEN sl0 END AS start_latest,
 CASE WHEN NOT inv THEN ee0 END AS end_earliest, CASE WHEN NOT inv THEN el0 END AS end_latest,
 CASE WHEN NOT inv THEN circa END AS approximate, {ORIGINAL} AS original, inv AS inverted FROM rows2""", PEOPLE),
)
def _(c: Corpus) -> DataFrame:
    return people.drop_inverted(people.build_interval(tie_rows(c))).select(
        "id", *BOUNDS, "approximate", "original", "inverted"
    )


RAW_ROW = """'{"end_type":"'||end_type||'","end_year":"'||end_year||'","id":"'||id||'","max_certainty":"'||score||'","person1_id":"'||p1||
 '","person2_id":"'||p2||'","start_type":"'||start_type||'","start_year":"'||start_year||'"}'"""
TIE_CLAIM = f"""SELECT CAST(least(p1,p2) AS VARCHAR) AS subject, CAST(greatest(p1,p2) AS VARCHAR) AS object, score/100.0::DOUBLE AS point,
 CASE WHEN NOT inv THEN se0 END AS se, CASE WHEN NOT inv THEN el0 END AS el, {ORIGINAL} AS original,
 CASE WHEN id='' THEN p1||'-'||p2 ELSE id END AS external_id, 'sha256:'||sha256({RAW_ROW}) AS content_hash FROM rows2 WHERE known"""


@query("m17_relationship_claims", oracle(TIE_CLAIM, PEOPLE))
def _(c: Corpus) -> DataFrame:
    record = F.col("support")[0]
    return people.relationship_claims(tie_rows(c), people_rows(c)).select(
        F.col("subject.id").alias("subject"),
        F.col("object_entity.id").alias("object"),
        "confidence.point",
        F.col("valid_time.start_earliest").alias("se"),
        F.col("valid_time.end_latest").alias("el"),
        F.col("valid_time.original").alias("original"),
        record["external_id"].alias("external_id"),
        record["content_hash"].alias("content_hash"),
    )


COUNTERS = """SELECT 'odnb_zero_sentinel' AS counter, count(*) AS n FROM people0 WHERE odnb_id IN ('','0')
 UNION ALL SELECT 'relationship_dangling_endpoint_skipped', count(*) FROM rows2 WHERE NOT known
 UNION ALL SELECT 'valid_time_inverted_dropped_bounds', count(*) FROM rows2 WHERE known AND inv
 UNION ALL SELECT 'bad_year_value', (SELECT count(*) FROM people0 WHERE birth_year='circ') + (SELECT count(*) FROM rows2 WHERE known AND bad_end)
 UNION ALL SELECT 'duplicate_pair_kept', (SELECT count(*) - count(DISTINCT (least(p1,p2), greatest(p1,p2))) FROM rows2 WHERE known)
 UNION ALL SELECT 'bad_score_set_aside', count(*) FROM rows2 WHERE known AND score IS NULL"""


@query(
    "m18_anomaly_counters",
    oracle(
        COUNTERS,
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return people.anomaly_counters(people_rows(c), tie_rows(c))


@query(
    "m19_transform",
    oracle(
        f"""SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects FROM (
 SELECT subject, predicate FROM ({PRIMARY}) UNION ALL SELECT subject, predicate FROM ({ALIAS}) UNION ALL SELECT subject, predicate FROM ({LIFE})
 UNION ALL SELECT subject, predicate FROM ({GENDER}) UNION ALL SELECT subject, predicate FROM ({DESCRIPTION})
 UNION ALL SELECT subject, predicate FROM ({EXTERNAL}) UNION ALL SELECT subject, 'associated-with' FROM ({TIE_CLAIM})) GROUP BY 1""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    _, claims, _ = people.transform(people_rows(c), tie_rows(c))
    return claims.groupBy("predicate").agg(
        F.count("*").alias("n"), F.countDistinct("subject.id").alias("subjects")
    )


def _whole(entities: DataFrame, claims: DataFrame, counters: DataFrame) -> DataFrame:
    """All that a transform yields as one frame of flat rows: entities, claims and counters."""
    none = F.lit(None)
    v, tie = F.col("valid_time"), F.col("object_entity").isNotNull()
    flat_claims = claims.select(
        F.lit("claim").alias("part"), F.col("subject.id").alias("subject"), "predicate",
        F.coalesce("object_entity.id", "object_literal.value").alias("object"), "confidence.point",
        v["start_earliest"].alias("first_day"), F.when(tie, v["end_latest"]).otherwise(v["start_latest"]).alias("last_day"),
        v["original"].alias("original"), "method_detail", F.col("support")[0]["external_id"].alias("record"),
    )

    def other(rows: DataFrame, part: str, subject: Column, predicate: Column) -> DataFrame:
        empty = {c: none.cast(t).alias(c) for c, t in flat_claims.dtypes}
        return rows.select(*(empty | {
            "part": F.lit(part).alias("part"), "subject": subject.alias("subject"), "predicate": predicate.alias("predicate")
        }).values())

    kinds = F.concat_ws(":", "ref.authority", "entity_type", F.size("external_ids"))
    return (
        flat_claims.unionByName(other(entities, "entity", F.col("ref.id"), kinds))
        .unionByName(other(counters, "counter", F.col("counter"), F.col("n").cast("string")))
    )


_NOTHING = "NULL AS object, NULL AS point, NULL AS first_day, NULL AS last_day, NULL AS original, NULL AS method_detail, NULL AS record"


@query(
    "m19b_whole_transform",
    oracle(
        "SELECT 'claim' AS part, subject, predicate, value AS object, NULL::DOUBLE AS point, se AS first_day, sl AS last_day, original, method_detail, subject AS record FROM ("
        + " UNION ALL ".join(f"SELECT subject, predicate, value, se, sl, original, method_detail FROM ({q})" for q in (PRIMARY, ALIAS, LIFE, GENDER, DESCRIPTION, EXTERNAL))
        + f""") UNION ALL SELECT 'claim', subject, 'associated-with', object, point, se, el, original, NULL, external_id FROM ({TIE_CLAIM})
 UNION ALL SELECT 'entity', id, 'sdfb:person:1', {_NOTHING} FROM people0
 UNION ALL SELECT 'counter', counter, CAST(n AS VARCHAR), {_NOTHING} FROM ({COUNTERS})""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Every entity, claim and counter of the people mapping."""
    return _whole(*people.transform(people_rows(c), tie_rows(c)))


def _values(rows) -> str:
    """Registry rows as SQL."""
    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


@query(
    "m26_registries",
    oracle(
        f"""SELECT slug, label, range_kind, is_symmetric, count(predicate) AS uses
 FROM (VALUES {_values(PEOPLE_TYPES)}) v(slug, label, range_kind, is_symmetric) LEFT JOIN (
 SELECT predicate FROM ({PRIMARY}) UNION ALL SELECT predicate FROM ({ALIAS}) UNION ALL SELECT predicate FROM ({LIFE})
 UNION ALL SELECT predicate FROM ({GENDER}) UNION ALL SELECT predicate FROM ({DESCRIPTION}) UNION ALL SELECT predicate FROM ({EXTERNAL})
 UNION ALL SELECT 'associated-with' FROM ({TIE_CLAIM})) ON predicate=slug GROUP BY 1,2,3,4""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """The relation types that the people mapping registers, with the claims it makes of each."""
    _, claims, _ = people.transform(people_rows(c), tie_rows(c))
    uses = claims.groupBy(F.col("predicate").alias("slug")).agg(F.count("*").alias("uses"))
    return source_types(c.spark).join(uses, "slug", "left").fillna(0, ["uses"])


# Letters ---------------------------------------------------------------------------
LETTER_DATE = {
    0: {"when": "full"}, 1: {"when": "month"}, 2: {"when": "year"},
    3: {"notBefore": "year", "notAfter": "month"}, 4: {"from": "month"}, 5: {"when": "bad"}, 6: {},
}


def letter_rows(c: Corpus) -> DataFrame:
    """Orders as letters from the customer to the person numbered like the order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate").cast("string")
    forms = {
        "full": day, "month": F.substring(day, 1, 7), "year": F.substring(day, 1, 4), "bad": F.lit("spring 1600"),
    }

    def date(name: str) -> Column:
        expr = F.lit(None).cast("string")
        for rest, dates in LETTER_DATE.items():
            if name in dates:
                expr = F.when(key % 7 == rest, forms[dates[name]]).otherwise(expr)
        return expr

    def uri(ident: Column) -> Column:
        return F.concat(F.lit("http://d-nb.info/gnd/"), ident.cast("string"))

    sender = F.when(customer % 40 != 0, uri(customer))
    receiver = F.when(~F.col("o_orderpriority").startswith("5"), uri(key % 997))
    reply = F.when(key % 7 == 6, F.when(customer % 2 == 0, F.substring(day, 1, 4)))
    none = F.lit(None).cast("string")
    return c.table("orders").select(
        F.when(key % 50 != 0, F.concat(F.lit("L"), key.cast("string"))).alias("key"),
        F.concat(F.lit("https://example.org/letter/"), key.cast("string")).alias("ref"),
        sender.alias("sender"),
        receiver.alias("receiver"),
        F.concat(F.lit("Sender  "), customer.cast("string")).alias("sender_name"),
        F.when(key % 3 != 0, F.concat(F.lit("Reader "), (key % 997).cast("string"))).alias("receiver_name"),
        *[date(k).alias(f"d_{k}") for k in letters.DATE_KEYS],
        reply.alias("r_when"),
        none.alias("nothing"),
    )


def letter_frame(c: Corpus) -> DataFrame:
    """Letters in the layout the XML reader gives."""
    def action(uri: str, name: str, dates: dict[str, str]) -> Column:
        given = [F.col(dates.get(k, "nothing")).alias(k) for k in letters.DATE_KEYS]
        return F.struct(
            letters.gnd_id(F.col(uri)).alias("gnd"), normalize_name(F.col(name)).alias("name"), *given
        )

    raw = F.to_json(F.struct("key", "ref"))
    return letter_rows(c).select(
        "key", "ref",
        action("sender", "sender_name", {k: f"d_{k}" for k in letters.DATE_KEYS}).alias("sent"),
        action("receiver", "receiver_name", {"when": "r_when"}).alias("received"),
        raw.alias("raw"),
    )


LETTERS = {
    "letter0": """SELECT o_orderkey AS k, CASE WHEN o_orderkey%50<>0 THEN 'L'||o_orderkey END AS key,
 CASE WHEN o_custkey%40<>0 THEN CAST(o_custkey AS VARCHAR) END AS s, CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(o_orderkey%997 AS VARCHAR) END AS r,
 'Sender '||o_custkey AS sname, CASE WHEN o_orderkey%3<>0 THEN 'Reader '||(o_orderkey%997) END AS rname,
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CASE WHEN o_orderkey%7=6 AND o_custkey%2=0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS reply FROM orders""",
    "letter1": """SELECT *, k%7 AS f, CASE k%7 WHEN 0 THEN d WHEN 1 THEN d[1:7] WHEN 2 THEN d[1:4] WHEN 5 THEN 'spring 1600' END AS when_,
 CASE WHEN k%7=3 THEN d[1:4] END AS nb, CASE WHEN k%7=3 THEN d[1:7] END AS na, CASE WHEN k%7=4 THEN d[1:7] END AS fr FROM letter0""",
    "letter2": """SELECT *, CASE f WHEN 0 THEN CAST(d AS DATE) WHEN 1 THEN CAST(d[1:7]||'-01' AS DATE) WHEN 2 THEN CAST(d[1:4]||'-01-01' AS DATE)
  WHEN 3 THEN CAST(d[1:4]||'-01-01' AS DATE) WHEN 4 THEN CAST(d[1:7]||'-01' AS DATE) WHEN 6 THEN CAST(reply||'-01-01' AS DATE) END AS se,
 CASE f WHEN 0 THEN CAST(d AS DATE) WHEN 1 THEN CAST(d[1:7]||'-28' AS DATE) WHEN 2 THEN CAST(d[1:4]||'-12-31' AS DATE)
  WHEN 3 THEN CAST(d[1:7]||'-28' AS DATE) WHEN 4 THEN CAST(d[1:7]||'-01' AS DATE) WHEN 6 THEN CAST(reply||'-12-31' AS DATE) END AS sl,
 CASE f WHEN 0 THEN CAST(d AS DATE) WHEN 1 THEN CAST(d[1:7]||'-01' AS DATE) WHEN 2 THEN CAST(d[1:4]||'-01-01' AS DATE)
  WHEN 3 THEN CAST(d[1:4]||'-01-01' AS DATE) WHEN 4 THEN CAST(d[1:7]||'-01' AS DATE) WHEN 6 THEN CAST(reply||'-01-01' AS DATE) END AS ee,
 CASE f WHEN 0 THEN CAST(d AS DATE) WHEN 1 THEN CAST(d[1:7]||'-28' AS DATE) WHEN 2 THEN CAST(d[1:4]||'-12-31' AS DATE)
  WHEN 3 THEN CAST(d[1:7]||'-28' AS DATE) WHEN 6 THEN CAST(reply||'-12-31' AS DATE) END AS el FROM letter1""",
}


@query(
    "m20_letter_entities",
    oracle(
        """SELECT authority, id, entity_type, count(*) AS n FROM (SELECT 'gnd' AS authority, s AS id, 'person' AS entity_type FROM letter0 WHERE s IS NOT NULL
 UNION ALL SELECT 'gnd', r, 'person' FROM letter0 WHERE r IS NOT NULL UNION ALL SELECT 'correspsearch', key, 'document' FROM letter0 WHERE key IS NOT NULL) GROUP BY 1,2,3""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    return letters.letter_entities(letter_frame(c)).groupBy("ref.authority", "ref.id", "entity_type").agg(
        F.count("*").alias("n")
    )


@query("m21_gnd_id", oracle("SELECT k, s, r FROM letter0", LETTERS))
def _(c: Corpus) -> DataFrame:
    number = F.substring_index("ref", "/", -1).cast("bigint")
    return letter_rows(c).select(
        number.alias("k"), letters.gnd_id(F.col("sender")).alias("s"), letters.gnd_id(F.col("receiver")).alias("r")
    )


@query(
    "m22_letter_names",
    oracle(
        """SELECT subject, value, count(*) AS n FROM (SELECT s AS subject, sname AS value FROM letter0 WHERE s IS NOT NULL
 UNION ALL SELECT r, rname FROM letter0 WHERE r IS NOT NULL AND rname IS NOT NULL
 UNION ALL SELECT key, 'Letter: '||sname||' → '||coalesce(rname,'?')||coalesce(' ('||coalesce(when_,nb,reply)||')','') FROM letter1 WHERE key IS NOT NULL) GROUP BY 1,2""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    return letters.letter_names(letter_frame(c)).groupBy(
        F.col("subject.id").alias("subject"), F.col("object_literal.value").alias("value")
    ).agg(F.count("*").alias("n"))


@query(
    "m23_letter_ties",
    oracle(
        """SELECT s AS subject, r AS object, se AS se, el AS el, '{"direction":"sent","letter":'||coalesce('"'||key||'"','null')||'}' AS method_detail,
 coalesce(key,'https://example.org/letter/'||k) AS external_id FROM letter2 WHERE s IS NOT NULL AND r IS NOT NULL""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    return letters.letter_ties(letter_frame(c)).select(
        F.col("subject.id").alias("subject"),
        F.col("object_entity.id").alias("object"),
        F.col("valid_time.start_earliest").alias("se"),
        F.col("valid_time.end_latest").alias("el"),
        "method_detail",
        F.col("support")[0]["external_id"].alias("external_id"),
    )


@query(
    "m24_letter_interval",
    oracle("SELECT k, se AS start_earliest, sl AS start_latest, ee AS end_earliest, el AS end_latest FROM letter2", LETTERS),
)
def _(c: Corpus) -> DataFrame:
    span = F.coalesce(letters.letter_interval(F.col("sent")), letters.letter_interval(F.col("received")))
    rows = letter_frame(c).select(F.substring_index("ref", "/", -1).cast("bigint").alias("k"), span.alias("_v"))
    return rows.select("k", *[F.col("_v")[f"col{i + 1}"].alias(b) for i, b in enumerate(BOUNDS)])


@query(
    "m25_letter_counters",
    oracle(
        """SELECT 'letter_missing_sender_gnd' AS counter, count(*) AS n FROM letter0 WHERE s IS NULL
 UNION ALL SELECT 'letter_missing_receiver_gnd', count(*) FROM letter0 WHERE r IS NULL
 UNION ALL SELECT 'letter_bad_date', count(*) FROM letter1 WHERE f=5 AND s IS NOT NULL AND r IS NOT NULL
 UNION ALL SELECT 'letter_undated', count(*) FROM letter1 WHERE (f=5 OR (f=6 AND reply IS NULL)) AND s IS NOT NULL AND r IS NOT NULL""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    return letters.letter_counters(letter_frame(c))


@query(
    "m25b_letter_transform",
    oracle(
        f"""SELECT 'claim' AS part, s AS subject, 'has-name' AS predicate, sname AS object, NULL::DOUBLE AS point, NULL::DATE AS first_day, NULL::DATE AS last_day,
 NULL AS original, NULL AS method_detail, coalesce(key,'https://example.org/letter/'||k) AS record FROM letter2 WHERE s IS NOT NULL
 UNION ALL SELECT 'claim', r, 'has-name', rname, NULL, NULL, NULL, NULL, NULL, coalesce(key,'https://example.org/letter/'||k) FROM letter2 WHERE r IS NOT NULL AND rname IS NOT NULL
 UNION ALL SELECT 'claim', key, 'has-name', 'Letter: '||sname||' → '||coalesce(rname,'?')||coalesce(' ('||coalesce(when_,nb,reply)||')',''), NULL, NULL, NULL, NULL, NULL, key FROM letter2 WHERE key IS NOT NULL
 UNION ALL SELECT 'claim', s, 'corresponded-with', r, NULL, se, el, CASE WHEN f<=2 THEN '{{"when":"'||when_||'"}}' WHEN f=3 THEN '{{"notAfter":"'||na||'","notBefore":"'||nb||'"}}'
 WHEN f=4 THEN '{{"from":"'||fr||'"}}' WHEN f=6 THEN '{{"when":"'||reply||'"}}' END, '{{"direction":"sent","letter":'||coalesce('"'||key||'"','null')||'}}', coalesce(key,'https://example.org/letter/'||k)
 FROM letter2 WHERE s IS NOT NULL AND r IS NOT NULL
 UNION ALL SELECT 'entity', s, 'gnd:person:1', {_NOTHING} FROM letter0 WHERE s IS NOT NULL UNION ALL SELECT 'entity', r, 'gnd:person:1', {_NOTHING} FROM letter0 WHERE r IS NOT NULL
 UNION ALL SELECT 'entity', key, 'correspsearch:document:1', {_NOTHING} FROM letter0 WHERE key IS NOT NULL
 UNION ALL SELECT 'counter', 'letter_missing_sender_gnd', CAST(count(*) AS VARCHAR), {_NOTHING} FROM letter0 WHERE s IS NULL
 UNION ALL SELECT 'counter', 'letter_missing_receiver_gnd', CAST(count(*) AS VARCHAR), {_NOTHING} FROM letter0 WHERE r IS NULL
 UNION ALL SELECT 'counter', 'letter_bad_date', CAST(count(*) AS VARCHAR), {_NOTHING} FROM letter1 WHERE f=5 AND s IS NOT NULL AND r IS NOT NULL
 UNION ALL SELECT 'counter', 'letter_undated', CAST(count(*) AS VARCHAR), {_NOTHING} FROM letter1 WHERE (f=5 OR (f=6 AND reply IS NULL)) AND s IS NOT NULL AND r IS NOT NULL""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Every entity, claim and counter of the letter mapping."""
    return _whole(*letters.transform(letter_frame(c)))


@query(
    "m26b_letter_registries",
    oracle(
        f"""SELECT 'type' AS registry, slug, label, range_kind||':'||is_symmetric AS detail, (SELECT count(*) FROM letter2 WHERE s IS NOT NULL AND r IS NOT NULL) AS uses
 FROM (VALUES {_values(LETTER_TYPES)}) v(slug, label, range_kind, is_symmetric)
 UNION ALL SELECT 'authority', slug, label, CAST(bearing AS VARCHAR), CASE slug WHEN 'gnd' THEN (SELECT count(s)+count(r) FROM letter0) ELSE (SELECT count(key) FROM letter0) END
 FROM (VALUES {_values(LETTER_AUTHORITIES)}) v(slug, label, bearing)
 UNION ALL SELECT 'authority', slug, label, CAST(bearing AS VARCHAR), CASE slug WHEN 'sdfb' THEN (SELECT count(*) FROM people0) ELSE 0 END
 FROM (VALUES {_values(PEOPLE_AUTHORITIES)}) v(slug, label, bearing)""",
        LETTERS | PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """What both mappings register beside the people's types, with the claims and entities that use it."""
    entities, claims, _ = letters.transform(letter_frame(c))
    types = source_types(c.spark, LETTER_TYPES).join(claims.groupBy(F.col("predicate").alias("slug")).agg(F.count("*").alias("uses")), "slug", "left")
    named = entities.select("ref.authority").unionByName(people.people_entities(people_rows(c)).select("ref.authority"))
    authorities = source_authorities(c.spark, LETTER_AUTHORITIES + PEOPLE_AUTHORITIES).join(
        named.groupBy(F.col("authority").alias("slug")).agg(F.count("*").alias("uses")), "slug", "left"
    )
    return types.select(
        F.lit("type").alias("registry"), "slug", "label", F.concat_ws(":", "range_kind", "is_symmetric").alias("detail"), "uses"
    ).unionByName(authorities.select(
        F.lit("authority").alias("registry"), "slug", "label", F.col("identity_bearing").cast("string").alias("detail"), "uses"
    )).fillna(0, ["uses"])


# Sources -----------------------------------------------------------------------------
@query("s01_read_delimited", oracle(f"SELECT {', '.join(PEOPLE_COLUMNS)}, 'person' AS record_kind FROM people0", PEOPLE))
def _(c: Corpus) -> DataFrame:
    """People rows written as tab separated files and read back."""
    path = fresh_path(c.spark, "people") + ".tsv"
    options = {"header": True, "sep": "\t", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    people_rows(c).write.options(**options).csv(path)
    return delimited.read_delimited(c.spark, path, "person", PEOPLE_COLUMNS)


@query(
    "s03_read_letters",
    oracle(
        """SELECT key, 'https://example.org/letter/'||k AS ref, 'edition-1' AS edition, s, CASE WHEN s IS NOT NULL THEN sname END AS sname,
 when_ AS sent_when, nb, na, fr, r, rname, reply FROM (SELECT * REPLACE ('Sender  '||o AS sname) FROM (SELECT *, split_part(sname,' ',2) AS o FROM letter1))""",
        LETTERS,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Letters written as XML and read back."""
    path = fresh_path(c.spark, "letters")

    def person(uri: str, name: str) -> Column:
        return F.struct(F.col(name).alias("_VALUE"), F.col(uri).alias("_ref"))

    def dates(columns: dict[str, str]) -> Column:
        given = [F.col(columns.get(k, "nothing")) for k in letters.DATE_KEYS]
        filled = F.concat_ws("", *given)
        return F.when(filled != "", F.struct(*[g.alias(f"_{k}") for g, k in zip(given, letters.DATE_KEYS, strict=True)]))

    sent = F.struct(
        F.lit("sent").alias("_type"),
        F.when(F.col("sender").isNotNull(), person("sender", "sender_name")).alias("persName"),
        dates({k: f"d_{k}" for k in letters.DATE_KEYS}).alias("date"),
    )
    received = F.struct(
        F.lit("received").alias("_type"),
        F.when(F.col("receiver").isNotNull() | F.col("receiver_name").isNotNull(), person("receiver", "receiver_name")).alias("persName"),
        dates({"when": "r_when"}).alias("date"),
    )
    rows = letter_rows(c).select(
        F.col("key").alias("_key"), F.col("ref").alias("_ref"), F.lit("#edition-1").alias("_source"),
        F.array(sent, received).alias("correspAction"),
    )
    rows.write.format("xml").option("rowTag", "correspDesc").option("rootTag", "list").save(path)
    s, r = F.col("sent"), F.col("received")
    return read_letters(c.spark, path).select(
        "key", "ref", "edition", s["gnd"].alias("s"), s["name"].alias("sname"), s["when"].alias("sent_when"),
        s["notBefore"].alias("nb"), s["notAfter"].alias("na"), s["from"].alias("fr"),
        r["gnd"].alias("r"), r["name"].alias("rname"), r["when"].alias("reply"),
    )


@query(
    "s04_read_ndjson",
    """SELECT line, n, line='{broken' AS broken FROM (SELECT CASE o_orderstatus WHEN 'P' THEN '{broken'
 ELSE '{"o_custkey":'||o_custkey||'}' END AS line, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1)""",
)
def _(c: Corpus) -> DataFrame:
    """Lines written as text, some blank and some broken, and read back."""
    path = fresh_path(c.spark, "lines")
    line = (
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("  "))
        .when(F.col("o_orderstatus") == "P", F.lit("{broken"))
        .otherwise(F.to_json(F.struct("o_custkey")))
    )
    ndjson.write_ndjson(c.table("orders").select(line.alias("line")), path)
    counted = ndjson.read_ndjson(c.spark, path).groupBy("line").agg(F.count("*").alias("n"))
    return counted.withColumn("broken", F.try_parse_json("line").isNull())


@query(
    "s04b_numbered_lines",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, '{"o_orderkey":'||o_orderkey||',"o_custkey":'||o_custkey||'}' AS line FROM orders""",
)
def _(c: Corpus) -> DataFrame:
    """Orders written as lines of many files in the order of their keys, and read back with line numbers."""
    path = fresh_path(c.spark, "numbered-lines")
    line = F.to_json(F.struct("o_orderkey", "o_custkey"))
    ndjson.write_ndjson(c.table("orders").orderBy("o_orderkey").select(line.alias("line")), path)
    return ndjson.read_ndjson(c.spark, path).select("line_no", "line")


def _json_date(name: str) -> str:
    return f"""CASE WHEN {name} IS NULL THEN 'null' ELSE '"'||{name}||'"' END"""


@query(
    "s05_to_ndjson",
    oracle(
        f"""SELECT '{{"asserted_by":"pipeline","confidence":{{"calibrated":false,"kind":"source_native_scalar","point":'||CAST(score/100.0::DOUBLE AS VARCHAR)||
 ',"raw":'||score||',"scale":"sdfb_max_certainty_0_100"}},"method":"imported","object":{{"entity":{{"authority":"sdfb","id":"'||greatest(p1,p2)||
 '"}}}},"predicate":"associated-with","schema_version":"0.1.0","subject":{{"authority":"sdfb","id":"'||least(p1,p2)||
 '"}},"support":[{{"content_hash":"sha256:'||sha256({RAW_ROW})||'","external_id":"'||CASE WHEN id='' THEN p1||'-'||p2 ELSE id END||'","raw":'||{RAW_ROW}||
 ',"record_kind":"relationship","source":"sdfb-2017-10-13"}}],"valid_time":{{'||CASE WHEN inv THEN '"original":'||{ORIGINAL} ELSE
 '"approximate":'||circa||',"end_earliest":'||{_json_date('ee0')}||',"end_latest":'||{_json_date('el0')}||',"original":'||{ORIGINAL}||
 ',"start_earliest":'||{_json_date('se0')}||',"start_latest":'||{_json_date('sl0')} END||'}}}}' AS line FROM rows2 WHERE known""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return ndjson.claim_lines(people.relationship_claims(tie_rows(c), people_rows(c)))


@query(
    "s05b_entity_lines",
    oracle(
        """SELECT '{"entity_type":"person","external_ids":[{"authority":"sdfb","id":"'||id||'"}],"ref":{"authority":"sdfb","id":"'||id||'"},"schema_version":"0.1.0"}' AS line FROM people0""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return ndjson.entity_lines(people.people_entities(people_rows(c)))


@query(
    "s06_content_hash",
    """SELECT doc_id, 'sha256:'||sha256('{"id":'||doc_id||',"lang":'||to_json(lang)||',"n_chars":'||n_chars||',"source":'||to_json(source)||',"text":'||to_json(text)||'}') AS record_hash,
 sha256('{"id":'||doc_id||',"mark":"'||chr(92)||'u00e9'||chr(92)||'ud83d'||chr(92)||'ude00","source":"'||source||'"}')[1:16] AS letter_hash FROM documents""",
)
def _(c: Corpus) -> DataFrame:
    """Hashes of every column of every document, keys given out of order."""
    record = F.to_json(F.struct("source", "text", "n_chars", "lang", F.col("doc_id").alias("id")))
    letter = F.to_json(F.struct("source", F.lit("é😀").alias("mark"), F.col("doc_id").alias("id")))
    return c.table("documents").select(
        "doc_id", content_hash(record).alias("record_hash"), content_hash(letter, "letter").alias("letter_hash")
    )


@query(
    "s07_export_claims",
    oracle("""SELECT claim_id, subject_entity_id AS subject, predicate, object_entity_id AS object, confidence_point AS confidence, f AS format
 FROM claims, (VALUES ('csv'),('ndjson')) v(f) WHERE status='asserted'"""),
)
def _(c: Corpus) -> DataFrame:
    """Both export formats, all licences taken as confirmed, read back."""
    confirmed = c.sources.withColumn("license_confirmed", F.lit(True))
    blocked = blocked_sources(confirmed, c.records, c.support)
    layout = "claim_id string, subject bigint, predicate string, object bigint, confidence double"
    parts = []
    for name in ("csv", "ndjson"):
        path = fresh_path(c.spark, "export")
        export.export_claims(c.claims, blocked, path, name)
        reader = c.spark.read.schema(layout)
        rows = reader.option("header", True).csv(path) if name == "csv" else reader.json(path)
        parts.append(rows.withColumn("format", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query(
    "s08_manifest",
    oracle(
        """SELECT 'run-1' AS run_id, 'orders' AS source_slug, (SELECT count(*) FROM people0 WHERE odnb_id IN ('','0')) AS odnb_zero_sentinel,
 (SELECT count(*) FROM rows2 WHERE NOT known) AS dangling,
 (SELECT count(*) FROM people0) AS people, (SELECT count(*) FROM customer) AS customers,
 (SELECT CAST(sum(('0x'||substr(md5(CAST(c_custkey AS VARCHAR)||'|'||c_name), 1, 8))::BIGINT) AS VARCHAR) FROM customer) AS customer_digest""",
        PEOPLE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """A run manifest written and read back."""
    path = fresh_path(c.spark, "manifests")
    # Order-free: the sum of the rows' digests.
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "c_custkey", "c_name").cast("binary")), 1, 8), 16, 10)
    customers = c.table("customer").agg(
        F.count("*").alias("n"), F.sum(digest.cast("long")).cast("string").alias("digest")
    ).first()
    counts = {"people": people_rows(c).count(), "customers": customers["n"]}
    row = manifest.manifest_row(
        c.spark, run_id="run-1", adapter="people", adapter_version="1", source_slug="orders",
        source_version="1", input_content_hashes={"customer": customers["digest"]}, counts=counts,
        anomaly_counters=people.anomaly_counters(people_rows(c), tie_rows(c)),
    )
    manifest.write_manifest(row, path)

    def counter(name: str) -> Column:
        return F.get_json_object("manifest", f"$.anomaly_counters.{name}").cast("bigint")

    return manifest.read_manifests(c.spark, path).select(
        "run_id", "source_slug", counter("odnb_zero_sentinel").alias("odnb_zero_sentinel"),
        counter("relationship_dangling_endpoint_skipped").alias("dangling"),
        F.get_json_object("manifest", "$.counts.people").cast("bigint").alias("people"),
        F.get_json_object("manifest", "$.counts.customers").cast("bigint").alias("customers"),
        F.get_json_object("manifest", "$.input_content_hashes.customer").alias("customer_digest"),
    )


# Import --------------------------------------------------------------------------------
# What a line is made of. Rows are numbered while they hold only this: their lines are several times as long.
TIE_PARTS = (
    "claim_id", "subject_entity_id", "object_entity_id", "predicate", "confidence_point", *BOUNDS, "source_id",
    "external_id", "content_hash", "second_support", "asserted_by_agent_id", "recorded_at", "quantity",
)
# A hash is as long as the rest of a row and does not compress, so it and the record's key are made after the numbering.
_DERIVED = ("external_id", "content_hash")
TIE_KEYS = tuple(n for n in TIE_PARTS if n not in _DERIVED) + ("order_key", "line_number", "part_key", "shipped")


def with_records(ties: DataFrame) -> DataFrame:
    """Ties of :data:`TIE_KEYS` with the key and the content hash of their records."""
    supplier = F.expr("(-object_entity_id - 1) div 2")
    return ties.withColumns(
        {
            "external_id": line_external_id(F.col("order_key"), F.col("line_number")),
            "content_hash": line_content_hash(F.col("part_key"), supplier, F.col("shipped")),
        }
    )


def tie_lines(ties: DataFrame) -> DataFrame:
    """``claim_id, line``: order lines as interchange lines; the quantity decides the defect, if any.

    A number that the ties have goes with their lines.
    """
    q = F.col("quantity")

    def ref(authority: str, key: Column) -> Column:
        return F.struct(F.lit(authority).alias("authority"), key.alias("id"))

    text = F.col("subject_entity_id").cast("string")
    other = F.expr("(-object_entity_id - 1) div 2").cast("string")
    subject = ref("registry", F.when(q == 10, F.concat(F.lit("x"), text)).otherwise(text))
    entity = ref("ledger", F.when(q == 11, F.concat(F.lit("x"), other)).otherwise(other))
    literal = F.struct(
        F.when(q == 19, "colour").otherwise("string").alias("kind"), F.lit("X").alias("value")
    )
    scored = F.col("confidence_point").isNotNull() & ~q.isin(3)
    point = F.when(q == 2, 9.9).when(q == 3, 0.5).when(scored, F.col("confidence_point"))
    confidence = F.when(
        q != 16,
        F.struct(
            F.when(scored | (q == 2) | (q == 6), "source_native_scalar").otherwise("unscored").alias("kind"),
            F.when(scored | (q == 2) | (q == 6), "s").alias("scale"),
            F.when(scored | (q == 2) | (q == 6), 1).alias("raw"),
            F.when(q == 6, 0.5).otherwise(point).alias("point"),
            F.when(q == 6, True).when(scored | (q == 2), False).alias("calibrated"),
        ),
    )
    bounds = F.struct(
        *[
            (F.when(q == 13, F.lit("15-1-1")).otherwise(F.col(b).cast("string")) if b == BOUNDS[0] else F.col(b).cast("string")).alias(b)
            for b in BOUNDS
        ]
    )

    def record(source: Column, kind: str, key: Column, digest: Column) -> Column:
        return F.struct(
            source.alias("source"), F.lit(kind).alias("record_kind"), key.alias("external_id"),
            digest.alias("content_hash"), F.struct(F.lit(1).alias("v")).alias("raw"),
        )

    slug = F.concat(F.lit("source-"), F.col("source_id").cast("string"))
    primary = record(
        slug, "relationship", F.when(q == 17, "").otherwise(F.col("external_id")), F.col("content_hash")
    )
    book = record(
        F.lit("books"), "supplier", other, F.concat(F.lit("h"), F.col("asserted_by_agent_id").cast("string"), F.month("recorded_at").cast("string"))
    )
    support = (
        F.when(q == 5, F.array().cast("array<struct<source:string,record_kind:string,external_id:string,content_hash:string,raw:struct<v:int>>>"))
        .when(F.col("second_support"), F.array(primary, book))
        .otherwise(F.array(primary))
    )
    line = F.to_json(
        F.struct(
            F.when(q == 1, "1.0.0").otherwise("0.1.0").alias("schema_version"),
            F.when(q == 18, F.to_json(F.struct(subject.alias("s")))).alias("_never"),
            subject.alias("subject"),
            F.when(q == 7, "Bad Slug").when(q == 9, "knows-of").otherwise(F.col("predicate")).alias("predicate"),
            F.struct(
                F.when(q != 19, entity).alias("entity"), F.when(q.isin(4, 19), literal).alias("literal")
            ).alias("object"),
            bounds.alias("valid_time"),
            confidence.alias("confidence"),
            F.when(q == 14, "guessed").otherwise("imported").alias("method"),
            F.when(q == 15, "").otherwise("pipeline").alias("asserted_by"),
            support.alias("support"),
            F.when(q == 12, 1).alias("extra"),
        ).dropFields("_never")
    )
    # Named before its defects are made, or each of them would write the line anew.
    made = ties.withColumn("_line", line)
    line = F.col("_line")
    line = (
        F.when(q == 18, F.regexp_replace(line, '"subject":\\{', '"subject":{"more":1,'))
        .when(q == 8, F.substring(line, F.lit(1), F.length(line) - 1))
        .otherwise(line)
    )
    return made.select("claim_id", line.alias("line"), *[n for n in ties.columns if n == "line_no"])


def wire_rows(c: Corpus) -> DataFrame:
    """A batch of all order lines; those of returned goods are sent a second time at its end."""
    turns = F.when(F.col("predicate") == "corresponded-with", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = c.ties.select(*TIE_KEYS).withColumn("turn", F.explode(turns))
    return tie_lines(with_records(numbered(sent, "turn", "claim_id")))


def wire_lines(c: Corpus) -> DataFrame:
    return wire_rows(c).drop("claim_id")


DEFECT = """CASE quantity WHEN 1 THEN 'schema_version is not 0.1.0' WHEN 2 THEN 'confidence is malformed' WHEN 3 THEN 'confidence is malformed'
 WHEN 4 THEN 'object is not exactly one of entity and literal' WHEN 5 THEN 'support is empty or malformed' WHEN 6 THEN 'confidence is malformed'
 WHEN 7 THEN 'predicate is not a slug' WHEN 8 THEN 'invalid JSON' WHEN 12 THEN 'an unknown key is present' WHEN 13 THEN 'valid_time is malformed'
 WHEN 14 THEN 'method is unknown' WHEN 15 THEN 'asserted_by is blank' WHEN 16 THEN 'a required key is missing|confidence is malformed'
 WHEN 17 THEN 'support is empty or malformed' WHEN 18 THEN 'subject is not a reference' WHEN 19 THEN 'object literal is malformed' ELSE '' END"""
WIRE = {
    "wire": """SELECT *, row_number() OVER (ORDER BY turn, claim_id) AS line_no FROM (
 SELECT *, 0 AS turn FROM ties UNION ALL SELECT *, 1 FROM ties WHERE predicate='corresponded-with')""",
    "judged": f"""SELECT *, {DEFECT} AS errors, CASE WHEN quantity=8 THEN 'invalid JSON'
 WHEN ({DEFECT})<>'' THEN 'schema: '||split_part({DEFECT},'|',1) WHEN quantity=9 THEN 'unknown predicate ''knows-of'''
 WHEN quantity=10 THEN 'unresolvable subject ref registry:x'||subject_entity_id
 WHEN quantity=11 THEN 'unresolvable object ref ledger:x'||((-object_entity_id-1)//2) END AS reason FROM wire""",
    "good": "SELECT * FROM judged WHERE reason IS NULL",
    "supports": """SELECT line_no, 0 AS position, 'source-'||source_id AS source, 'relationship' AS record_kind, external_id, content_hash, claim_id FROM good
 UNION ALL SELECT line_no, 1, 'books', 'supplier', CAST((-object_entity_id-1)//2 AS VARCHAR), 'h'||asserted_by_agent_id||month(recorded_day), claim_id FROM good WHERE second_support""",
    "firsts": """SELECT *, lag(content_hash) OVER (PARTITION BY source, record_kind, external_id ORDER BY line_no, position) AS prior FROM (
 SELECT *, row_number() OVER (PARTITION BY source, record_kind, external_id, content_hash ORDER BY line_no, position) AS rn FROM supports) WHERE rn=1""",
    "outcome": """SELECT s.*, CASE WHEN f.line_no IS NULL THEN 'DUPLICATE' WHEN f.prior IS NULL THEN 'INSERTED' ELSE 'SUPERSEDED' END AS outcome
 FROM supports s LEFT JOIN firsts f ON f.line_no=s.line_no AND f.position=s.position""",
    "stored": "SELECT * FROM ties WHERE method='imported'",
    "fresh": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_id, content_hash, subject_entity_id, predicate, object_entity_id,
 start_earliest, end_latest, confidence_point ORDER BY line_no) AS rn FROM good g WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source_id=g.source_id AND
 s.external_id=g.external_id AND s.content_hash=g.content_hash AND s.subject_entity_id=g.subject_entity_id AND s.predicate=g.predicate AND s.object_entity_id=g.object_entity_id
 AND s.start_earliest IS NOT DISTINCT FROM g.start_earliest AND s.end_latest IS NOT DISTINCT FROM g.end_latest AND s.confidence_point IS NOT DISTINCT FROM g.confidence_point)) WHERE rn=1""",
}


def store(c: Corpus, written: bool = True) -> ingest.Store:
    """A store that holds the claims of finished order lines, but none of the records.

    Records are empty so that every version of the batch is new to it. ``written``: its claims are derived once and
    written, for imports that look for duplicates and so read them and their support.
    """
    held = c.ties.where(F.col("method") == "imported")
    if written:
        held = materialise(held.select("claim_id", *ingest.IDENTITY, "source_id", *_DERIVED), "held")
    keyed = held.withColumns(
        {
            "source": F.concat(F.lit("source-"), F.col("source_id").cast("string")),
            "record_kind": F.lit("relationship"),
        }
    )
    support = keyed.select("claim_id", ingest.record_id().alias("source_record_id"))
    records = c.spark.createDataFrame(
        [],
        "source_record_id string, source string, record_kind string, external_id string, "
        "content_hash string, raw string, arrival bigint, supersedes_record_id string",
    )
    known = c.sources.where(F.col("license_confirmed")).withColumn(
        "slug", F.concat(F.lit("source-"), F.col("source_id").cast("string"))
    )
    return ingest.Store(c.relation_types, c.anchors, known, records, held, support)


def imported(c: Corpus, lines: DataFrame | None = None, into: ingest.Store | None = None) -> dict[str, DataFrame]:
    return ingest.import_claims(
        wire_lines(c) if lines is None else lines, into or store(c), batch_no=0, agent_id=1, run_id="run-1",
        recorded_at=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"),
    )


@query("i01_validate_claims", oracle("SELECT line_no, errors FROM judged", WIRE))
def _(c: Corpus) -> DataFrame:
    return validate.validate_claims(wire_lines(c)).select("line_no", F.array_join("errors", "|").alias("errors"))


ENTITY_LINES = {
    "lines": """SELECT o_orderkey AS line_no, o_custkey AS id, 'h'||(o_custkey%100) AS house, o_orderstatus='P' AND o_orderpriority LIKE '1%' AS bad FROM orders""",
    "known": "SELECT c_custkey AS id FROM customer WHERE c_mktsegment='BUILDING'",
    "made": "SELECT min(line_no) AS line_no, id FROM lines WHERE NOT bad AND id NOT IN (SELECT id FROM known) GROUP BY id",
}


def entity_line_rows(c: Corpus) -> DataFrame:
    """Each order announces its customer and the household the customer belongs to."""
    key = F.col("o_custkey")
    ref = F.struct(F.lit("registry").alias("authority"), key.cast("string").alias("id"))
    house = F.struct(
        F.lit("household").alias("authority"), F.concat(F.lit("h"), (key % 100).cast("string")).alias("id")
    )
    line = F.to_json(
        F.struct(F.lit("0.1.0").alias("schema_version"), ref.alias("ref"), F.lit("person").alias("entity_type"), F.array(ref, house).alias("external_ids"))
    )
    bad = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("1")
    return c.table("orders").select(
        F.col("o_orderkey").alias("line_no"), F.when(bad, F.replace(line, F.lit('"person"'), F.lit("5"))).otherwise(line).alias("line")
    )


def entity_import(c: Corpus) -> dict[str, DataFrame]:
    known = c.table("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.lit("registry").alias("authority"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_custkey").alias("entity_id")
    )
    return ingest.import_entities(entity_line_rows(c), known, 0)


@query("i02_validate_entities", oracle("SELECT line_no, CASE WHEN bad THEN 'entity_type is not text' ELSE '' END AS errors FROM lines", ENTITY_LINES))
def _(c: Corpus) -> DataFrame:
    return validate.validate_entities(entity_line_rows(c)).select("line_no", F.array_join("errors", "|").alias("errors"))


@query(
    "i03_validation_report",
    oracle(
        """SELECT 'lines' AS item, count(*) AS n FROM judged UNION ALL SELECT 'failed lines', count(*) FROM judged WHERE errors<>''
 UNION ALL SELECT item, count(*) FROM (SELECT unnest(string_split(errors,'|')) AS item FROM judged WHERE errors<>'') GROUP BY 1""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return validate.validation_report(validate.validate_claims(wire_lines(c)))


@query("i04_check_predicate", oracle("SELECT line_no, quantity<>9 AS known_predicate FROM judged WHERE errors=''", WIRE))
def _(c: Corpus) -> DataFrame:
    parsed = validate.parse_claims(validate.validate_claims(wire_lines(c))).where(F.size("errors") == 0)
    return ingest.check_predicate(parsed, c.relation_types).select("line_no", "known_predicate")


@query(
    "i05_resolve_refs",
    oracle(
        """SELECT line_no, CASE WHEN quantity<>10 THEN subject_entity_id END AS subject_entity_id,
 CASE WHEN quantity<>11 THEN object_entity_id END AS object_entity_id FROM judged WHERE errors=''""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    parsed = validate.parse_claims(validate.validate_claims(wire_lines(c))).where(F.size("errors") == 0)
    return ingest.resolve_refs(parsed, c.anchors).select("line_no", "subject_entity_id", "object_entity_id")


@query("i06_split_rejects", oracle("SELECT line_no, reason FROM judged", WIRE))
def _(c: Corpus) -> DataFrame:
    classified = ingest.classify_lines(wire_lines(c), c.relation_types, c.anchors).select("line_no", "reason")
    good, bad = ingest.split_rejects(materialise(classified, "classified"))  # both halves read the verdicts
    return good.select("line_no", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query(
    "i07_import_entities",
    oracle(
        """SELECT 'entity' AS row, line_no AS id, 'person' AS detail FROM made
 UNION ALL SELECT 'registry', line_no, CAST(id AS VARCHAR) FROM made
 UNION ALL SELECT 'household', min(m.line_no), house FROM made m JOIN lines l ON l.line_no=m.line_no GROUP BY house
 UNION ALL SELECT 'duplicate', line_no, NULL FROM lines WHERE NOT bad AND line_no NOT IN (SELECT line_no FROM made)
 UNION ALL SELECT 'reject', line_no, 'schema: entity_type is not text' FROM lines WHERE bad""",
        ENTITY_LINES,
    ),
)
def _(c: Corpus) -> DataFrame:
    out = entity_import(c)
    made = out["entities"].select(F.lit("entity").alias("row"), F.col("entity_id").alias("id"), F.col("entity_type").alias("detail"))
    anchors = out["anchors"].select(F.col("authority").alias("row"), F.col("entity_id").alias("id"), F.col("external_id").alias("detail"))
    again = out["duplicates"].select(F.lit("duplicate").alias("row"), F.col("line_no").alias("id"), F.lit(None).cast("string").alias("detail"))
    bad = out["rejects"].select(F.lit("reject").alias("row"), F.col("line_no").alias("id"), F.col("reason").alias("detail"))
    return made.unionByName(anchors).unionByName(again).unionByName(bad)


@query(
    "i08_upsert_sources",
    oracle(
        """SELECT slug, slug AS title, 'unknown' AS version, false AS license_confirmed FROM (SELECT DISTINCT source AS slug FROM supports)
 WHERE slug NOT IN (SELECT 'source-'||r_regionkey FROM region WHERE r_regionkey%2=0)""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return imported(c)["sources"].select("slug", "title", "version", "license_confirmed")


@query(
    "i09_version_records",
    oracle("SELECT source, record_kind, external_id, content_hash, prior, line_no AS arrival FROM firsts", WIRE),
)
def _(c: Corpus) -> DataFrame:
    """New records with the content of the version they supersede."""
    records = imported(c)["records"]
    prior = records.select(
        F.col("source_record_id").alias("supersedes_record_id"), F.col("content_hash").alias("prior")
    )
    return records.join(prior, "supersedes_record_id", "left").select(
        "source", "record_kind", "external_id", "content_hash", "prior", "arrival"
    )


@query("i10_dedupe_claims", oracle("SELECT line_no FROM fresh", WIRE))
def _(c: Corpus) -> DataFrame:
    return imported(c)["claims"].select(F.col("claim_id").alias("line_no"))


@query(
    "i11_append_claims",
    oracle(
        """SELECT line_no AS claim_id, subject_entity_id, predicate, object_entity_id, start_earliest, start_latest, end_earliest, end_latest,
 CASE WHEN confidence_point IS NULL THEN 'unscored' ELSE 'source_native_scalar' END AS confidence_kind, confidence_point, 'imported' AS method, 'run-1' AS import_run_id FROM fresh""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return imported(c)["claims"].select(
        "claim_id", "subject_entity_id", "predicate", "object_entity_id", *BOUNDS, "confidence_kind",
        "confidence_point", "method", "import_run_id",
    )


@query(
    "i12_support_links",
    oracle(
        "SELECT DISTINCT s.line_no AS claim_id, s.source, s.external_id, s.content_hash FROM supports s WHERE s.line_no IN (SELECT line_no FROM fresh)",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    out = imported(c)
    named = out["records"].select("source_record_id", "source", "external_id", "content_hash")
    return out["support"].join(named, "source_record_id").drop("source_record_id")


@query("i13_assert_events", oracle("SELECT 'assert-'||line_no AS id, line_no AS claim_id, 'assert' AS event_type, 1::BIGINT AS actor_agent_id FROM fresh", WIRE))
def _(c: Corpus) -> DataFrame:
    return imported(c)["events"].select("id", "claim_id", "event_type", "actor_agent_id")


@query("i14_initial_confidence", oracle("SELECT line_no AS claim_id, confidence_point, 'source' AS origin FROM fresh", WIRE))
def _(c: Corpus) -> DataFrame:
    return imported(c)["confidence"].select("claim_id", "confidence_point", "origin")


@query(
    "i15_import_report",
    oracle(
        """SELECT (SELECT count(*) FROM judged) AS received, (SELECT count(*) FROM fresh) AS inserted,
 (SELECT count(*) FROM good)-(SELECT count(*) FROM fresh) AS duplicates,
 (SELECT count(*) FROM outcome WHERE outcome='SUPERSEDED') AS superseded, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS rejected""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return imported(c)["report"]


@query(
    "i15b_second_import",
    oracle(
        """SELECT (SELECT count(*) FROM judged) AS received, 0::BIGINT AS inserted, (SELECT count(*) FROM good) AS duplicates,
 0::BIGINT AS superseded, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS rejected""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """The same lines a second time, on the store that the first import left: nothing is new."""
    lines, before = wire_lines(c), store(c)
    out = imported(c, lines, before)
    first = {k: materialise(out[k], k) for k in ("claims", "support")} | {"records": out["records"]}
    text = F.col("claim_id").cast("string")
    after = ingest.Store(
        before.relation_types, before.anchors, before.sources, first["records"],
        before.claims.select("claim_id", *ingest.IDENTITY).unionByName(
            first["claims"].withColumn("claim_id", text).select("claim_id", *ingest.IDENTITY)
        ),
        before.support.unionByName(first["support"].withColumn("claim_id", text)),
    )
    return ingest.import_claims(
        lines, after, batch_no=1, agent_id=1, run_id="run-2",
        recorded_at=F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"),
    )["report"]


@query(
    "i17_check_claims",
    oracle("""SELECT claim_id, unnest(string_split(v,'|')) AS violation FROM (SELECT claim_id, concat_ws('|',
 CASE WHEN approximate THEN 'object is not exactly one of entity and literal' END,
 CASE WHEN quantity>=25 AND confidence_point IS NULL THEN 'scored claim carries no point' WHEN quantity<25 AND confidence_point IS NOT NULL THEN 'unscored claim carries a point' END,
 CASE WHEN se0>sl0 THEN 'start bounds are out of order' END, CASE WHEN ee0>el0 THEN 'end bounds are out of order' END) AS v FROM ties) WHERE v<>''"""),
)
def _(c: Corpus) -> DataFrame:
    """Ties with mixed-up kinds and literal objects, checked against the store rules."""
    broken = c.ties.withColumns(
        {
            "confidence_kind": F.when(F.col("quantity") >= 25, "source_native_scalar").otherwise("unscored"),
            "object_literal": F.when(F.col("approximate"), F.lit("{}")),
        }
    )
    return validate.check_claims(broken)


# Actions that write claims ---------------------------------------------------------------
@query(
    "a05_supersede",
    oracle(
        """SELECT seq, claim_id, CASE WHEN refusal IS NULL THEN line_no END AS new_claim_id, refusal FROM (SELECT line_no AS seq, claim_id, line_no,
 CASE WHEN status='superseded' OR row_number() OVER (PARTITION BY claim_id ORDER BY line_no)>1 THEN 'claim is superseded'
  WHEN reason IS NOT NULL THEN 'replacement is not valid' END AS refusal FROM judged)""",
        WIRE,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Every line of the batch offered as the replacement of its own tie."""
    rows = wire_rows(c)
    lines = rows.drop("claim_id")
    new = ingest.import_claims(
        lines, store(c, written=False), batch_no=0, agent_id=1, run_id="run-2",
        recorded_at=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), check_duplicates=False,
    )["claims"].select(F.col("claim_id").alias("seq"), F.col("claim_id").alias("new_claim_id"))
    none = F.lit(None)
    actions = rows.select(
        F.col("line_no").alias("seq"), F.lit("supersede").alias("kind"),
        "claim_id", none.cast("string").alias("ground"),
        F.lit("newer reading").alias("reason"), none.cast("double").alias("point"), F.lit(1).alias("agent_id"),
        F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("occurred_at"), none.cast("string").alias("as_of"),
    )
    events, refused = acts.supersede(acts.judge(actions, c.ties.select("claim_id", "status")), new)
    accepted = events.select(
        F.substring_index("id", "-", -1).cast("long").alias("seq"), "claim_id",
        F.get_json_object("payload", "$.supersededBy").cast("bigint").alias("new_claim_id"),
        none.cast("string").alias("refusal"),
    )
    return accepted.unionByName(
        refused.select("seq", "claim_id", none.cast("bigint").alias("new_claim_id"), "refusal")
    )


@query("a06_assert_claims", oracle("SELECT line_no AS claim_id, subject_entity_id, object_entity_id, predicate FROM good", WIRE))
def _(c: Corpus) -> DataFrame:
    """Single-claim asserts: every valid line becomes a claim, repeats included."""
    out = ingest.import_claims(
        wire_lines(c), store(c, written=False), batch_no=0, agent_id=1, run_id="run-3",
        recorded_at=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), check_duplicates=False,
    )
    return out["claims"].select("claim_id", "subject_entity_id", "object_entity_id", "predicate")
