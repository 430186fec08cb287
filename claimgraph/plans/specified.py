"""Queries for as-of reads, canonical ids, resolution and calibration: X operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.operators import calibration, canonical, graph, resolution
from claimgraph.operators.asof import as_of
from claimgraph.operators.history import current_confidence
from claimgraph.plans.columns import Y98, YEAR_98
from claimgraph.plans.corpus import Corpus, part_id
from claimgraph.plans.oracle import oracle, possibly
from claimgraph.plans.registry import query
from claimgraph.session import materialise

CUT = "2024-01-15 00:00:00"
PAST = {
    "user_events": f"""SELECT 'u-'||event_id AS id, 'a-'||user_id||'-'||(event_id%10) AS claim_id, ts AS occurred_at,
 CASE event_type WHEN 'signup' THEN 'assert' WHEN 'error' THEN 'dispute' WHEN 'view' THEN 'undispute'
 ELSE CASE WHEN event_type='click' AND event_id%97=0 THEN 'supersede' ELSE 'adjust_confidence' END END AS event_type,
 user_id%25 AS actor_agent_id, round(value/500,2) AS point FROM events WHERE ts <= TIMESTAMP '{CUT}'""",
}


@query(
    "x01_as_of",
    oracle(
        """SELECT claim_id, status, confidence_point, origin FROM current_attributes UNION ALL
 SELECT claim_id, CASE WHEN recorded_day + CASE WHEN quantity>=50 THEN 30 WHEN quantity>=46 THEN 10 ELSE 0 END <= DATE '2024-01-15' THEN status ELSE 'asserted' END,
 confidence_point, CASE WHEN confidence_point IS NULL THEN 'unscored' ELSE 'source' END FROM ties WHERE recorded_day <= DATE '2024-01-15'""",
        PAST,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Status and confidence of every claim as known in mid January 2024."""
    at = F.lit(CUT).cast("timestamp_ntz")
    return as_of(c.recorded_claims, c.events, at).select(
        "claim_id", "status", "confidence_point", "origin"
    )


@query(
    "x01b_network_as_of",
    oracle(
        f"""SELECT subject_entity_id AS entity_id, count(*) AS ties FROM ties WHERE recorded_day <= DATE '1998-06-30'
 AND (quantity<41 OR quantity>=50 AND recorded_day+30>DATE '1998-06-30' OR (quantity>=41 AND quantity<50 AND recorded_day+10>DATE '1998-06-30')
  OR (quantity>=41 AND quantity<46 AND recorded_day+20<=DATE '1998-06-30'))
 AND confidence_point>=0.6 AND {possibly(*Y98)} GROUP BY 1""",
    ),
)
def _(c: Corpus) -> DataFrame:
    """Ego sizes of customers as they stood at the end of June 1998."""
    at = F.lit("1998-06-30 12:00:00").cast("timestamp_ntz")
    past = as_of(c.recorded_claims, c.events, at)
    ties = graph.active_ties(past, 0.6, *YEAR_98)
    return ties.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count("*").alias("ties"))


# Chains of same-as claims are three links at most, so four rounds reach every end.
CANON = {
    "links": """SELECT subject_entity_id AS a, object_entity_id AS b FROM current_attributes WHERE predicate='same-as' AND status='asserted'""",
    "twoway": "SELECT a, b FROM links UNION ALL SELECT b, a FROM links",
    "reach": """SELECT entity_id AS a, entity_id AS b, 0 AS d FROM ent UNION SELECT r.a, l.b, d+1 FROM reach r JOIN twoway l ON l.a=r.b WHERE d<4""",
    "canon": "SELECT a AS entity_id, min(b) AS canonical_id FROM reach GROUP BY a",
}


@query("x02_canonical_ids", oracle("SELECT entity_id, canonical_id FROM canon", CANON))
def _(c: Corpus) -> DataFrame:
    return canonical.canonical_ids(c.current_attributes, c.entities)


@query(
    "x03_canonical_network",
    oracle(
        f"""SELECT entity_id, count(*) AS ties FROM (SELECT s AS entity_id, o, claim_id FROM moved UNION ALL SELECT o, s, claim_id FROM moved WHERE s<>o)
 WHERE entity_id IN (SELECT canonical_id FROM canon WHERE entity_id IN (SELECT c_custkey FROM customer)) GROUP BY 1""",
        CANON
        | {
            "moved": f"""SELECT claim_id, x.canonical_id AS s, y.canonical_id AS o FROM rels JOIN canon x ON x.entity_id=subject_entity_id
 JOIN canon y ON y.entity_id=object_entity_id WHERE status='asserted' AND confidence_point>=0.6 AND {possibly(*Y98)} AND x.canonical_id<>y.canonical_id"""
        },
    ),
)
def _(c: Corpus) -> DataFrame:
    canon = canonical.canonical_ids(c.current_attributes, c.entities)
    focus = c.table("customer").select(F.col("c_custkey").alias("entity_id"))
    network = canonical.canonical_network(c.claims, canon, focus, 0.6, *YEAR_98)
    return network.groupBy("entity_id").agg(F.count("*").alias("ties"))


@query(
    "x03b_members",
    oracle(
        "SELECT canonical_id, entity_id, members FROM canon JOIN (SELECT canonical_id, count(*) AS members FROM canon GROUP BY 1 HAVING count(*)>1) USING (canonical_id)",
        CANON,
    ),
)
def _(c: Corpus) -> DataFrame:
    return canonical.members(canonical.canonical_ids(c.current_attributes, c.entities))


# Resolution -----------------------------------------------------------------------------
# Parts resolve by name, with the size of the part standing in for a birth year.
PROFILE = {
    "pname": "SELECT DISTINCT -2*p_partkey-2 AS entity_id, lower(p_name) AS name, p_size AS born FROM part UNION SELECT -2*p_partkey-2, lower(p_type)||' '||split_part(p_name,' ',2), p_size FROM part",
    "prof": "SELECT name, born, min(entity_id) AS profile_id, count(*) AS members FROM pname GROUP BY 1,2",
    "mem": "SELECT DISTINCT pname.entity_id, prof.profile_id FROM pname JOIN prof USING (name, born)",
    "texts": "SELECT DISTINCT name AS t FROM prof",
    "gram": """SELECT DISTINCT t, substr('  '||w||' ', CAST(i AS INTEGER), 3) AS g FROM
 (SELECT t, unnest(regexp_split_to_array(t, '[^a-z0-9]+')) AS w FROM texts), unnest(range(1, length(w)+2)) AS r(i) WHERE w<>''""",
    "sizes": "SELECT t, count(*) AS n FROM gram GROUP BY t",
    "alike": """SELECT x, y, k/(sx.n+sy.n-k) AS similarity FROM (SELECT a.t AS x, b.t AS y, count(*) AS k FROM gram a JOIN gram b ON a.g=b.g GROUP BY 1,2)
 JOIN sizes sx ON sx.t=x JOIN sizes sy ON sy.t=y WHERE k/(sx.n+sy.n-k)>=0.4""",
    "cand": """SELECT least(p.profile_id,q.profile_id) AS a, greatest(p.profile_id,q.profile_id) AS b, max(similarity) AS similarity, min(abs(p.born-q.born)) AS born_gap
 FROM alike JOIN prof p ON p.name=x JOIN prof q ON q.name=y WHERE p.profile_id<>q.profile_id AND abs(p.born-q.born)<=5 GROUP BY 1,2""",
    "scored": """SELECT *, ln_n + ln_b AS weight, (0.01/0.99)*pow(2.0, ln_n+ln_b)/(1+(0.01/0.99)*pow(2.0, ln_n+ln_b)) AS p FROM (SELECT *,
 log2(CASE WHEN similarity>=0.9 THEN 0.70/0.02 WHEN similarity>=0.75 THEN 0.25/0.08 ELSE 0.05/0.90 END) AS ln_n,
 log2(CASE WHEN born_gap=0 THEN 0.70/0.05 WHEN born_gap<=2 THEN 0.25/0.15 ELSE 0.05/0.80 END) AS ln_b FROM cand)""",
}


def part_profiles(c: Corpus) -> tuple[DataFrame, DataFrame]:
    part, key = c.table("part"), part_id(F.col("p_partkey"))
    texts = F.array(
        F.col("p_name"), F.concat(F.lower("p_type"), F.lit(" "), F.split("p_name", " ")[1])
    )
    names = part.select(key.alias("entity_id"), F.explode(texts).alias("name"))
    dates = part.select(
        key.alias("entity_id"), F.col("p_size").alias("born_year"), F.lit(None).cast("int").alias("died_year")
    )
    return resolution.profiles(names, dates)


def candidates(c: Corpus) -> DataFrame:
    return resolution.block_pairs(part_profiles(c)[0], floor=0.4)


@query("x04_profiles", oracle("SELECT name, CAST(born AS INTEGER) AS born_year, profile_id, members FROM prof", PROFILE))
def _(c: Corpus) -> DataFrame:
    found, _ = part_profiles(c)
    return found.select("name", "born_year", "profile_id", "members")


@query("x04b_block_pairs", oracle("SELECT a, b, round(similarity,9) AS similarity, CAST(born_gap AS INTEGER) AS born_gap FROM cand", PROFILE))
def _(c: Corpus) -> DataFrame:
    return candidates(c).select("a", "b", F.round("similarity", 9).alias("similarity"), "born_gap")


@query("x05_score_pairs", oracle("SELECT a, b, round(weight,6) AS weight, round(p,6) AS p FROM scored", PROFILE))
def _(c: Corpus) -> DataFrame:
    return resolution.score_pairs(candidates(c)).select(
        "a", "b", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p")
    )


@query(
    "x05b_agreement_patterns",
    oracle(
        """SELECT CAST(CASE WHEN similarity>=0.9 THEN 2 WHEN similarity>=0.75 THEN 1 ELSE 0 END AS INTEGER) AS name_level,
 CAST(CASE WHEN born_gap=0 THEN 2 WHEN born_gap<=2 THEN 1 ELSE 0 END AS INTEGER) AS born_level, count(*) AS n FROM cand GROUP BY 1,2""",
        PROFILE,
    ),
)
def _(c: Corpus) -> DataFrame:
    return resolution.agreement_patterns(candidates(c)).select("name_level", "born_level", "n")


def _rounds(n: int) -> dict[str, str]:
    """Expectation maximisation over agreement patterns, one pair of CTEs a round."""
    def pick(kind: str, level: str) -> str:
        return f"CASE {level} WHEN 2 THEN {kind}2 WHEN 1 THEN {kind}1 ELSE {kind}0 END"

    odds = (
        f"prior/(1-prior)*pow(2.0::DOUBLE, log2({pick('nm', 'nl')}/{pick('nu', 'nl')})+log2({pick('ym', 'bl')}/{pick('yu', 'bl')}))"
    )
    levels = """CASE WHEN similarity>=0.9 THEN 2 WHEN similarity>=0.75 THEN 1 ELSE 0 END AS nl,
 CASE WHEN born_gap=0 THEN 2 WHEN born_gap<=2 THEN 1 ELSE 0 END AS bl"""
    parts = {
        "levels": f"SELECT *, {levels} FROM cand",
        "pat": "SELECT nl, bl, count(*)::DOUBLE AS n FROM levels GROUP BY 1,2",
        "m0": """SELECT 0.01::DOUBLE AS prior, 0.05::DOUBLE AS nm0, 0.25::DOUBLE AS nm1, 0.70::DOUBLE AS nm2, 0.90::DOUBLE AS nu0, 0.08::DOUBLE AS nu1, 0.02::DOUBLE AS nu2,
 0.05::DOUBLE AS ym0, 0.25::DOUBLE AS ym1, 0.70::DOUBLE AS ym2, 0.80::DOUBLE AS yu0, 0.15::DOUBLE AS yu1, 0.05::DOUBLE AS yu2""",
    }
    for r in range(1, n + 1):
        parts[f"s{r}"] = f"SELECT nl, bl, n, n*o/(1+o) AS hit, n-n*o/(1+o) AS miss FROM (SELECT pat.*, {odds} AS o FROM pat JOIN m{r - 1} ON true)"
        shares = ", ".join(
            f"(coalesce(sum({side}) FILTER ({level}={i}),0)+1e-6)/(sum({side})+3e-6) AS {kind}{i}"
            for level, tag in (("nl", "n"), ("bl", "y")) for side, kind in (("hit", f"{tag}m"), ("miss", f"{tag}u")) for i in range(3)
        )
        parts[f"m{r}"] = f"SELECT least(greatest(sum(hit)/sum(n), 1e-9), 1-1e-9) AS prior, {shares} FROM s{r}"
    parts["refined"] = f"SELECT a, b, o/(1+o) AS p FROM (SELECT a, b, {odds} AS o FROM levels JOIN m{n} ON true)"
    return parts


@query("x05c_reestimated_scores", oracle("SELECT a, b, round(p,6) AS p FROM refined", PROFILE | _rounds(5)))
def _(c: Corpus) -> DataFrame:
    """Scores under a model refined in five rounds on the candidates themselves."""
    pairs = materialise(candidates(c), "candidates")
    return resolution.score_pairs(pairs, resolution.reestimate(pairs)).select("a", "b", F.round("p", 6).alias("p"))


@query(
    "x06_split_candidates",
    oracle(
        """SELECT a, b, CASE WHEN p>=0.7 THEN 'same-as' ELSE 'queue' END AS part FROM scored WHERE p>=0.1
 UNION SELECT profile_id, entity_id, 'same-as' FROM mem WHERE entity_id<>profile_id""", PROFILE
    ),
)
def _(c: Corpus) -> DataFrame:
    found, member = part_profiles(c)
    scored = resolution.score_pairs(resolution.block_pairs(found, floor=0.4))
    same, queue = resolution.entity_links(scored, member, low=0.1, high=0.7)
    return same.select(
        F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"), F.lit("same-as").alias("part")
    ).unionByName(queue.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), F.lit("queue").alias("part")))


@query(
    "x07_er_quality",
    oracle(
        """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp/(tp+fp),9) AS precision, round(tp/(tp+fn),9) AS recall FROM (
 SELECT count(*) FILTER (said AND is_match) AS tp, count(*) FILTER (said AND NOT is_match) AS fp,
 count(*) FILTER (NOT said AND is_match) AS fn
 FROM (SELECT g.a, g.b, is_match, coalesce(bool_or(coalesce(x.profile_id=y.profile_id,false) OR coalesce(s.p>=0.1,false)),false) AS said
 FROM gold g LEFT JOIN mem x ON x.entity_id=g.a LEFT JOIN mem y ON y.entity_id=g.b
 LEFT JOIN scored s ON s.a=least(x.profile_id,y.profile_id) AND s.b=greatest(x.profile_id,y.profile_id) GROUP BY 1,2,3))""",
        PROFILE
        | {
            "gold": """SELECT -2*y.p_partkey-2 AS a, -2*x.p_partkey-2 AS b, x.p_name=y.p_name AS is_match FROM part x JOIN part y ON y.p_partkey=x.p_partkey+1"""
        },
    ),
)
def _(c: Corpus) -> DataFrame:
    """Neighbouring parts as labelled pairs: a match when they share their name."""
    part = c.table("part")
    key = F.col("p_partkey")
    left = part.select(part_id(key).alias("b"), F.col("p_name").alias("_x"), part_id(key + 1).alias("a"))
    right = part.select(part_id(key).alias("a"), F.col("p_name").alias("_y"))
    gold = left.join(right, "a").select("a", "b", (F.col("_x") == F.col("_y")).alias("is_match"))
    found, member = part_profiles(c)
    scored = resolution.score_pairs(resolution.block_pairs(found, floor=0.4))
    quality = resolution.er_quality(scored, gold, 0.1, member)
    return quality.withColumns({n: F.round(n, 9) for n in ("precision", "recall")})


# Calibration ------------------------------------------------------------------------------
LABELLED = {
    "labelled": """SELECT doc_id, least(n_chars/5000.0::DOUBLE, 1.0::DOUBLE) AS point, quality=1 AS label FROM documents JOIN labels USING (doc_id)""",
    "bins": """SELECT CAST(least(floor(point*10), 9) AS INTEGER) AS bin, count(*) AS n, avg(point) AS mean_point, avg(CAST(label AS DOUBLE)) AS observed FROM labelled GROUP BY 1""",
    "pooled": """SELECT l.bin AS lo, h.bin AS hi, sum(b.observed*b.n)/sum(b.n) AS rate FROM bins l JOIN bins h ON l.bin<=h.bin JOIN bins b ON b.bin BETWEEN l.bin AND h.bin GROUP BY 1,2""",
    "mapped": """SELECT bin, max(worst) AS point FROM (SELECT b.bin, p.lo, min(p.rate) AS worst FROM bins b JOIN pooled p ON p.lo<=b.bin AND p.hi>=b.bin GROUP BY 1,2) GROUP BY 1""",
}


def labelled(c: Corpus) -> DataFrame:
    """Quality labels of documents against their length as a score."""
    score = F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0))
    return c.table("documents").join(c.table("labels"), "doc_id").select(
        "doc_id", score.alias("point"), (F.col("quality") == 1).alias("label")
    )


@query(
    "x08_reliability",
    oracle("SELECT bin, n, round(mean_point,9) AS mean_point, round(observed,9) AS observed FROM bins", LABELLED),
)
def _(c: Corpus) -> DataFrame:
    return calibration.reliability(labelled(c)).withColumns(
        {n: F.round(n, 9) for n in ("mean_point", "observed")}
    )


@query("x08b_monotone_map", oracle("SELECT bin, round(point,9) AS point FROM mapped", LABELLED))
def _(c: Corpus) -> DataFrame:
    mapping = calibration.monotone_map(calibration.reliability(labelled(c)))
    return mapping.withColumn("point", F.round("point", 9))


@query(
    "x08c_calibrated_confidence",
    oracle(
        """SELECT claim_id, round(coalesce(m.point, confidence_point),9) AS confidence_point, CASE WHEN m.point IS NOT NULL THEN 'calibration'
 WHEN confidence_point IS NOT NULL THEN 'source' ELSE 'unscored' END AS origin, CASE WHEN m.point IS NOT NULL THEN 'cal-2' END AS calibration_run_id
 FROM ties LEFT JOIN mapped m ON confidence_point IS NOT NULL AND m.bin=CAST(least(floor(confidence_point*10),9) AS INTEGER)""",
        LABELLED,
    ),
)
def _(c: Corpus) -> DataFrame:
    """Ties re-read under the active one of two calibration runs."""
    mapping = calibration.monotone_map(calibration.reliability(labelled(c)))
    points = calibration.calibrate(c.ties, mapping, "cal-2").unionByName(
        calibration.calibrate(c.ties, mapping.withColumn("point", F.lit(0.5)), "cal-1")
    )
    runs = points.select("run_id").distinct()
    active = calibration.active_calibration(points, calibration.activate(runs, "cal-2"))
    return current_confidence(c.ties, c.tie_events, active).withColumn(
        "confidence_point", F.round("confidence_point", 9)
    )


@query(
    "x09_forward_folds",
    oracle("""SELECT fold, part, count(*) AS n, min(start_earliest) AS first_day, max(start_earliest) AS last_day FROM (
 SELECT 0 AS fold, CASE WHEN se0<DATE '1996-01-01' THEN 'train' WHEN se0<DATE '1998-01-01' THEN 'test' END AS part, se0 AS start_earliest FROM ties
 UNION ALL SELECT 1, CASE WHEN se0<DATE '1998-01-01' THEN 'train' WHEN se0<DATE '2000-01-01' THEN 'test' END, se0 FROM ties
 UNION ALL SELECT 2, CASE WHEN se0<DATE '2000-01-01' THEN 'train' ELSE 'test' END, se0 FROM ties) WHERE part IS NOT NULL GROUP BY 1,2"""),
)
def _(c: Corpus) -> DataFrame:
    dated = c.ties.withColumn("day", F.date_sub(F.to_date("recorded_at"), 1))
    folds = calibration.forward_folds(dated, "day", ["1996-01-01", "1998-01-01", "2000-01-01"])
    return folds.groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
