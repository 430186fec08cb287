"""Operators on small fixtures, against brute force where there is an algorithm."""

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimgraph.functions.temporal import window_bounds
from claimgraph.operators import actions, canonical, graph, history, ingest, letters, people, resolution, validate
from claimgraph.operators.calibration import monotone_map
from claimgraph.operators.ordered import carry_before
from claimgraph.operators.paths import find_paths
from claimgraph.operators.search import match_names
from claimgraph.schema import PEOPLE_COLUMNS, TIE_COLUMNS, relation_types
from claimgraph.sources import delimited, ndjson, synthetic

CLAIM_LAYOUT = (
    "claim_id bigint, subject_entity_id bigint, object_entity_id bigint, predicate string, "
    "confidence_point double, status string, start_earliest date, start_latest date, "
    "end_earliest date, end_latest date"
)


def ties(spark, rows):
    full = [(i, a, b, "associated-with", p, "asserted", None, None, None, None) for i, a, b, p in rows]
    return spark.createDataFrame(full, CLAIM_LAYOUT)


def replay(kinds):
    """One event after the other: the status and whether a step was illegal."""
    status, illegal = None, False
    for kind in kinds:
        if kind == "assert":
            status = "asserted"
        elif kind == "dispute":
            if status == "superseded":
                illegal = True
            else:
                status = "disputed"
        elif kind == "undispute" and status == "disputed":
            status = "asserted"
        elif kind == "supersede":
            status = "superseded"
    return status, illegal


def test_fold_equals_replay(spark):
    kinds = ["assert", "dispute", "undispute", "supersede", "adjust_confidence"]
    logs = [list(t) for n in range(1, 5) for t in itertools.product(kinds, repeat=n)]
    start = datetime(2024, 1, 1)
    rows = [
        (c * 10 + i, c, kind, start + timedelta(minutes=31 * i), 1, "{}")
        for c, log in enumerate(logs) for i, kind in enumerate(log)
    ]
    random.Random(1).shuffle(rows)
    events = spark.createDataFrame(
        rows, "id bigint, claim_id bigint, event_type string, occurred_at timestamp, actor_agent_id bigint, payload string"
    )
    found = {r["claim_id"]: (r["status"], r["error"]) for r in history.fold_status(events).collect()}
    for c, log in enumerate(logs):
        status, illegal = replay(log)
        error = "dispute of a superseded claim" if illegal else (None if status else "no assert event")
        assert found[c] == (status, error), log


def test_unknown_event_kind_is_an_error(spark):
    rows = [(1, 1, "assert", datetime(2024, 1, 1), 1, "{}"), (2, 1, "renounce", datetime(2024, 1, 2), 1, "{}")]
    events = spark.createDataFrame(
        rows, "id bigint, claim_id bigint, event_type string, occurred_at timestamp, actor_agent_id bigint, payload string"
    )
    assert history.fold_status(events).first()["error"] == "unknown event type"


def test_carry_before_crosses_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    out = carry_before(df, ["k"], F.floor(F.col("seq") / 7), ["seq"], {"last": F.col("v")}).collect()
    for r in out:
        seen = [v for k, s, v in rows if k == r["k"] and s < r["seq"] and v is not None]
        assert r["last"] == (seen[-1] if seen else None)


def test_actions_see_earlier_actions(spark):
    rng = random.Random(3)
    rows, now = [], datetime(2024, 1, 1)
    for seq in range(200):
        kind = rng.choice(["dispute", "undispute", "undispute", "dispute", "adjust_confidence"] + ["supersede"] * (seq % 17 == 0))
        ground = rng.choice(["existence", "identity", "gossip"])
        rows.append((seq, kind, rng.randrange(6), ground, None, rng.choice([0.5, 1.5, None]), 1, now, None))
    df = spark.createDataFrame(
        rows, "seq bigint, kind string, claim_id bigint, ground string, reason string, point double, agent_id bigint, occurred_at timestamp, as_of string"
    )
    opening = {0: "asserted", 1: "disputed", 2: "superseded", 3: "asserted", 4: "asserted"}
    status = spark.createDataFrame(list(opening.items()), "claim_id bigint, status string")
    refused = {r["seq"] for r in actions.refusals(actions.judge(df, status)).collect()}
    state, expected = dict(opening), set()
    for seq, kind, claim, ground, _, point, *_ in rows:
        s = state.get(claim)
        ok = s is not None
        if kind == "dispute":
            ok = ok and ground != "gossip" and s != "superseded"
            if ok and ground != "identity":
                state[claim] = "disputed"
        elif kind == "undispute":
            ok = ok and s == "disputed"
            if ok:
                state[claim] = "asserted"
        elif kind == "supersede":
            ok = ok and s != "superseded"
            if ok:
                state[claim] = "superseded"
        else:
            ok = ok and point is not None and 0 <= point <= 1
        if not ok:
            expected.add(seq)
    assert refused == expected


def test_accept_in_order_equals_one_by_one(spark):
    rng = random.Random(4)
    lines = [(i, rng.randrange(25), [rng.randrange(25) for _ in range(rng.randrange(3))]) for i in range(40)]
    firsts = {}
    for line, key, extra in lines:
        firsts.setdefault(key, (line, extra))
    held, accepted = set(), set()
    for key, (line, extra) in sorted(firsts.items(), key=lambda kv: kv[1][0]):
        if key not in held:
            accepted.add(line)
            held |= {key, *extra}
    wanted = spark.createDataFrame([(line, k) for k, (line, _) in firsts.items()], "line_no bigint, key int")
    holds = spark.createDataFrame(
        [(line, h) for k, (line, extra) in firsts.items() for h in {k, *extra}], "line_no bigint, key int"
    )
    assert {r[0] for r in ingest.accept_in_order(wanted, holds, ["key"]).collect()} == accepted


def test_self_tie_and_cap(spark):
    claims = ties(spark, [(1, 5, 5, 0.9), (2, 5, 6, 0.4), (3, 7, 5, None), (4, 5, 8, 0.4)])
    focus = spark.createDataFrame([(5,), (9,)], "entity_id bigint")
    network = graph.ego_network(claims, focus, include_unscored=True)
    assert network.count() == 4
    counts = {r["entity_id"]: r["possibly"] for r in graph.network_counts(network, focus).collect()}
    assert counts == {5: 4, 9: 0}
    capped = graph.cap_edges(network, 3).orderBy("edge_rank").collect()
    assert [r["claim_id"] for r in capped] == [1, 2, 4]
    assert all(r["truncated"] for r in capped)


def test_wide_result_filtered_equals_direct_query(spark):
    rng = random.Random(5)
    claims = ties(spark, [(i, rng.randrange(8), rng.randrange(8), rng.choice([None, 0.1, 0.5, 0.9])) for i in range(80)])
    focus = spark.range(8).select(F.col("id").alias("entity_id"))
    wide = graph.ego_network(claims, focus, 0.0, include_unscored=True).where(F.col("confidence_point") >= 0.5)
    direct = graph.ego_network(claims, focus, 0.5)
    assert wide.exceptAll(direct).count() == direct.exceptAll(wide).count() == 0


def brute_paths(edges, source, target, depth, k):
    """Breadth first with the pinned order; every parallel tie into the target counts."""
    frontier, visited, found = {source: (1.0, ())}, {source}, []
    for hops in range(1, depth + 1):
        reached = {}
        for node, (weak, ids) in frontier.items():
            for claim, a, b, p in edges:
                for here, there in {(a, b), (b, a)}:
                    if here != node:
                        continue
                    step = (min(weak, p), ids + (claim,))
                    if there == target:
                        found.append((hops, -step[0], step[1]))
                    elif there not in visited:
                        best = reached.get(there)
                        if best is None or (-step[0], step[1]) < (-best[0], best[1]):
                            reached[there] = step
        visited |= set(reached)
        frontier = reached
    return [ids for _, _, ids in sorted(found)[:k]]


def test_paths_equal_brute_force(spark):
    rng = random.Random(6)
    edges = [(i, rng.randrange(12), rng.randrange(12), rng.choice([0.3, 0.5, 0.8])) for i in range(30)]
    claims = ties(spark, edges)
    wanted = [(a, b) for a in range(6) for b in range(6, 12)]
    pairs = spark.createDataFrame(wanted, "source bigint, target bigint")
    for depth in (2, 4):
        rows = find_paths(claims, pairs, max_depth=depth, max_paths=5).orderBy("path_rank").collect()
        found = {}
        for r in rows:
            found.setdefault((r["source"], r["target"]), []).append(tuple(r["claim_ids"]))
        for a, b in wanted:
            assert found.get((a, b), []) == brute_paths(edges, a, b, depth, 5), (a, b, depth)


def grams(text):
    words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_search_equals_scan(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abc de") for _ in range(rng.randrange(1, 12))) for _ in range(120)] + ["O'Hara-Lee"]
    asked = ["ab", "abc", "c d", "a b", "hara", "'h", "bc de a", "e"]
    q = spark.createDataFrame([(a,) for a in asked], "q string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    found = {(r["q"], r["name"]) for r in match_names(q, n).collect()}
    expected = set()
    for a in asked:
        if len(a.strip()) < 2:
            continue
        for x in set(names):
            ga, gx = grams(a), grams(x)
            sim = len(ga & gx) / len(ga | gx) if ga | gx else 0
            if sim >= 0.3 - 1e-12 or a.lower() in x.lower():
                expected.add((a, x))
    assert found == expected


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    out = canonical.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    found = {r["entity_id"]: r["canonical_id"] for r in out}
    assert all(found.get(x, x) == root(x) for x in parent)


def test_monotone_map_pools_violations(spark):
    rows = [(0, 10, 0.1), (1, 10, 0.5), (2, 10, 0.3), (3, 30, 0.2), (4, 10, 0.9)]
    bins = spark.createDataFrame(rows, "bin int, n bigint, observed double")
    out = [round(r["point"], 4) for r in monotone_map(bins).orderBy("bin").collect()]
    assert out == [0.1, 0.28, 0.28, 0.28, 0.9]


# Mapping -------------------------------------------------------------------------------
def person(**given):
    return tuple(given.get(c, "") for c in PEOPLE_COLUMNS)


def rows_of(spark, persons, relations=()):
    people_df = spark.createDataFrame(persons, ", ".join(f"{c} string" for c in PEOPLE_COLUMNS))
    rels = spark.createDataFrame(list(relations), ", ".join(f"{c} string" for c in TIE_COLUMNS))
    return people_df, rels


def test_person_lines_are_canonical(spark):
    given = dict(id="17", display_name="Ann  Ode", search_names_all="Ann Ode|Lady Ode", birth_year="1561",
                 birth_type="CA", gender="female", odnb_id="44")
    persons, _ = rows_of(spark, [person(**given)])
    lines = [r["line"] for r in ndjson.claim_lines(people.person_claims(persons)).collect()]
    parsed = [json.loads(x) for x in lines]
    assert [p["predicate"] for p in parsed] == ["has-name", "has-name", "born", "has-gender", "has-external-id"]
    for line, value in zip(lines, parsed, strict=True):
        assert line == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert parsed[2]["valid_time"] == {
        "start_earliest": "1561-01-01", "start_latest": "1561-12-31", "approximate": True,
        "original": {"type_code": "CA", "year": "1561"},
    }
    assert parsed[2]["object"]["literal"] == {"kind": "year", "value": 1561}
    checked = validate.validate_claims(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no bigint, line string"))
    assert all(r["errors"] == [] for r in checked.select("errors").collect())


def test_tie_order_inversion_dangling_and_repeats(spark):
    persons, rels = rows_of(
        spark, [person(id="52"), person(id="37"), person(id="9")],
        [("r1", "52", "37", "81", "1712", "AF/IN", "1733", "BF/IN"),
         ("", "37", "52", "40", "1760", "AF/IN", "1741", "BF/IN"),
         ("r3", "37", "404", "10", "", "", "", ""), ("r4", "9", "52", "strong", "", "", "", "")],
    )
    out = {r["support"][0]["external_id"]: r for r in people.relationship_claims(rels, persons).collect()}
    assert set(out) == {"r1", "37-52"}
    first = out["r1"]
    assert (first["subject"]["id"], first["object_entity"]["id"], first["confidence"]["point"]) == ("37", "52", 0.81)
    assert str(first["valid_time"]["start_earliest"]) == "1712-01-01" and str(first["valid_time"]["end_latest"]) == "1733-12-31"
    assert out["37-52"]["valid_time"]["start_earliest"] is None
    line = ndjson.claim_lines(people.relationship_claims(rels.where("id = ''"), persons)).first()["line"]
    assert json.loads(line)["valid_time"] == {"original": {
        "start": {"type_code": "AF/IN", "year": "1760"}, "end": {"type_code": "BF/IN", "year": "1741"}}}
    counters = {r["counter"]: r["n"] for r in people.anomaly_counters(persons, rels).collect()}
    assert counters == {
        "odnb_zero_sentinel": 3, "relationship_dangling_endpoint_skipped": 1,
        "valid_time_inverted_dropped_bounds": 1, "bad_year_value": 0, "duplicate_pair_kept": 1,
        "bad_score_set_aside": 1,
    }


XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><list>
<correspDesc key="A1" ref="https://example.org/a1" source="#ed">
 <correspAction type="sent"><persName ref="http://d-nb.info/gnd/11">Eva  Ring</persName><placeName ref="https://example.org/p">Ulm</placeName><date when="1741-05">May</date></correspAction>
 <correspAction type="received"><persName ref="http://d-nb.info/gnd/12">Jon Dale</persName></correspAction>
</correspDesc>
<correspDesc key="A2" ref="https://example.org/a2"><correspAction type="sent"><persName ref="http://d-nb.info/gnd/13">Kit</persName></correspAction>
 <correspAction type="received"><persName>Nobody</persName></correspAction></correspDesc>
</list></text></TEI>"""


def test_letters_from_xml(spark, tmp_path):
    from claimgraph.sources.letters import read_letters

    path = tmp_path / "letters.xml"
    path.write_text(XML)
    rows = read_letters(spark, str(path)).cache()
    raw = {r["key"]: json.loads(r["raw"]) for r in rows.collect()}
    assert raw["A1"]["sent"] == {
        "gnd": "11", "name": "Eva  Ring", "place_ref": "https://example.org/p", "place_name": "Ulm", "when": "1741-05",
    }
    assert raw["A2"]["received"] == {"gnd": None, "name": "Nobody"} and raw["A2"]["edition"] is None
    entities, claims, counters = letters.transform(rows)
    assert entities.count() == 5
    tie = claims.where("predicate = 'corresponded-with'").collect()
    assert len(tie) == 1 and str(tie[0]["valid_time"]["end_latest"]) == "1741-05-28"
    labels = {r[0] for r in claims.where("subject.authority = 'correspsearch'").select("object_literal.value").collect()}
    assert labels == {"Letter: Eva Ring → Jon Dale (1741-05)", "Letter: Kit → Nobody"}
    assert {r["counter"]: r["n"] for r in counters.collect()}["letter_missing_receiver_gnd"] == 1


def test_one_letter_file_is_read_by_many_tasks(spark, tmp_path):
    from claimgraph.sources.letters import XML_SCHEMA, read_letters

    body = XML.split("<list>")[1].split("</list>")[0]
    rows = "".join(
        body.replace("A1", f"P{i}").replace("A2", f"Q{i}") + ("<correspDesc key='E%d'/>" % i if i % 3 == 0 else "") for i in range(400)
    )
    path = tmp_path / "many.xml"
    path.write_text(f"<TEI><text><list>{rows}</list></text></TEI>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        letters_read = read_letters(spark, str(path))
        assert letters_read.rdd.getNumPartitions() > 4
        found = letters_read.select("key", "ref", "edition", "sent", "received").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["key"] for r in found) == sorted(
        [f"{k}{i}" for k in "PQ" for i in range(400)] + [f"E{i}" for i in range(0, 400, 3)]
    )
    whole = spark.read.format("xml").option("rowTag", "correspDesc").schema(XML_SCHEMA).load(str(path))
    assert whole.count() == len(found)
    one = next(r for r in found if r["key"] == "P7")
    assert (one["sent"]["name"], one["sent"]["gnd"], one["received"]["name"]) == ("Eva  Ring", "11", "Jon Dale")


# Validation and import --------------------------------------------------------------------
def claim_line(**changes):
    base = {
        "schema_version": "0.1.0", "subject": {"authority": "t", "id": "1"}, "predicate": "associated-with",
        "object": {"entity": {"authority": "t", "id": "2"}}, "confidence": {"kind": "unscored"},
        "method": "imported", "asserted_by": "pipeline",
        "support": [{"source": "s", "record_kind": "person", "external_id": "1", "content_hash": "h", "raw": {}}],
    }
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not None})


SCORE = {"kind": "source_native_scalar", "scale": "s", "raw": 97, "point": 0.97, "calibrated": False}
BAD = [
    claim_line(confidence={"kind": "unscored", "point": 0.5}),
    claim_line(object={"entity": {"authority": "t", "id": "2"}, "literal": {"kind": "string", "value": "x"}}),
    claim_line(support=[]),
    claim_line(schema_version="1.0.0"),
    claim_line(confidence=SCORE | {"calibrated": True}),
    claim_line(confidence=SCORE | {"point": 9.9}),
    claim_line(confidence=SCORE | {"point": "0.9"}),
    claim_line(subject={"authority": "t", "id": 1}),
    claim_line(valid_time={"start_earliest": "1600-13-01"}),
    claim_line(valid_time={"approximate": "yes"}),
    claim_line(support=[{"source": "s", "record_kind": "p", "external_id": "1", "content_hash": "h", "raw": {"source": "s"}, "more": 1}]),
    claim_line(method_detail="text"),
    claim_line(asserted_by=None),
    "[1]", "{", "7",
]
GOOD = [
    claim_line(), claim_line(confidence=SCORE), claim_line(confidence=SCORE | {"point": 1}),
    claim_line(object={"literal": {"kind": "year", "value": 1561}}),
    claim_line(object={"literal": {"kind": "external-id", "value": "x", "authority": "odnb"}}),
    claim_line(valid_time={"start_earliest": None, "end_latest": "1626-12-31", "original": {"any": [1, None]}}),
    claim_line(method_detail={"a": {"b": 1}}),
]


def numbered(spark, lines, first=0):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(lines)], "line_no bigint, line string")


def test_validation_verdicts(spark):
    out = validate.validate_claims(numbered(spark, BAD + GOOD)).select("line_no", "errors").orderBy("line_no").collect()
    assert [bool(r["errors"]) for r in out] == [True] * len(BAD) + [False] * len(GOOD)


def test_fast_path_agrees_with_rules(spark):
    v, t = F.col("parsed"), F.col("typed")
    df = numbered(spark, BAD + GOOD).withColumns(
        {"parsed": F.try_parse_json("line"), "typed": F.from_json("line", validate.TYPED_CLAIM)}
    )
    out = df.select(
        validate.plainly_valid(t, v).alias("fast"),
        (v.isNotNull() & (F.size(validate._errors(validate.claim_rules(v))) == 0)).alias("slow"),
    ).collect()
    assert all(r["slow"] for r in out if r["fast"])
    assert sum(r["fast"] for r in out) == len(GOOD)


def empty_store(spark, anchors):
    def none(layout):
        return spark.createDataFrame([], layout)
    claims = none(
        "claim_id bigint, subject_entity_id bigint, predicate string, object_entity_id bigint, object_literal string, "
        "start_earliest date, end_latest date, confidence_point double"
    )
    records = none(
        "source_record_id string, source string, record_kind string, external_id string, content_hash string, "
        "raw string, arrival bigint, supersedes_record_id string"
    )
    return ingest.Store(
        relation_types(spark), anchors, none("slug string"), records, claims,
        none("claim_id bigint, source_record_id string"),
    )


def test_reimport_inserts_nothing_and_versions_chain(spark):
    anchors = spark.createDataFrame([("t", "1", 1), ("t", "2", 2)], "authority string, external_id string, entity_id bigint")
    def support(key, digest):
        return [{"source": "s", "record_kind": "p", "external_id": key, "content_hash": digest, "raw": {}}]
    lines = [claim_line(support=support("a", h)) for h in ("A", "B", "A")] + [
        claim_line(subject={"authority": "t", "id": "404"}), claim_line(predicate="knows-of"), "{"
    ]
    options = dict(agent_id=1, run_id="r", recorded_at=F.lit("2024-01-01").cast("timestamp"))
    store = empty_store(spark, anchors)
    first = ingest.import_claims(numbered(spark, lines), store, batch_no=1, **options)
    assert first["report"].first().asDict() == {
        "received": 6, "inserted": 2, "duplicates": 1, "superseded": 1, "rejected": 3,
    }
    reasons = [r["reason"] for r in first["rejects"].orderBy("line_no").collect()]
    assert reasons == ["unresolvable subject ref t:404", "unknown predicate 'knows-of'", "invalid JSON"]
    later = ingest.Store(
        store.relation_types, anchors, first["sources"], first["records"], first["claims"], first["support"]
    )
    again = ingest.import_claims(numbered(spark, lines), later, batch_no=2, **options)
    report = again["report"].first().asDict()
    assert (report["inserted"], report["duplicates"], report["superseded"]) == (0, 3, 0)
    assert again["sources"].count() == again["records"].count() == 0


def test_entity_anchor_chain(spark):
    def line(key, *others):
        refs = [{"authority": "t", "id": k} for k in (key, *others)]
        return json.dumps({"schema_version": "0.1.0", "ref": refs[0], "entity_type": "person", "external_ids": refs})
    anchors = spark.createDataFrame([("t", "z", 5)], "authority string, external_id string, entity_id bigint")
    out = ingest.import_entities(numbered(spark, [line("a", "b"), line("b", "c"), line("c"), line("a"), line("z")]), anchors, 0)
    assert {r[0] for r in out["created_lines"].collect()} == {0, 2}
    assert {(r["external_id"], r["entity_id"]) for r in out["anchors"].collect()} == {("a", 0), ("b", 0), ("c", 2)}


@pytest.mark.parametrize("scale", [1, 3])
def test_synthetic_ladder_falls_and_shows_every_anomaly(spark, scale):
    persons, rels = synthetic.synth_rows(spark, scale)
    _, claims, counters = people.transform(persons, rels, synthetic.SYNTHETIC)
    assert all(r["n"] > 0 for r in counters.collect())
    scored = claims.select(F.col("confidence.point").alias("confidence_point"))
    steps = [r["edges"] for r in graph.edges_by_threshold(scored).orderBy("threshold").collect()]
    assert all(a > b for a, b in zip(steps, steps[1:], strict=False))
    entities, more = synthetic.synth_second_sources(spark)
    lines = ndjson.claim_lines(claims.unionByName(more)).collect()
    checked = validate.validate_claims(numbered(spark, [r["line"] for r in lines]))
    assert checked.where(F.size("errors") > 0).count() == 0
    bad = validate.validate_entities(numbered(spark, [r["line"] for r in ndjson.entity_lines(entities).collect()]))
    assert bad.where(F.size("errors") > 0).count() == 0


def test_input_hashes(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.csv"
    path.write_text("id,name\n1,\"x, y\"\n2,\n")
    good = "sha256:" + hashlib.sha256(path.read_bytes()).hexdigest()
    delimited.require_verified(delimited.verify_inputs(spark, {str(path): good}))
    with pytest.raises(ValueError):
        delimited.require_verified(delimited.verify_inputs(spark, {str(path): "sha256:0"}))
    rows = delimited.read_delimited(spark, str(path), "person").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "x, y", "person"), ("2", "", "person")]


def test_export_is_refused_for_unconfirmed_sources(spark, tmp_path):
    from claimgraph.sources.export import ExportBlocked, export_claims

    claims = ties(spark, [(1, 1, 2, 0.5)])
    blocked = spark.createDataFrame([("closed-source",)], "slug string")
    with pytest.raises(ExportBlocked, match="closed-source"):
        export_claims(claims, blocked, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_window_defaults_to_all_time(spark):
    w0, w1 = window_bounds(None, None)
    row = spark.range(1).select(w0, w1).first()
    assert (str(row[0]), str(row[1])) == ("0001-01-01", "9999-12-31")


def test_swapped_header_and_split_files(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("name,id\n" + "".join(f"n{i},{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = delimited.read_delimited(spark, str(path), columns=["id", "name"])
        assert rows.columns == ["id", "name"] and rows.where("id = '7'").first()["name"] == "n7"
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_caps_are_honoured_and_ranks_are_whole(spark):
    from claimgraph.operators import paths

    rows = [(i, 1, 1000 + i, (i % 100) / 100) for i in range(700)]
    hub = ties(spark, rows).select("*", F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("counterpart_id"))
    assert graph.cap_edges(hub, 600).count() == 600
    assert graph.ranked_ties(hub).count() == 700
    with pytest.raises(ValueError):
        graph.cap_edges(hub, 0)
    with pytest.raises(ValueError):
        paths.find_paths(ties(spark, rows), spark.createDataFrame([(1, 1001)], "source long, target long"), max_depth=0)


def test_members_of_one_profile_are_linked_and_count_as_predicted(spark):
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "entity_id long, profile_id long")
    scored = spark.createDataFrame(
        [(1, 3, 0.9, 0.99, 0, None)], "a long, b long, similarity double, p double, born_gap int, died_gap int"
    )
    same, _ = resolution.entity_links(scored, member, 0.5, 0.95)
    assert {(r["subject_entity_id"], r["object_entity_id"]) for r in same.collect()} == {(1, 3), (1, 2)}
    gold = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 3, True)], "a long, b long, is_match boolean")
    row = resolution.er_quality(scored, gold, 0.5, member).first()
    assert (row["true_positives"], row["false_negatives"], row["recall"]) == (3, 0, 1.0)


def test_line_numbers_hold_at_any_split_size_and_feed_an_import(spark, tmp_path):
    lines = [claim_line(support=None) if i % 7 == 0 else claim_line() for i in range(900)]
    lines[5] = "   "
    for name in ("b", "a"):
        (tmp_path / f"{name}.ndjson").write_text("\n".join(lines) + "\n")
    found = []
    for size in ("20000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(ndjson.read_ndjson(spark, str(tmp_path)).orderBy("line_no").collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]
    assert [r["line_no"] for r in found[0]] == [i for i in range(1, 1801) if i not in (6, 906)]
    assert found[0][0]["file"].endswith("a.ndjson") and found[0][0]["line"] == lines[0]
    checked = validate.validate_claims(ndjson.read_ndjson(spark, str(tmp_path)).drop("file"))
    bad = {r["line_no"] for r in checked.where(F.size("errors") > 0).select("line_no").collect()}
    assert bad == {k + i + 1 for k in (0, 900) for i in range(900) if i % 7 == 0}
