"""Costly inputs are derived once a query, costly expressions once a row, and no step gathers rows it need not."""

import re

import pytest

from claimgraph.operators import actions, adjacency, history, people, search
from claimgraph.operators import claims as reads
from claimgraph.plans import all_queries, publishing
from claimgraph.plans.corpus import Corpus
from claimgraph.schema import BOUNDS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fold_reads_its_log_once(spark, tmp_path):
    rows = [
        ("e1", "a", "assert", 1), ("e2", "a", "dispute", 2), ("e3", "a", "supersede", 3),
        ("f1", "b", "assert", 1), ("f2", "b", "supersede", 2), ("f3", "b", "dispute", 3),
        ("g1", "c", "assert", 1), ("g2", "c", "supersede", 2), ("g3", "c", "assert", 3), ("g4", "c", "dispute", 4),
        ("h1", "d", "supersede", 1), ("h2", "d", "dispute", 1), ("i1", "e", "adjust_confidence", 1),
    ]
    log = spark.createDataFrame(rows, "id string, claim_id string, event_type string, day int").selectExpr(
        "id", "claim_id", "event_type", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, day) AS occurred_at"
    )
    log.write.parquet(f"{tmp_path}/source")
    folded = history.fold_status(spark.read.parquet(f"{tmp_path}/source"))
    assert not [f for f in folded.inputFiles() if f"{tmp_path}" in f]
    illegal = "dispute of a superseded claim"
    assert {r["claim_id"]: (r["status"], r["error"]) for r in folded.collect()} == {
        "a": ("superseded", None), "b": ("superseded", illegal), "c": ("disputed", None), "d": ("superseded", illegal),
        "e": (None, "no assert event"),
    }


def test_years_are_parsed_once_a_row(spark):
    rows = [("1500", 'a"f', "1_510", "CA"), ("x", "", "", "IN"), ("1520", "BF", "n.d.", None)]
    rels = spark.createDataFrame(rows, "start_year string, start_type string, end_year string, end_type string")
    timed = people.drop_inverted(people.build_interval(rels))
    assert plan(timed).count("regexp_replace") == 2
    found = [(r["original"], r["start_latest"] and r["start_latest"].year, r["approximate"]) for r in timed.collect()]
    assert found == [
        (r'{"end":{"type_code":"CA","year":"1510"},"start":{"type_code":"a\"f","year":"1500"}}', 1500, True),
        ("{}", None, False),
        ('{"start":{"type_code":"BF","year":"1520"}}', 1520, False),
    ]


def test_a_name_meets_a_query_once_without_gathering(spark):
    names = spark.createDataFrame([("steel bolt",), ("steel bolts",), ("a steel bolt aa",), ("Castor",)], "name string")
    asked = spark.createDataFrame([("steel bolt",), ("st",)], "q string")
    hits = search.match_names(asked, names)
    assert not re.search(r"Aggregate \[q#\d+, name#\d+, grams#", plan(hits))
    got = [(r["q"], r["name"]) for r in hits.collect()]
    assert len(got) == len(set(got))
    assert set(got) >= {(q, n) for q in ("steel bolt", "st") for n in ("steel bolt", "steel bolts", "a steel bolt aa")} | {("st", "Castor")}


@pytest.mark.parametrize("name", ["p08_refresh_entities"])
def test_ties_are_derived_once(spark, name):
    files = all_queries()[0][name](spark, "/root/testdata/sf0.001").inputFiles()
    assert not [f for f in files if "lineitem" in f]


def test_an_entity_view_derives_the_ties_once(spark):
    files = all_queries()[0]["r15_entity_view"](spark, "/root/testdata/sf0.001").inputFiles()
    assert not [f for f in files if "lineitem" in f]


def test_claims_without_sources_or_ends_are_counted_after_the_spread(spark):
    claims = spark.sql(
        "SELECT * FROM VALUES ('c1', 'associated-with', 1L, 2L, 0.5D), ('c2', 'has-name', 1L, NULL, NULL), "
        "('c3', 'associated-with', 3L, 3L, NULL), ('c4', 'associated-with', 2L, 3L, 0.1D) "
        "AS t(claim_id, predicate, subject_entity_id, object_entity_id, confidence_point)"
    )
    support = spark.createDataFrame(
        [("c1", "r1"), ("c1", "r2"), ("c2", "r1"), ("c3", "r3")], "claim_id string, source_record_id string"
    )
    records = spark.createDataFrame([("r1", 7), ("r2", 7), ("r3", 8)], "source_record_id string, source_id bigint")
    sources = spark.createDataFrame([(7, "s7"), (8, "s8")], "source_id bigint, slug string")
    ids = spark.createDataFrame([(1,), (3,)], "entity_id bigint")
    covered = reads.coverage_by_source(claims, support, records, sources, ids)
    assert {tuple(r[c] for c in ("entity_id", "source_slug", "relationship_claims", "attribute_claims")) for r in covered.collect()} == {
        (1, "s7", 1, 1), (3, "s8", 1, 0),
    }
    split = reads.scored_split(claims, ids)
    assert {(r["entity_id"], r["scored"], r["unscored"]) for r in split.collect()} == {(1, 1, 1), (3, 1, 1)}
    # The ends are spread once the sources are known, and no spread row is joined with the entities asked for.
    for frame in (covered, split):
        text = plan(frame)
        assert text.index("LeftSemi") < text.index("Aggregate") < text.index("Generate explode")


def test_a_batch_is_judged_once_for_the_queue(spark):
    merged, refused = all_parts = actions.route_identity(
        actions.judge(
            spark.sql(
                "SELECT * FROM VALUES (1L, 'dispute', 'a', 'identity', 'x'), (2L, 'dispute', 'b', 'identity', 'y'), "
                "(3L, 'dispute', 'a', 'identity', 'z'), (4L, 'dispute', 'a', 'dating', 'w') "
                "AS t(seq, kind, claim_id, ground, reason)"
            ).selectExpr("*", "CAST(NULL AS double) AS point"),
            spark.createDataFrame([("a", "asserted"), ("b", "asserted")], "claim_id string, status string"),
        ),
        spark.createDataFrame([("a", 9, 4), ("b", 5, None)], "claim_id string, subject_entity_id bigint, object_entity_id bigint"),
        spark.createDataFrame([(4, 9, 0.5, "{}", "accepted")], "entity_a bigint, entity_b bigint, score double, features string, state string"),
    )
    assert not any("Window" in plan(part) for part in all_parts)
    assert [(r["entity_a"], r["entity_b"], r["score"], r["state"]) for r in merged.collect()] == [(4, 9, 0.5, "accepted")]
    assert '"reason":"z"' in merged.first()["features"]
    assert [(r["seq"], r["claim_id"]) for r in refused.collect()] == [(2, "b")]


def test_ties_are_derived_once_for_the_published_adjacency(spark, monkeypatch, tmp_path):
    spark.range(20).selectExpr(
        "concat('c', id) AS claim_id", "'associated-with' AS predicate", "id % 3 AS subject_entity_id", "10 + id AS object_entity_id",
        *[f"CAST(NULL AS date) AS {b}" for b in BOUNDS], "false AS approximate", "0.5D AS confidence_point", "'asserted' AS status",
    ).write.parquet(f"{tmp_path}/claims")
    read, real = [], adjacency.hub_directory
    monkeypatch.setattr(adjacency, "hub_directory", lambda rows, *a: (read.extend(rows.inputFiles()), real(rows, *a))[1])
    found = adjacency.publish_adjacency(spark.read.parquet(f"{tmp_path}/claims"), f"{tmp_path}/a", "ties_once", buckets=2, limit=5)
    assert read and not [f for f in read if f"{tmp_path}/claims" in f]
    assert found.ties.count() == 40 and {r["entity_id"] for r in found.hubs.collect()} == {0, 1, 2}


def test_names_are_normalised_once_for_two_resolution_runs(spark, monkeypatch):
    read, real = [], publishing.resolution.entity_links
    monkeypatch.setattr(publishing, "_STORES", {})
    monkeypatch.setattr(
        publishing.resolution, "entity_links",
        lambda scored, member, **bands: (read.extend(member.inputFiles()), real(scored, member, **bands))[1],
    )
    publishing.resolved(Corpus(spark, "/root/testdata/sf0.001"))
    assert read and not [f for f in read if f.endswith("part.parquet")]
