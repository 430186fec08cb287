"""Published adjacency with hubs, blocking by prefix and place, and snapshots of the event fold, against plain forms."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import adjacency, graph, history, publish, resolution
from claimgraph.operators.paths import find_paths
from claimgraph.sources.runs import RunLog

NAMES = ("start_earliest", "start_latest", "end_earliest", "end_latest")


@pytest.fixture(scope="module")
def claims(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        # Entity 1 has a third of all ties.
        a = 1 if i % 3 == 0 else rng.randrange(2, 40)
        year = rng.choice([None, 1500, 1600, 1700])
        rows.append((
            f"c{i}", a, rng.randrange(2, 60), rng.choice(["associated-with", "corresponded-with"]), rng.choice([None, 0.2, 0.5, 0.9]),
            rng.choice(["asserted", "asserted", "disputed"]), year and f"{year}-01-01", year and f"{year + 50}-12-31",
        ))
    frame = spark.createDataFrame(
        rows, "claim_id string, subject_entity_id long, object_entity_id long, predicate string, confidence_point double, "
        "status string, start_earliest string, end_latest string",
    )
    dates = {n: F.to_date(n) if n in ("start_earliest", "end_latest") else F.lit(None).cast("date") for n in NAMES}
    return frame.withColumns(dates | {"approximate": F.lit(False)}).cache()


@pytest.fixture(scope="module")
def published(spark, claims, tmp_path_factory):
    return adjacency.publish_adjacency(claims, str(tmp_path_factory.mktemp("a")), "ties_test", buckets=6, limit=10)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reads_of_the_published_adjacency(spark, claims, published):
    focus = spark.createDataFrame([(1,), (2,), (7,), (7,), (999,)], "entity_id long")
    for args in ((0.0, None, None, True), (0.5, "1550-01-01", "1620-12-31", False)):
        plain = graph.ego_network(claims, focus, *args)
        found = published.ego_network(focus, *args)
        columns = [*adjacency.COLUMNS, "certainly_active", "undated"]
        assert rows(found.select(*columns)) == rows(plain.select(*columns))


def test_a_hub_lies_in_many_buckets_and_does_not_move(spark, published):
    pieces = published.hubs.where("entity_id = 1").first()["pieces"]
    own = published.ties.where("entity_id = 1")
    assert own.groupBy("piece").count().agg(F.max("count")).first()[0] < 30 and own.select("piece").distinct().count() == pieces > 4
    assert own.select(F.input_file_name()).distinct().count() > 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        focus = spark.createDataFrame([(1,), (2,)], "entity_id long").cache()
        plan = published.of(focus)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        lines = [(len(re.match(r"[\s:+\-*()\d]*", x)[0]), x) for x in plan.split("\n")]
        at = next(i for i, (_, x) in enumerate(lines) if "Bucketed: true" in x)
        depth, above = lines[at][0], []
        for indent, text in reversed(lines[:at]):  # what stands over the scan in the tree
            if indent < depth:
                depth, above = indent, [*above, text]
        assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_session_opens_it(spark, published):
    other = adjacency.Adjacency(spark.newSession(), published.path, "ties_elsewhere")
    assert other.ties.count() == published.ties.count()


def test_paths_through_split_hubs(spark, claims, published, monkeypatch):
    pairs = spark.createDataFrame([(2, 3), (4, 9), (5, 1), (1, 11), (30, 31)], "source long, target long")
    plain = rows(find_paths(claims, pairs, 0.2, max_depth=3))
    assert plain and rows(find_paths(published, pairs, 0.2, max_depth=3)) == plain
    monkeypatch.setattr(adjacency, "HUB_ROWS", 10)
    assert rows(find_paths(claims, pairs, 0.2, max_depth=3)) == plain


# Blocking -------------------------------------------------------------------------------


def grams(name):
    words = [w for w in re.split(r"[\W_]+", name.lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("floor", [0.3, 0.6, 0.9])
def test_similar_names_equal_brute_force(spark, monkeypatch, floor):
    monkeypatch.setattr(resolution, "LIST_ROWS", 7)  # many lists are dealt
    rng = random.Random(int(floor * 10))
    parts = ["anna", "ann", "hanna", "smith", "smyth", "van", "der", "berg", "bergen", "x", "o", "jo", "jon", "john"]
    names = {" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(220)}
    names |= {f"same long prefix {i}" for i in range(60)} | {"", "!!"}
    expected = {}
    for a, b in combinations(sorted(names), 2):
        x, y = grams(a), grams(b)
        if x | y and len(x & y) / len(x | y) >= floor:
            expected[a, b] = len(x & y) / len(x | y)
    found = resolution.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), floor).collect()
    assert Counter((r["name_a"], r["name_b"]) for r in found) == Counter(list(expected))  # each pair once
    assert all(abs(r["similarity"] - expected[r["name_a"], r["name_b"]]) < 1e-9 for r in found)


# Snapshots ------------------------------------------------------------------------------


def test_a_moment_from_snapshots_equals_the_whole_fold(spark, tmp_path):
    rng = random.Random(11)
    kinds = ["assert", "dispute", "undispute", "supersede", "adjust_confidence"]

    def events(n, low, high, tag):
        made = [
            (f"{tag}{i}", rng.randrange(12), rng.choice(kinds), f"2020-01-{rng.randint(low, high):02d} 0{rng.randrange(9)}:00:00", 1,
             rng.choice(['{"point":0.5}', '{"point":0.25}', "{}"])) for i in range(n)
        ]
        frame = spark.createDataFrame(made, "id string, claim_id long, event_type string, at string, actor_agent_id long, payload string")
        return frame.withColumn("occurred_at", F.col("at").cast("timestamp_ntz"))

    log = RunLog(spark, str(tmp_path / "log"))
    parts = [events(60, 1, 9, "a"), events(60, 10, 19, "b"), events(60, 20, 28, "c"), events(15, 1, 28, "late")]
    publish.publish_events(log, "a", parts[0])
    publish.publish_snapshot(log, "s1", "2020-01-09 23:00:00")
    publish.publish_events(log, "b", parts[1])
    publish.publish_snapshot(log, "s2", "2020-01-15 00:00:00")
    publish.publish_events(log, "c", parts[2])
    publish.publish_events(log, "late", parts[3])
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    for moment in ("2020-01-05 00:00:00", "2020-01-12 03:00:00", "2020-01-15 00:00:00", "2020-01-27 00:00:00"):
        past = whole.where(F.col("occurred_at") <= F.lit(moment).cast("timestamp_ntz"))
        found = history.read_state(publish.state_at(log, moment))
        assert rows(found) == rows(
            history.current_status(past).join(history.manual_points(past), "claim_id", "left")
        ), moment
    # After the second snapshot the first slice's files are not opened.
    read = log.table("events", 4, within=("2020-01-15 00:00:00", "2020-01-27 00:00:00")).inputFiles()
    assert read and not any("attempt=a-" in f for f in read)
