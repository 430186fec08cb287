"""Published runs: what is seen, by whom, from when; inferred links; canonical ids kept up to date."""

import json

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import canonical, ingest, publish
from claimgraph.sources.runs import Conflict, RunLog


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "STORE_BUCKETS", 4)  # few small files
    return RunLog(spark, str(tmp_path / "store"))


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def read(log, *args, **kwargs):
    return sorted(r["n"] for r in log.table("t", *args, **kwargs).collect())


def test_a_run_is_seen_whole_or_not_at_all(spark, log, tmp_path):
    with pytest.raises(KeyError):
        log.table("t")
    assert log.table("t", schema="n long").count() == 0 and log.head() == 0
    log.publish("one", lambda at: {"t": numbers(spark, 1, 2), "u": numbers(spark)})
    log.stage("lost", {"t": numbers(spark, 99)})
    other = RunLog(spark, str(tmp_path / "store"))
    assert read(other) == [1, 2] and other.table("u").count() == 0
    log.publish("two", lambda at: {"t": numbers(spark, 3)})
    assert read(other) == [1, 2, 3] and read(other, 1) == [1, 2] and read(other, since=1) == [3]
    assert [(c.number, c.run_id, c.parent) for c in other.commits()] == [(1, "one", 0), (2, "two", 1)]


def test_a_committed_run_is_not_built_again(spark, log):
    first = log.publish("one", lambda at: {"t": numbers(spark, 1)})
    again = log.publish("one", lambda at: pytest.fail("built again"))
    assert again == first and read(log) == [1]


def test_the_slower_of_two_runs_is_derived_anew(spark, log, tmp_path):
    other = RunLog(spark, str(tmp_path / "store"))
    seen = []

    def slow(at):
        seen.append((at, read(log, at) if at else []))
        if at == 0:  # another run is faster while this one works
            other.publish("fast", lambda _: {"t": numbers(spark, 1)})
        return {"t": numbers(spark, 10 + at)}

    assert log.publish("slow", slow).number == 2
    assert seen == [(0, []), (1, [1])] and read(other) == [1, 11]
    with pytest.raises(Conflict):
        log.commit("late", log.stage("late", {"t": numbers(spark, 5)}), parent=1)
    with pytest.raises(ValueError):
        log.stage("no/path", {})


def test_replacing_and_compacting(spark, log):
    for k in range(3):
        log.publish(f"r{k}", lambda at, k=k: {"t": numbers(spark, k), "q": numbers(spark, k)}, replaces=("q",))
    assert [r["n"] for r in log.table("q").collect()] == [2]
    assert log.compact("pack", ("t",)).tables[0]["replaces"]
    assert read(log) == [0, 1, 2] and read(log, 2) == [0, 1]
    assert len(log.table("t").inputFiles()) <= len(log.table("t", 3).inputFiles())
    log.publish("after", lambda at: {"t": numbers(spark, 7)})
    assert read(log) == [0, 1, 2, 7]


def line(subject, obj, digest="h", key=None, **more):
    return json.dumps({
        "schema_version": "0.1.0", "subject": {"authority": "t", "id": subject}, "predicate": "same-as",
        "object": {"entity": {"authority": "t", "id": obj}}, "confidence": {"kind": "unscored"},
        "method": "manual", "asserted_by": "someone",
        "support": [{"source": "s", "record_kind": "k", "external_id": key or f"{subject}-{obj}", "content_hash": digest, "raw": {}}],
    } | more)


def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def sent(spark, log, run, *lines):
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    publish.publish_import(log, run, frame, agent_id=1, recorded_at=at())
    report = log.table("reports").where(F.col("run_id") == run).first()
    return tuple(report[c] for c in ingest.REPORT)


@pytest.fixture
def store(spark, log):
    anchors = spark.createDataFrame([("t", str(i), i) for i in range(40)], "authority string, external_id string, entity_id long")
    publish.publish_anchors(log, "anchors", anchors)
    return log


def act(spark, log, run, kind, claim_ids, **more):
    rows = [(i, kind, c, more.get("ground"), "r", None, 1, None) for i, c in enumerate(claim_ids)]
    frame = spark.createDataFrame(
        rows, "seq long, kind string, claim_id long, ground string, reason string, point double, agent_id long, as_of string"
    ).withColumn("occurred_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz") + F.expr(f"make_dt_interval({log.head()})"))
    publish.publish_actions(log, run, frame)


def test_versions_across_runs(spark, store):
    assert sent(spark, store, "a", line("1", "2"), line("1", "2"), line("1", "99")) == (3, 1, 1, 0, 1)
    assert sent(spark, store, "b", line("1", "2", "h2")) == (1, 1, 0, 1, 0)
    assert sent(spark, store, "a-again", line("1", "2")) == (1, 0, 1, 0, 0)
    assert sent(spark, store, "c", line("1", "2", "h3")) == (1, 1, 0, 1, 0)
    chain = {r["content_hash"]: r["supersedes_record_id"] for r in store.table("records").collect()}
    ids = {r["content_hash"]: r["source_record_id"] for r in store.table("records").collect()}
    assert chain == {"h": None, "h2": ids["h"], "h3": ids["h2"]}
    assert store.table("claims").select("claim_id").distinct().count() == 3


def test_a_batch_opens_only_the_parts_it_names(spark, store):
    sent(spark, store, "a", *[line(str(i), str(i + 1)) for i in range(30)])
    records = store.table("records")
    one = records.where("external_id = '3-4'").select(*ingest.RECORD_KEY)
    cut = ingest.opened(records, one)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert cut.where("external_id = '3-4'").count() == 1 and cut.count() < records.count()
    assert "bucket" not in cut.columns


def test_a_supersede_and_its_claim_are_one_commit(spark, store):
    sent(spark, store, "a", line("1", "2"), line("3", "4"))
    claims = {r["subject_entity_id"]: r["claim_id"] for r in store.table("claims").collect()}
    rows = [(1, "supersede", claims[1]), (2, "supersede", claims[3]), (3, "supersede", claims[1])]
    frame = spark.createDataFrame(rows, "seq long, kind string, claim_id long").withColumns({
        "ground": F.lit(None).cast("string"), "reason": F.lit("x"), "point": F.lit(None).cast("double"),
        "agent_id": F.lit(1).cast("long"), "occurred_at": F.lit("2024-03-01").cast("timestamp_ntz"), "as_of": F.lit(None).cast("string"),
    })
    lines = spark.createDataFrame([(1, line("1", "5")), (2, "{broken"), (3, line("1", "6"))], "line_no long, line string")
    publish.publish_actions(store, "act", frame, lines, recorded_at=at())
    now = {(r["subject_entity_id"], r["object_entity_id"]): r["status"] for r in publish.published_claims(store).collect()}
    assert now == {(1, 2): "superseded", (1, 5): "asserted", (3, 4): "asserted"}
    assert {r["seq"]: r["refusal"] for r in store.table("refusals").collect()} == {
        2: "replacement is not valid", 3: "claim is superseded"
    }


def whole(log):
    """Canonical ids by the full computation, of entities with any link."""
    claims = publish.published_claims(log)
    ends = log.table("links").select("entity_id").distinct()
    return {r[0]: r[1] for r in canonical.canonical_ids(claims, ends).collect()}


def kept(log):
    return {r[0]: r[1] for r in publish.canonical_map(log).collect()}


def test_canonical_ids_are_kept_up_to_date(spark, store):
    sent(spark, store, "a", line("1", "2"), line("2", "3"), line("10", "11"), line("20", "21"), line("21", "22"))
    publish.publish_canonical(store, "c1")
    assert kept(store) == whole(store) == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20, 22: 20}
    claims = {(r[0], r[1]): r[2] for r in store.table("claims").select("subject_entity_id", "object_entity_id", "claim_id").collect()}
    act(spark, store, "d1", "dispute", [claims[1, 2], claims[20, 21]], ground="dating")
    publish.publish_canonical(store, "c2")
    assert kept(store) == whole(store) == {1: 1, 2: 2, 3: 2, 10: 10, 11: 10, 20: 20, 21: 21, 22: 21}
    changed = {r["entity_id"] for r in store.table("canonical", since=store.head() - 1).collect()}
    assert changed == {1, 2, 3, 20, 21, 22}  # 10 and 11 were not looked at
    # Those who left a component must not be drawn back into it by its old list.
    sent(spark, store, "b", line("22", "3"))
    act(spark, store, "d2", "undispute", [claims[20, 21]])
    publish.publish_canonical(store, "c3")
    assert kept(store) == whole(store) == {1: 1, 2: 2, 3: 2, 10: 10, 11: 10, 20: 2, 21: 2, 22: 2}
    act(spark, store, "d3", "dispute", [claims[10, 11]], ground="dating")
    sent(spark, store, "e", line("1", "11"))
    publish.publish_canonical(store, "c4")
    assert kept(store) == whole(store) == {1: 1, 2: 2, 3: 2, 10: 10, 11: 1, 20: 2, 21: 2, 22: 2}
    publish.publish_canonical(store, "c5")  # nothing happened
    assert store.commits()[-1].tables[0]["rows"] == 0 and kept(store) == whole(store)


def resolved(spark, log, run, links, queue, model='{"m":1}'):
    publish.publish_resolution(
        log, run,
        spark.createDataFrame(links, "subject_entity_id long, object_entity_id long, confidence_point double"),
        spark.createDataFrame([(*q, "{}", "queued") for q in queue], "entity_a long, entity_b long, score double, features string, state string"),
        run="er", model=model, agent_id=2, recorded_at=at(),
    )
    pairs = {(r["entity_a"], r["entity_b"]): (r["score"], r["state"]) for r in log.table("queue").collect()}
    report = log.table("reports").where(F.col("run_id") == run).first()
    return (report["inserted"], report["duplicates"], report["rejected"]), pairs


def test_inferred_links_are_claims(spark, store):
    links = [(1, 2, 0.97), (5, 4, 0.99)]
    assert resolved(spark, store, "r1", links, [(7, 8, 0.6), (8, 9, 0.7)]) == ((2, 0, 0), {(7, 8): (0.6, "queued"), (8, 9): (0.7, "queued")})
    claim = store.table("claims").where("subject_entity_id = 1").first()
    assert (claim["method"], claim["predicate"], claim["confidence_point"]) == ("inferred", "same-as", 0.97)
    assert store.table("events").where("event_type = 'assert'").count() == 2
    assert [(r["source"], r["external_id"], r["raw"]) for r in store.table("records").collect()] == [("resolution", "er", '{"m":1}')]
    assert resolved(spark, store, "r2", links, [(7, 8, 0.65)])[0] == (0, 2, 0)
    verdicts = spark.createDataFrame([(7, 8, "rejected")], "entity_a long, entity_b long, state string")
    publish.publish_verdicts(store, "human", verdicts)
    # A new model likes both pairs well enough to link them; the human's no stands.
    counts, queue = resolved(spark, store, "r3", [*links, (7, 8, 0.98), (8, 9, 0.96)], [], '{"m":2}')
    assert counts == (3, 0, 0) and queue == {(7, 8): (0.65, "rejected")}
    assert store.table("records").where("supersedes_record_id IS NOT NULL").count() == 1
    publish.publish_canonical(store, "c")
    assert kept(store) == {1: 1, 2: 1, 4: 4, 5: 4, 8: 8, 9: 8}
