"""Stream targets that survive a lost checkpoint, repeats and compaction; the kept name index."""

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import ingest, search
from claimgraph.sources.runs import RunLog
from claimgraph.streaming import projection

SCHEMA = "id string, claim_id long, event_type string, occurred_at timestamp_ntz, actor_agent_id long, payload string"


def event(spark, folder, *rows):
    full = [(f"e{i}", c, kind, f"2024-01-0{day} 00:00:00", 1, "{}") for i, c, kind, day in rows]
    frame = spark.createDataFrame(full, SCHEMA.replace("timestamp_ntz", "string"))
    frame.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, target, checkpoint):
    projection.stream_status(projection.read_feed(spark, folder, SCHEMA), target, checkpoint).awaitTermination()
    return {r["claim_id"]: r["status"] for r in projection.latest_versions(spark, target, "claim_id").collect()}


def test_a_new_checkpoint_on_an_old_target_wins(spark, tmp_path):
    folder, target = str(tmp_path / "feed"), str(tmp_path / "out")
    event(spark, folder, (1, 1, "assert", 1), (2, 2, "assert", 1))
    first = str(tmp_path / "c1")
    assert drain(spark, folder, target, first) == {1: "asserted", 2: "asserted"}
    for number, (kind, day) in enumerate([("dispute", 2), ("undispute", 3), ("dispute", 4)]):
        event(spark, folder, (10 + number, 1, kind, day))
        drain(spark, folder, target, first)
    assert drain(spark, folder, target, first) == {1: "disputed", 2: "asserted"}
    # The checkpoint is lost; the new query's batches count from 0 again.
    event(spark, folder, (20, 1, "supersede", 5))
    assert drain(spark, folder, target, str(tmp_path / "c2")) == {1: "superseded", 2: "asserted"}


def test_a_batch_delivered_again_changes_nothing_and_compaction_keeps_results(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("feed", "out", "c"))
    event(spark, folder, (1, 1, "assert", 1), (2, 2, "assert", 1))
    drain(spark, folder, target, checkpoint)
    event(spark, folder, (3, 2, "dispute", 2))
    before = drain(spark, folder, target, checkpoint)
    log = RunLog(spark, target)
    count = len(log.commits())
    write = projection._publisher(target, checkpoint)
    write(spark.createDataFrame([(1, "nonsense")], "claim_id long, status string"), 0)
    assert len(RunLog(spark, target).commits()) == count
    rows = log.table("rows").count()
    projection.compact_versions(spark, target, "claim_id")
    after = RunLog(spark, target)
    assert after.table("rows").count() == 2 < rows
    assert {r["claim_id"]: r["status"] for r in projection.latest_versions(spark, target, "claim_id").collect()} == before
    event(spark, folder, (4, 2, "undispute", 3))
    assert drain(spark, folder, target, checkpoint) == {1: "asserted", 2: "asserted"}


@pytest.fixture
def few_parts(monkeypatch):
    monkeypatch.setattr(ingest, "STORE_BUCKETS", 8)


def test_the_kept_index_equals_a_rebuild(spark, tmp_path, few_parts):
    names = spark.createDataFrame(
        [(n,) for n in ("Anna Berg", "Anne Bergh", "Hanna van der Berg", "Jo", "jo smith", "Smyth, John", None, "Anna Berg", "é")], "name string"
    )
    more = spark.createDataFrame([("Anna Berg",), ("Berga Ann",), ("Johanna",)], "name string")
    asked = spark.createDataFrame([("anna berg",), ("jo",), ("x",), ("berg",), ("smith jon",)], "q string")
    log = RunLog(spark, str(tmp_path / "index"))
    search.publish_names(log, "a", names)
    search.publish_names(log, "b", more)
    found = sorted(map(tuple, search.match_published(log, asked).collect()))
    assert found and found == sorted(map(tuple, search.match_names(asked, names.unionByName(more).where("name IS NOT NULL")).collect()))
    assert log.table("indexed_names", since=1).count() == 2  # Anna Berg is indexed already
    one = spark.createDataFrame([("jo",)], "q string")
    plan = search.match_published(log, one)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 4 and "bucket#" in text.split("PartitionFilters")[1].split("]")[0]
