"""How often the lines of a query are moved, whatever Spark may broadcast."""

import pytest

from claimgraph.operators import ingest
from claimgraph.plans import ingestion
from claimgraph.plans.corpus import Corpus
from claimgraph.schema import relation_types

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ties_read_the_lines_once(no_broadcast):
    plan = _executed(Corpus(no_broadcast, FOLDER).ties.select("claim_id", "subject_entity_id"))
    assert plan.split("Initial Plan")[0].count("lineitem.parquet") == 1


def test_two_reads_of_ties_share_the_lines(no_broadcast):
    c = Corpus(no_broadcast, FOLDER)
    both = c.ties.select("claim_id", "predicate").join(c.ties.where("second_support").select("claim_id", "content_hash"), "claim_id")
    assert both.count() == c.ties.where("second_support").count()
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_dealt_by_predicate(no_broadcast):
    # Three predicates hold all lines. The vocabulary's size is known, so it is broadcast by Spark's own check.
    no_broadcast.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    lines = no_broadcast.range(1000).selectExpr("id AS line_no", "IF(id % 2 = 0, 'associated-with', 'knows-' || id) AS predicate")
    checked = ingest.check_predicate(lines, relation_types(no_broadcast))
    assert "BroadcastHashJoin" in checked._jdf.queryExecution().executedPlan().toString()
    assert checked.where("known_predicate").count() == 500


def test_support_and_versions_without_second_derivations(no_broadcast, monkeypatch):
    written, real = {}, ingest.materialise

    def kept(df, name):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(ingest, "materialise", kept)
    out = ingestion.imported(Corpus(no_broadcast, FOLDER))
    # The lines' supports are read for the winners, their records and the keys; the chain reads what was written.
    assert written["records"].count("posexplode") < written["new-records"].count("posexplode")
    support = out["support"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in support and "Aggregate" not in support
    named = out["records"].select("source_record_id")
    assert out["support"].count() == out["support"].distinct().join(named, "source_record_id").count()
