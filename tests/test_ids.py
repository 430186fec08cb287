"""Ids of the derived claim tables and of every writer of events are unique at any size."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimgraph.operators import actions, ingest
from claimgraph.operators.ordered import numbered
from claimgraph.plans.corpus import Corpus

ROOT = "/root/testdata"


def check(corpus):
    for frame, key in (
        (corpus.recorded_claims, "claim_id"), (corpus.entities, "entity_id"), (corpus.events, "id"),
        (corpus.records, "source_record_id"),
    ):
        n, distinct, nulls = frame.agg(
            F.count("*"), F.countDistinct(key), F.count_if(F.col(key).isNull())
        ).first()
        assert (n, nulls) == (distinct, 0), key


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_ids_of_the_given_tables(spark, folder):
    check(Corpus(spark, f"{ROOT}/{folder}"))


def test_ids_of_wide_keys_and_repeated_lines(spark, tmp_path):
    day = dt.datetime(1998, 3, 1)
    line = dict(
        l_orderkey=1, l_partkey=150_000, l_suppkey=12_000, l_linenumber=1, l_quantity=45.0, l_extendedprice=1.0, l_discount=0.05,
        l_tax=0.05, l_returnflag="N", l_linestatus="F", l_shipdate=day,
    )
    lines = [line, line, line | {"l_tax": 0.01}, line | {"l_linenumber": 2, "l_partkey": 50_000}, line | {"l_orderkey": 5_000_000_000}]
    given = {t: pq.read_table(f"{ROOT}/sf0.001/{t}.parquet") for t in ("orders", "customer", "supplier", "part", "events", "region", "nation")}
    changed = {
        "lineitem": pa.Table.from_pylist(lines, pq.read_schema(f"{ROOT}/sf0.001/lineitem.parquet")),
        "orders": pa.Table.from_pylist(
            [r | {"o_orderkey": k} for r, k in zip(given["orders"].to_pylist(), (1, 5_000_000_000), strict=False)], given["orders"].schema
        ),
        "customer": pa.Table.from_pylist(
            [given["customer"].to_pylist()[0] | {"c_custkey": k} for k in (1, 2_000_000_000, 4_000_000_003)], given["customer"].schema
        ),
        "supplier": pa.Table.from_pylist(
            [given["supplier"].to_pylist()[0] | {"s_suppkey": k} for k in (12_000, 1_000_000_000)], given["supplier"].schema
        ),
        "part": pa.Table.from_pylist(
            [given["part"].to_pylist()[0] | {"p_partkey": k} for k in (50_000, 150_000, 1_000_000_000)], given["part"].schema
        ),
    }
    for name, table in (given | changed).items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
    corpus = Corpus(spark, str(tmp_path))
    assert corpus.ties.count() == len(lines)
    check(corpus)


def test_line_ids_stay_inside_their_batch(spark):
    rows = spark.createDataFrame([(0,), ((1 << 40) - 1,)], "line_no long")
    ids = [r[0] for b in (0, 1) for r in rows.select(ingest.line_id(b, F.col("line_no"))).collect()]
    assert len(set(ids)) == 4
    with pytest.raises(Exception, match="number the lines densely"):
        spark.createDataFrame([(1 << 40,)], "line_no long").select(ingest.line_id(0, F.col("line_no"))).collect()
    with pytest.raises(ValueError):
        ingest.line_id(1 << 23, F.col("line_no"))


def test_writers_of_one_log_share_no_event_id(spark):
    claims = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 1), (2, dt.datetime(2024, 1, 1), 1)], "claim_id long, recorded_at timestamp, asserted_by_agent_id long"
    )
    judged = spark.createDataFrame(
        [(1, "dispute", 1, "dating", None, None, 1, dt.datetime(2024, 1, 1), None, False), (2, "supersede", 2, None, None, None, 1, dt.datetime(2024, 1, 1), None, False)],
        "seq long, kind string, claim_id long, ground string, reason string, point double, agent_id long, occurred_at timestamp, refusal string, routed boolean",
    )
    new = spark.createDataFrame([(2, 9)], "seq long, new_claim_id long")
    logs = [
        ingest.assert_events(claims), actions.dispute(judged, "a")[0], actions.dispute(judged, "b")[0],
        actions.supersede(judged, new, "a")[0],
    ]
    ids = [r["id"] for log in logs for r in log.collect()]
    assert len(ids) == len(set(ids)) == 5


def test_lines_are_numbered_densely_in_order(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("line"))
    found = numbered(rows.repartition(7), "line").orderBy("line").collect()
    assert [r["line_no"] for r in found] == list(range(1, 5001))
