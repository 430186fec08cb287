"""A batch of lines at size: what is shuffled, written and computed for it, and how often."""

import json

from pyspark.sql import functions as F

from claimgraph import session
from claimgraph.operators import ingest, ordered, validate
from claimgraph.plans import all_queries, ingestion
from claimgraph.plans.corpus import Corpus

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_are_dense_over_many_ranges_and_written_once(spark, monkeypatch):
    written, real = [], ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, name: (written.append(name), real(df, name))[1])
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") % 2).alias("turn"), F.hash("id").alias("h"), "id")
    out = ordered.numbered(rows, "turn", "h", "id")
    assert "Window" not in _plan(out)
    got = sorted(out.collect(), key=lambda r: (r["turn"], r["h"], r["id"]))
    assert [r["line_no"] for r in got] == list(range(1, 5001))
    assert "ranges" in written and "numbered" not in written
    assert ordered.numbered(rows.limit(0), "id").count() == 0


def test_lines_are_made_after_their_numbers(spark, monkeypatch):
    wide, real = [], ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, name: (wide.append("line" in df.columns), real(df, name))[1])
    lines = ingestion.wire_lines(Corpus(spark, FOLDER))
    assert wide and not any(wide)
    assert set(lines.columns) == {"line_no", "line"}


def test_hashes_are_made_after_the_numbers(spark, monkeypatch):
    moved, real = [], ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, name: (moved.append(_plan(df)), real(df, name))[1])
    corpus = Corpus(spark, FOLDER)
    rows = ingestion.with_records(ordered.numbered(corpus.ties.select(*ingestion.TIE_KEYS), "claim_id"))
    assert moved and not any("md5(" in plan for plan in moved)
    whole = corpus.ties.select(*ingestion.TIE_PARTS)
    made = rows.select(*ingestion.TIE_PARTS)
    assert made.count() == whole.count() and made.exceptAll(whole).isEmpty()
    moved.clear()
    ingestion.wire_lines(corpus)
    assert moved and not any("md5(" in plan for plan in moved)


def test_shuffle_files_go_with_the_plan_that_made_them(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before, flag = shuffled(), spark.conf.get(session._CLEAN, "false")
    kept = session.materialise(spark.range(0, 1000, 1, 8).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert not [n for n in shuffled() - before if n.endswith(".data")]
    assert kept.count() == 7
    assert spark.conf.get(session._CLEAN, "false") == flag


def test_report_reads_the_lines_once(spark):
    lines = spark.createDataFrame([(1, "{"), (2, "7"), (3, "{")], "line_no bigint, line string")
    report = validate.validation_report(validate.validate_claims(lines))
    assert _plan(report).count("try_parse_json") + _plan(report).count("parseJson") <= 1
    got = {r["item"]: r["n"] for r in report.collect()}
    assert (got["lines"], got["failed lines"], got["invalid JSON"], got["not an object"]) == (3, 3, 2, 1)
    empty = validate.validation_report(validate.validate_claims(lines.limit(0))).collect()
    assert {r["item"]: r["n"] for r in empty} == {"lines": 0, "failed lines": 0}


def _line(**changes):
    base = {
        "schema_version": "0.1.0", "subject": {"authority": "t", "id": "1"}, "predicate": "associated-with",
        "object": {"entity": {"authority": "t", "id": "2"}}, "confidence": {"kind": "unscored"},
        "method": "imported", "asserted_by": "pipeline",
        "support": [{"source": "s", "record_kind": "p", "external_id": "1", "content_hash": "h", "raw": {}}],
    }
    return json.dumps(base | changes)


def _record(**changes):
    return {"source": "s", "record_kind": "p", "external_id": "1", "content_hash": "h", "raw": 1} | changes


def test_valid_lines_in_any_key_order_are_seen_by_the_fast_path(spark):
    deep = {"a": {"b": [1, {"c": "x"}]}}
    score = {"scale": "s", "kind": "source_native_scalar", "point": 0.50, "raw": deep, "calibrated": False}
    good = [
        _line(support=[_record(raw=deep), _record(raw="x")]), _line(confidence=score),
        _line(valid_time={}), _line(valid_time={"original": deep, "approximate": True}),
        _line().replace('"imported"', '  "imported"'), _line(confidence=score).replace("0.5", "5e-1"),
        _line(support=[_record(raw="x" * 100_000)]),
    ]
    bad = [
        _line(support=[_record(raw={"a>, record_kind: STRING, source: STRING>>": 1}, more=1)]),
        _line(support=[_record(), {"source": "s"}]), _line(support=[_record(), None]),
        _line(**{"zz`": 1}), _line(valid_time={"start_earliest": "1600-02-30"}),
        _line(valid_time={"original": 1, "origin": 1}), _line(object={"entity": {"authority": "t", "id": ""}}),
    ]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "line_no int, line string")
    out = validate.validate_claims(rows).select(
        "line_no", "errors", validate.plainly_valid(F.col("typed"), F.col("parsed")).alias("fast")
    ).orderBy("line_no").collect()
    assert [r["fast"] for r in out] == [True] * len(good) + [False] * len(bad)
    assert [not r["errors"] for r in out] == [True] * len(good) + [False] * len(bad)


def test_second_import_runs_each_import_once(spark, monkeypatch):
    calls, real = [], ingest.import_claims
    monkeypatch.setattr(ingest, "import_claims", lambda *a, **b: (calls.append(b["run_id"]), real(*a, **b))[1])
    report = all_queries()[0]["i15b_second_import"](spark, FOLDER).collect()
    assert calls == ["run-1", "run-2"]
    assert report[0]["inserted"] == 0


def test_records_are_derived_once(spark, monkeypatch):
    written, real = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: (written.append((name, _plan(df))), real(df, name))[1])
    ingestion.imported(Corpus(spark, FOLDER))
    plans = dict(written)
    assert "Window" in plans["records"] and "Window" not in plans["outcomes"]
