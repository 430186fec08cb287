"""An import does its work once: rules of parts in order, lines, duplicates, the store and the identities."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from claimgraph.operators import ingest, validate
from claimgraph.plans import ingestion
from claimgraph.plans.corpus import Corpus
from tests.test_wire_import import _line, _plan, _record

FOLDER = "/root/testdata/sf0.001"
SCORE = {"kind": "source_native_scalar", "scale": "s", "raw": 1, "point": 0.5, "calibrated": False}
# Lines and how many rules need a look: those whose part is not told to be in order.
LOOKS = [
    (_line(), 0), (_line(confidence=SCORE | {"point": 9.9}), 1), (_line(confidence={"kind": "x"}), 1),
    (_line(extra=1), 1), (_line(**{"a b": 1}), 15), (_line(subject={"authority": "t"}), 1), (_line(predicate="Bad Slug"), 1),
    (_line(predicate=7), 1), (_line(object={"entity": {"authority": "t", "id": "2"}, "literal": {"kind": "year", "value": 1}}), 3),
    (_line(support=[]), 1), (_line(support=[_record(), {"source": "s"}]), 1), (_line(support=[_record(content_hash="")]), 1),
    (_line(valid_time={"start_earliest": "1600-02-30"}), 1), (_line(valid_time=None), 1), (_line(method_detail=3), 1),
    (_line(method_detail={}, valid_time={"original": {"x": [1]}, "approximate": True}), 0), (_line(schema_version="2"), 1),
    (_line(**{f"k{n}": n for n in range(60)}), 14), ("7", 15),
]


def test_only_parts_out_of_order_are_examined(spark):
    rows = spark.createDataFrame([(n, line) for n, (line, _) in enumerate(LOOKS)], "line_no int, line string")
    v = F.col("parsed")
    checked = validate.validate_claims(rows)
    told = validate._in_order(F.col("typed"), validate._marks(v))
    failed = [f for _, f in validate.claim_rules(v)]
    out = checked.select(
        "line_no", "errors", validate._errors(validate.claim_rules(v)).alias("every"), F.array(*told).alias("told"),
        F.array(*failed).alias("failed"), reduce(and_, told).alias("plain"),
    ).orderBy("line_no").collect()
    for (line, _), r in zip(LOOKS, out, strict=True):
        assert r["errors"] == r["every"], line
        assert not any(ok and bad for ok, bad in zip(r["told"], r["failed"], strict=True)), line
        assert r["plain"] == all(r["told"])
    looks = [sum(not ok for ok in r["told"]) for r in out]
    assert all(a <= b for a, (_, b) in zip(looks, LOOKS, strict=True)), looks


def test_a_line_is_written_once(spark):
    lines = ingestion.wire_lines(Corpus(spark, FOLDER))
    assert _plan(lines).count("StructsToJsonEvaluator") <= 2  # the line, and a part that is never in it


def test_store_is_derived_once_and_duplicates_are_looked_for_once(spark, monkeypatch):
    written, real = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: (written.append(name), real(df, name))[1])
    corpus = Corpus(spark, FOLDER)
    store = ingestion.store(corpus)
    assert "Window" not in _plan(store.claims) + _plan(store.support)
    out = ingestion.imported(corpus, into=store)
    assert written.count("wanted") == 1
    joined = out["claims"].select("claim_id", *ingest.IDENTITY).join(out["support"], "claim_id")
    assert out["identities"].exceptAll(joined).isEmpty() and joined.exceptAll(out["identities"]).isEmpty()
    assert "Join" not in _plan(out["identities"])
