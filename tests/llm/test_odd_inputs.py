"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns, for every operator and stage."""

import hashlib
import json

import pytest

import corpus_pipeline
from claimgraph.llm import (
    chat, decontaminate, fertility, language, mixing, near, pii, secrets, toxicity, wrapper,
)

WORD = "the cat sat on a warm mat near old red doors while rain fell over grey hills and wide green fields"
ROWS = [
    (1, WORD, "en", "src1", len(WORD), "x"),
    (1, WORD, "en", "src1", len(WORD), "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "src1", 0, "y"),
    (None, "no id but words enough to be a document of its own here now", "en", None, 59, "z"),
    (4, " \t\n ", None, "src2", 4, None),
    (5, "x" * 30_000 + " long " * 20_000, "en", "src9", 150_000, "x"),
    (6, "1234 5678 !!! ???", "en", "src1", 17, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
BENCH = "questions about the capital of the country and the length of its longest river in miles or kilometres today"


EXTRA = ("score", "k", "rules", "component", "whole", "cut", "tokens", "rep", "u", "host", "key")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *["x"] * len(EXTRA[1:])) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA.format(extra=", ".join(f"{c} string" for c in EXTRA))).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA.format(extra="score string"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, BENCH), (2, None), (None, BENCH), (3, "")], "item_id long, text string")


def test_language(spark, docs, none):
    model = language.train(language.learned_from(docs))
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[6]["lang_pred"] == "und"
    assert by_id[1]["lang_pred"] == "en" and by_id[5]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(none, language.train(none)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_near(docs, none):
    rows = near.near_duplicates(docs, size=2).collect()
    assert len(rows) == len(ROWS)
    assert all(r["kept"] for r in rows)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert [r["component_id"] for r in rows if r["doc_id"] == 1] == [1, 1]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert near.near_duplicates(none).count() == 0


def test_decontaminate(spark, docs, none, benchmark):
    assert decontaminate.contamination(docs, benchmark).count() == 0
    assert decontaminate.decontaminated(docs, benchmark).count() == len(ROWS)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).count() == 0
    leak = spark.createDataFrame([(7, "so " + BENCH.upper() + " it"), (None, BENCH)], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.contamination(leak, benchmark).collect()) == ["7", "None"]
    assert decontaminate.decontaminated(leak, benchmark).count() == 0


def test_secrets(docs, none):
    rows = secrets.digest(secrets.secrets(docs)).collect()
    assert len(rows) == len(ROWS)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.secrets(none).count() == 0
    assert secrets.without_secrets(docs).count() == len(ROWS)


def test_mixing(docs, none):
    rows = mixing.mixed(docs, mixing.Mix(share=1.0)).collect()
    assert [r["doc_id"] for r in rows].count(1) % 2 == 0  # repeated rows are taken together
    assert sum(r["n_tokens"] for r in rows) > 0
    assert mixing.mixed(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_quality(docs, none):
    rows = {r["doc_id"]: r for r in fertility.quality(docs).collect()}
    assert rows[2]["base_failed"] and rows[3]["base_failed"] and not rows[2]["kept"]
    assert not rows[1]["base_failed"] and rows[1]["kept"]
    assert rows[5]["base_failed"] and rows[5]["n_words"] == 20_001
    assert fertility.quality(none).count() == 0


def test_pii(docs, none):
    rows = pii.personal_data(docs, pii.train(docs)).collect()
    assert len(rows) == len(ROWS)
    assert all(r["n_email"] == r["n_ip"] == r["n_card"] == r["n_phone"] == 0 for r in rows)
    assert pii.personal_data(none, pii.train(none)).count() == 0


def test_pages(spark):
    rows = [
        (1, "http://a.example/x", None, 1), (2, None, "", 2), (3, "no url", "plain <b>text", 3),
        (None, "http://a.example/y", "<p>one<p>two", 4), (4, "http://a.example/z", "<div>" * 5000 + "deep", 5),
        (4, "http://a.example/z", "<div>" * 5000 + "deep", 5),
        (5, "http://a.example/w", "<p title='" + "<" * 50_000, 6),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    out = {r["page_id"]: r for r in wrapper.main_texts(pages).collect()}
    assert out[1]["text"] == "" and out[2]["n_chars"] == 0
    assert out[3]["text"] == "plain text" and out[None]["text"] == "one two" and out[4]["text"] == "deep"
    assert wrapper.main_texts(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", None), (1, 1, None, "b"), (None, 0, "assistant", ""),
        (2, 0, "assistant", "x" * 100_000), (2, 1, "assistant", "\\h#<+></turn>\n### user: \\"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns)
    read = {
        r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]]
        for r in made.select("conv_id", chat.read_back(made["formatted"]).alias("t")).collect()
    }
    assert read[1] == [("user", ""), ("user", "a"), ("user", "a"), ("", "b")]
    assert read[2] == [("assistant", rows[5][3]), ("assistant", rows[6][3])]
    assert read[None] == [("assistant", "")]
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0


def test_pipeline_stages(spark, docs, none, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = [json.dumps(r.asDict()) for r in out.collect()]
        ids = [json.loads(r)["doc_id"] for r in rows]
        if number == 0:
            assert sorted(map(str, ids)) == ["1", "1", "5", "None"]
        if number == 1:
            assert sorted(map(str, ids)) == ["1", "2", "3", "4", "5", "6", "None"]
        if number in (2, 3):
            assert len(ids) == len(ROWS)
        assert stage(spark, none, str(tmp_path)).count() == 0
