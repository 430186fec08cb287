"""One registered query per operator, and the SQL it is checked with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import (
    chat,
    decontaminate,
    fertility,
    importance,
    language,
    mixing,
    near,
    pii,
    ranked,
    secrets,
    suffixes,
    toxicity,
    wrapper,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# A-Z alone are lowered; words are cut at blank and the controls 9 to 13.
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


@query("op6_minhash_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2
    THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
    WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(doc_id, reach) AS (SELECT u, u FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reach),
m AS (SELECT doc_id, min(reach) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id,
  coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents on 2-word shingles at 0.8."""
    return near.near_duplicates(table(spark, folder, "documents"), size=2)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.train(language.learned_from(docs)))


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with parts of benchmark items, one row per document and item."""
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query("op3_secret_scan", secrets.oracle())
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.secrets(table(spark, folder, "documents")))


@query("op4_source_mixing", mixing.oracle())
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of all documents at the default weights: one row per document and epoch."""
    return mixing.mixed(table(spark, folder, "documents"), with_text=False)


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return wrapper.main_texts(table(spark, folder, "pages"))


@query("op8_chat_formatting", chat.ORACLE)
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of those that are not held out."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, tokeniser measures and verdicts of all documents."""
    return fertility.quality(table(spark, folder, "documents"))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents, by patterns and by the model learned from a sample of them."""
    docs = table(spark, folder, "documents")
    return pii.personal_data(docs, pii.train(docs))


@query("op11_importance_resampling", importance.oracle())
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn towards the features of the benchmark; all documents are listed."""
    return importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_suffix_dedup", suffixes.ORACLE)
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of documents before it."""
    return suffixes.without_repeats(table(spark, folder, "documents"), keep_text=False).drop("kept")


@query("op13_ranked_search", ranked.ORACLE)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
