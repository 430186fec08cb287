"""The corpus pipeline: documents in, a training mixture out.

Each stage works on all that its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm import decontaminate, language, mixing, near, secrets
from claimgraph.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the others go. ``lang`` stays as it was given.

    Null and empty texts, and those without a letter, are of no language and go. Repeated rows fare alike.
    """
    docs = docs.select(*COLUMNS)
    return language.identified(docs, language.train(language.learned_from(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), the one with the smallest id.

    Rows without an id stay. Rows that repeat id and text leave one row; of different texts under one id each is a
    document: one of them stands under the id, the others behind all ids, so a text goes only if a near duplicate
    of it stays. Null and empty texts duplicate nothing; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    named, key = docs.where("doc_id IS NOT NULL"), F.col("doc_id").alias("__key")
    again = named.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    keyed = named.select("*", key)
    if not again.isEmpty():
        mark = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256)
        rest = [c for c in COLUMNS if c != "doc_id"]
        several = (
            named.join(again, "doc_id", "left_semi").groupBy("doc_id", mark.alias("__mark"))
            .agg(F.min(F.struct(*rest)).alias("__row"))
        )
        first = several.groupBy("doc_id").agg(F.min("__mark").alias("__mark"))
        last = named.agg(F.max("doc_id")).first()[0]
        behind = several.join(first, ["doc_id", "__mark"], "left_anti").select(
            "doc_id", "__row.*", (F.lit(last) + 1 + F.monotonically_increasing_id()).alias("__key")
        )
        behind = Scratch(spark, "several").write(behind, "behind")  # the numbers must not change
        under = several.join(first, ["doc_id", "__mark"], "left_semi").select("doc_id", "__row.*")
        single = named.join(again, "doc_id", "left_anti").unionByName(under)
        keyed = single.select("*", key).unionByName(behind)
    texts = keyed.select(F.col("__key").alias("doc_id"), "text")
    gone = near.near_duplicates(texts, size=5).where("NOT kept").select(F.col("doc_id").alias("__key"))
    kept = keyed.join(gone, "__key", "left_anti")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark. Null and empty texts hold none; repeated rows fare alike."""
    return decontaminate.decontaminated(
        docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind. A null text stays null; no row goes."""
    return secrets.without_secrets(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once per epoch, with ``domain``, ``n_tokens`` and ``epoch``.

    Texts without a word have no token and are taken with their leaf; rows of one id are taken together.
    """
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
]

# The language stage has no SQL form; tests check the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written below the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
