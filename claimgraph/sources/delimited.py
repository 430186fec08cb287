"""CSV and TSV source rows, and the check of input files against known hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_CHUNK = 1 << 22


def read_delimited(
    spark: SparkSession, path: str, record_kind: str | None = None, columns=None, multi_line: bool = False
) -> DataFrame:
    """Rows with a header, all text, missing values as ``""``.

    ``.tsv`` and ``.tab`` files are tab separated, all others comma separated. Naming
    the ``columns`` picks them by the header's names, whatever their order in the file. Only with
    ``multi_line`` may a quoted value hold line breaks; such a file is one task, others are split.
    """
    tabbed = path.lower().rstrip("/").endswith((".tsv", ".tab"))
    reader = (
        spark.read.option("header", True)
        .option("sep", "\t" if tabbed else ",")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", "")
    )
    rows = reader.csv(path).na.fill("")
    if columns is not None:
        rows = rows.select(*columns)
    return rows if record_kind is None else rows.withColumn("record_kind", F.lit(record_kind))


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, actual``: each file is streamed through one task in small chunks.

    A digest runs over a file in order, so a file is the unit of work; files are spread
    over the tasks and none is held in memory.
    """
    chunk_size = HASH_CHUNK

    def digest_files(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            digests = []
            for path in batch["path"]:
                store, name = (
                    fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                )
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while chunk := stream.read(chunk_size):
                        digest.update(chunk)
                digests.append("sha256:" + digest.hexdigest())
            yield batch.assign(actual=digests)

    named = spark.createDataFrame([(p,) for p in paths], "path string")
    return named.repartition(max(1, len(paths)), "path").mapInPandas(
        digest_files, "path string, actual string"
    )


def verify_inputs(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    """``path, expected, actual, ok`` per file; call :func:`require_verified` on it."""
    wanted = spark.createDataFrame(list(expected.items()), "path string, expected string")
    found = file_hashes(spark, list(expected))
    return wanted.join(found, "path", "left").withColumn(
        "ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    )


def require_verified(report: DataFrame) -> None:
    """Stop before anything is written when one input file differs."""
    bad = [r["path"] for r in report.where(~F.col("ok")).select("path").orderBy("path").collect()]
    if bad:
        raise ValueError(f"{len(bad)} input files differ from their recorded hashes: " + ", ".join(bad))
