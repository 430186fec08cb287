"""Tables that one run writes to the shared folder to cut lineage, and removes when they have served."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgraph.session import fresh_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A run folder below ``spark.checkpoint.dir``.

    A written table replaces the plan that made it, so the shuffle files of that plan are removed
    as soon as it is there: the disk in use is that of one step, not of the whole run.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = fresh_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
