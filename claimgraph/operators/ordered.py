"""Order-sensitive steps that stay bounded when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.session import materialise


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A plain projection may be merged into every filter and projection above it, which
    repeats costly expressions such as parsing. A generator of one struct is not. It takes finished values, since a
    generator interprets its expressions, which a projection compiles.
    """
    made = df.withColumns({f"_once_{n}": c for n, c in columns.items()})
    row = F.struct(*[F.col(f"_once_{n}").alias(n) for n in columns])
    return made.select(*df.columns, F.inline_outer(F.array(row)))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole first row of each key, NULL keys being equal.

    One mergeable aggregate: partial results are combined before the shuffle, so
    a hot key sends one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def carry_before(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], carried: dict[str, Column]
) -> DataFrame:
    """Add, per row, the last non-NULL value of each expression over *earlier* rows.

    ``bucket`` must grow with ``order`` inside a key. Rows are windowed per
    (key, bucket) and each bucket's last values are carried over per key, so the
    largest sorted group is one bucket, not one key.
    """
    position = F.struct(*order)
    rows = df.withColumn("_bucket", bucket).withColumns(
        {f"_v_{n}": e for n, e in carried.items()}
    )
    tails = rows.groupBy(*keys, "_bucket").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
            for n in carried
        ]
    )
    across = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    tails = tails.select(
        *keys,
        "_bucket",
        *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in carried],
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(tails, [*keys, "_bucket"])
    return joined.withColumns(
        {
            n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(within), F.col(f"_c_{n}"))
            for n in carried
        }
    ).select(*df.columns, *carried)


def sequence_bucket(order: str, width: int = 100_000) -> Column:
    """Bucket of a unique sequence number: at most ``width`` rows each."""
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``line_no`` 1, 2, ... in the order of the given columns, which must be unique.

    Rows are range-partitioned and sorted and counted per range, so no task sorts more than its range. They are
    written once, with their places in their ranges, to the shared folder, which keeps the numbers whatever becomes
    of the executors; what a range starts with is added when they are read.
    """
    # The high bits of a place are its range, the low 33 the row in it.
    ranged = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()),
        "ranges",
    )
    span = F.shiftright("_place", 33)
    sizes = ranged.groupBy(span.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(
        sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts"
    )
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("_range", span).join(F.broadcast(starts), "_range")  # one row per shuffle partition
        .withColumn("line_no", F.col("_start") + row + 1).drop("_range", "_start", "_place")
    )
