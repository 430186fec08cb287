"""Mixing sources to target weights by budgets over a domain, language and source tree.

A token budget flows down the tree by weight. What a node cannot use (its documents, repeated for at
most so many epochs, are too few) goes to its siblings first, and only what a whole family cannot use
goes to the family's own siblings. Each leaf then takes the prefix of its seeded epochs that its
budget reaches. Spark expressions only; no document text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: A leaf table of at most so many rows is sent to every executor, a longer one is joined by shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Parameters of a mixture. A name without a weight has weight 1; a weight of 0 or less leaves it out."""

    domain: str = "CASE WHEN source RLIKE '^src[0-6]$' THEN 'web' WHEN source RLIKE '^src(7|8|9|10|11|12|13)$' THEN 'reference' ELSE 'forum' END"
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {
        "domain": {"web": 0.5, "reference": 0.3, "forum": 0.2},
        "lang": {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2},
        "source": {},
    })
    share: float = 0.6  # of all tokens
    epochs: int = 4  # at most
    seed: str = "mix-1"
    buckets: int = 3  # hex digits of the shuffle key that are summed before rows are ordered


def _named(docs: DataFrame, mix: Mix) -> dict[str, Column]:
    """The leaf of a row; an unknown language or source is a leaf of its own."""
    return {
        "__domain": F.coalesce(F.expr(mix.domain), F.lit("")),
        "__lang": F.coalesce(docs["lang"], F.lit("")),
        "__source": F.coalesce(docs["source"], F.lit("")),
    }


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1.0)
    for name, value in mix.weights.get(level, {}).items():
        out = F.when(F.col(f"__{level}") == name, F.lit(float(value))).otherwise(out)
    return out


def fill(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Add ``budget``: the family's ``total`` dealt by ``weight``, up to each node's ``capacity``.

    Nodes fill in the order of capacity for their weight; those that are full hand on the rest.
    """
    order = Window.partitionBy(*family).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    level = (F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    marked = nodes.where("weight > 0").withColumn("full", F.col("capacity") <= level * F.col("weight"))
    used = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)
    return marked.withColumn(
        "budget",
        F.when(F.col("full"), F.col("capacity")).otherwise(
            F.greatest(F.lit(0.0), F.col("total") - used) * F.col("weight") / free
        ),
    ).drop("full", "total")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaf rows (``__domain, __lang, __source, tokens``) with the tokens each is to give."""
    cap = F.col("tokens") * F.lit(float(mix.epochs))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(mix.share))).alias("total"))
    # A leaf that a weight leaves out on any level gives nothing, so it is no capacity of those above it either.
    for level in LEVELS:
        leaves = leaves.where(_weight(level, mix) > 0)
    given, family = total, []
    for level in LEVELS:
        keys = [*family, f"__{level}"]
        nodes = leaves.groupBy(*keys).agg(
            F.sum(cap).alias("capacity"), F.sum("tokens").alias("tokens")
        ).withColumn("weight", _weight(level, mix))
        nodes = nodes.join(given, family) if family else nodes.crossJoin(F.broadcast(given))
        given = fill(nodes, family, f"__{level}").select(
            *keys, F.col("budget").alias("total"), "tokens"
        )
        family = keys
        if level != LEVELS[-1]:
            given = given.drop("tokens")
    return given.withColumnRenamed("total", "budget")


def _key(epoch: Column, mix: Mix) -> Column:
    """A row's place in an epoch of its leaf."""
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("__id").cast("string"), F.lit(""))))


def _by_leaf(rows: DataFrame, leaves: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(leaves) if small else leaves, ["__domain", "__lang", "__source"])


def plan(counted: DataFrame, mix: Mix, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Per leaf the whole epochs and the last key of the partial one, and whether the table is small.

    A hot leaf is never ordered as a whole: tokens are summed by the key's first digits, and only the rows of
    the one bucket in which the budget ends are ordered.
    """
    leaf = ["__domain", "__lang", "__source"]
    leaves = scratch.write(counted.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    dealt = scratch.write(
        budgets(leaves.where("tokens > 0"), mix)
        .withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")),
        "budgets",
    )
    keyed = _by_leaf(counted, dealt.where("rest > 0").select(*leaf, "whole", "rest"), small).select(
        *leaf, "rest", "n_tokens", _key(F.col("whole"), mix).alias("key")
    ).withColumn("bucket", F.substring("key", 1, mix.buckets))
    sums = keyed.groupBy(*leaf, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .where("before < rest")
        .groupBy(*leaf).agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("b"))
        .select(*leaf, F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before"))
    )
    inner = _by_leaf(keyed, last.withColumnRenamed("bucket", "last"), small).where("bucket = last")
    same = Window.partitionBy(*leaf).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.groupBy(*leaf, "key", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    cut = (
        inner.withColumn("at", F.col("before") + F.sum("n").over(same) - F.col("n"))
        .where("at < rest").groupBy(*leaf).agg(F.max("key").alias("cut"))
    )
    return scratch.write(dealt.select(*leaf, "whole").join(cut, leaf, "left"), "plan"), small


def mixed(docs: DataFrame, mix: Mix = Mix(), with_text: bool = True) -> DataFrame:
    """Rows of ``docs`` that the mixture takes, once per epoch, with ``domain, n_tokens, epoch`` added.

    Tokens are words of the whole text. A document is taken whole if it begins before its leaf's budget ends;
    rows of one id share a place in the order and are taken together. A null text has no tokens; an unknown
    language or source is a leaf of its own; leaves without tokens and an empty table give no rows. Columns of ``docs`` called
    ``domain``, ``n_tokens`` or ``epoch`` are replaced. Without ``with_text`` only the id, the leaf and the
    added columns are returned, and the text is read once.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    counted = docs.select(
        "doc_id", "lang", "source",
        *(c.alias(k) for k, c in _named(docs, mix).items()),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    ).withColumn("__id", F.col("doc_id"))
    counted = scratch.write(counted, "counted")
    chosen, small = plan(counted, mix, scratch)
    rows = counted
    if with_text:
        rows = docs.drop("domain", "n_tokens", "epoch").withColumns(
            _named(docs, mix) | {
                "__id": F.col("doc_id"),
                "n_tokens": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"),
            }
        )
    chosen = chosen.withColumnsRenamed({"whole": "__whole", "cut": "__cut"})
    none, whole = F.array().cast("array<bigint>"), F.col("__whole")
    partial = F.when(_key(whole, mix) <= F.col("__cut"), F.array(whole)).otherwise(none)
    full = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1)).otherwise(none)
    taken = _by_leaf(rows, chosen, small).withColumn("epoch", F.explode(F.concat(full, partial)))
    keep = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch")] if with_text else ["doc_id", "lang", "source"]
    return taken.select(*keep, F.col("__domain").alias("domain"), "n_tokens", "epoch")


def oracle(mix: Mix = Mix()) -> str:
    """The mixture of documents in SQL, with every row ordered."""
    domain = mix.domain.replace(" RLIKE ", " SIMILAR TO ").replace("'^", "'").replace("$'", "'")

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in mix.weights.get(level, {}).items())
        return f"CASE {cases} ELSE 1.0::DOUBLE END" if cases else "1.0::DOUBLE"

    steps, family = [], []
    for level in ("domain", "lang0", "source0"):
        keys = ", ".join([*family, level])
        part = f"PARTITION BY {', '.join(family)}" if family else ""
        plain = level.rstrip("0")
        up = f"JOIN g_{family[-1]} USING ({', '.join(family)})" if family else ", root"
        steps.append(f"""
n_{level} AS (SELECT {keys}, sum(tokens)::DOUBLE * {mix.epochs} AS capacity, {weight(plain).replace(plain + " =", level + " =")} AS weight
  FROM used GROUP BY {keys}),
a_{level} AS (SELECT n_{level}.*, budget AS total,
  capacity <= weight * (budget - coalesce(sum(capacity) OVER b, 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER b, 0)) AS full_
  FROM n_{level} {up}
  WINDOW b AS ({part} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g_{level} AS (SELECT {keys}, CASE WHEN full_ THEN capacity ELSE
  greatest(0, total - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER ({part})) * weight
    / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({part}) END AS budget FROM a_{level})""")
        family.append(level)
    keys = ", ".join(family)
    used = " AND ".join(f"({weight(x.rstrip('0')).replace(x.rstrip('0') + ' =', x + ' =')}) > 0" for x in family)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce({domain}, '') AS domain, coalesce(lang, '') AS lang0,
    coalesce(source, '') AS source0, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM documents),
leaf AS (SELECT {keys}, sum(n_tokens) AS tokens FROM d GROUP BY {keys} HAVING sum(n_tokens) > 0),
root AS (SELECT sum(tokens)::DOUBLE * {mix.share} AS budget FROM leaf),
used AS (SELECT * FROM leaf WHERE {used}),{",".join(steps)},
p AS (SELECT *, floor(budget / tokens)::BIGINT AS whole FROM leaf JOIN g_source0 USING ({keys})),
k AS (SELECT d.*, whole, budget - whole * tokens AS rest, md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM d JOIN p USING ({keys})),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - sum(n_tokens) OVER (PARTITION BY {keys}, key) AS begun FROM k)
SELECT doc_id, lang, source, domain, n_tokens, unnest(range(0, whole + (begun < rest)::BIGINT)) AS epoch FROM o
"""
