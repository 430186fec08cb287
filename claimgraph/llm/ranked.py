"""Ranked lexical search for a whole set of queries that share their common parts.

Queries of a set have terms in common, so their scores have sums in common. The shared term sets are mined
among the queries (the pair of terms or sets that most queries still hold is joined, again and again), which gives
a graph of partial sums. For a stretch of documents each partial sum is worked out once, and a query's scores
are the sum of the few partial sums it is made of.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import chunks, words_of

#: Scale of a term's weight and of its share in a document; the length mixes half the mean and half the own.
WEIGHT = 1000
SHARE = 1_000_000_000
LENGTH = 50
TOP = 50
#: Terms of a block of queries, with repeats between queries; more queries take more blocks.
BLOCK_TERMS = 50_000
DOCUMENTS = 256  # whose partial sums are held at once
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Sharing:
    """A graph of sums: ``joins`` makes node ``first + i`` from two earlier nodes; a query sums its ``parts``.

    Nodes below ``first`` are single terms.
    """

    first: int
    joins: list[tuple[int, int]]
    parts: dict[int, list[int]]


def share(queries: dict[int, set[int]], n_terms: int) -> Sharing:
    """The sharing graph of queries given as sets of term numbers."""
    parts = {q: set(terms) for q, terms in queries.items()}
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for q, own in parts.items():
        for pair in combinations(sorted(own), 2):
            holders[pair].add(q)
    by_count: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for pair, qs in holders.items():
        if len(qs) > 1:
            by_count[len(qs)].add(pair)

    def moved(pair, q, more: bool):
        n = len(holders[pair])
        by_count[n].discard(pair)
        (holders[pair].add if more else holders[pair].discard)(q)
        if len(holders[pair]) > 1:
            by_count[len(holders[pair])].add(pair)

    joins: list[tuple[int, int]] = []
    top = max(by_count, default=1)
    while top > 1:
        if not by_count[top]:
            top -= 1
            continue
        a, b = min(by_count[top])
        node = n_terms + len(joins)
        joins.append((a, b))
        for q in sorted(holders[a, b]):
            own = parts[q]
            for old in (a, b):
                own.discard(old)
                for other in own:
                    moved((min(old, other), max(old, other)), q, False)
            moved((a, b), q, False)
            for other in own:
                moved((other, node), q, True)
            own.add(node)
    return Sharing(n_terms, joins, {q: sorted(own) for q, own in parts.items()})


def terms_of(text) -> F.Column:
    """All terms of a text column, A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({_TERM})"), F.lit(1))


def _lookup(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms in order, and which term each is."""
    w = words_of(pa.array(terms, pa.string()), terms=True)
    order = np.argsort(w.hash)
    return w.hash[order], order


def _found(column: pa.Array, hashes: np.ndarray, order: np.ndarray):
    """Number of terms of every row; row, term number and count of the terms that queries have."""
    w = words_of(column, lower=True, terms=True)
    at = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
    hit = hashes[at] == w.hash if len(hashes) else np.zeros(len(w.hash), bool)
    width = max(1, len(hashes))
    key, tf = np.unique(w.doc[hit] * width + order[at[hit]], return_counts=True)
    return np.diff(w.first), key // width, key % width, tf


def _counted(lookup):
    """``term`` and in how many documents; term -1 counts the documents with terms, -2 all their terms."""

    def batches(stream):
        df = np.zeros(len(lookup[0]), dtype=np.int64)
        filled = total = 0
        for batch in stream:
            for a, b in chunks(batch["text"]):
                n, _, term, _ = _found(batch["text"].slice(a, b - a), *lookup)
                df += np.bincount(term, minlength=len(df))
                filled += int((n > 0).sum())
                total += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [filled, total]))], ["term", "n"]
        )

    return batches


def _best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest positive scores, equal ones by rising id."""
    some = np.flatnonzero(score > 0)
    if len(some) > top:
        least = np.partition(score[some], len(some) - top)[len(some) - top]
        some = some[score[some] >= least]
    return some[np.lexsort((ids[some], -score[some]))][:top]


def _ranked(lookup, weight: np.ndarray, graph: Sharing, mean: tuple[int, int], top: int):
    """The best documents of a task for every query."""
    queries = sorted(graph.parts)
    joined = np.array(graph.joins, dtype=np.int64).reshape(-1, 2)
    n_docs, n_terms_all = mean

    def batches(stream):
        kept = {q: (np.empty(0, np.int64), np.empty(0, np.int64)) for q in queries}
        for batch in stream:
            whole = batch.filter(batch["doc_id"].is_valid())
            for a, b in chunks(whole["text"]):
                n, row, term, tf = _found(whole["text"].slice(a, b - a), *lookup)
                ids = whole["doc_id"].slice(a, b - a).to_numpy()
                m = 100 - LENGTH + (LENGTH * n.astype(np.int64) * n_docs) // max(1, n_terms_all)
                share_of = (SHARE * tf) // (1000 * tf + 20 * m[row])
                gain = weight[term] * share_of
                for low in range(0, b - a, DOCUMENTS):
                    high = min(low + DOCUMENTS, b - a)
                    i, j = np.searchsorted(row, [low, high])
                    sums = np.zeros((graph.first + len(joined), high - low), dtype=np.int64)
                    sums[term[i:j], row[i:j] - low] = gain[i:j]
                    for node, (x, y) in enumerate(joined, graph.first):
                        np.add(sums[x], sums[y], out=sums[node])
                    for q in queries:
                        score = sums[graph.parts[q]].sum(axis=0)
                        old = kept[q]
                        if len(old[0]) == top and score.max() < old[1][-1]:
                            continue
                        both = np.append(old[0], ids[low:high]), np.append(old[1], score)
                        best = _best(both[1], both[0], top)
                        kept[q] = both[0][best], both[1][best]
        for q, (ids, score) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(score)], ["item_id", "doc_id", "score"]
            )

    return batches


def _blocks(items: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Queries with their distinct terms, dealt into blocks of bounded size."""
    terms = (
        items.select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
        .where("item_id IS NOT NULL AND size(terms) > 0")
    )
    # An item's rows are one query, so an id is in one block only.
    terms = terms.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    listed = scratch.write(terms, "queries")
    total = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_TERMS // 2)))
    return listed.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), blocks


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 of every item.

    ``docs`` needs ``doc_id`` (integer) and ``text``, ``items`` ``item_id`` and ``text``; further columns are ignored.
    Null, empty and termless texts match nothing; a document without an id counts in the statistics but is not
    listed, an item without an id is left out. Items of one id are one query with all their terms; documents that
    repeat an id are ranked as rows of their own. Equal scores go by rising id. Empty tables give no rows.

    Statistics are of all documents and all terms of the items. A query set too large for one block takes one
    pass over the documents for each block.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    listed, blocks = _blocks(items, scratch)
    texts = docs.select("doc_id", "text")
    found = None
    for block in range(blocks):
        rows = listed.where(F.col("block") == block).select("item_id", "terms").collect()  # some BLOCK_TERMS terms
        names = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(names)}
        queries = {r["item_id"]: {number[t] for t in r["terms"]} for r in rows}
        lookup = _lookup(names)
        counted = texts.mapInArrow(_counted(lookup), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        totals = {r["term"]: r["n"] for r in counted.collect()}  # a row per term of the block
        n_docs, n_terms = totals.get(-1, 0), totals.get(-2, 0)
        df = np.array([totals.get(i, 0) for i in range(len(names))], dtype=np.float64)
        weight = np.floor(WEIGHT * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        part = texts.mapInArrow(
            _ranked(lookup, weight, share(queries, len(names)), (n_docs, n_terms), top),
            "item_id long, doc_id long, score long",
        )
        found = part if found is None else found.unionByName(part)
    # Every task kept its best; a share of the tasks' rows is ranked before they meet by item.
    order = (F.col("score").desc(), F.col("doc_id"))
    some = Window.partitionBy("item_id", F.pmod("doc_id", F.lit(32))).orderBy(*order)
    every = Window.partitionBy("item_id").orderBy(*order)
    return (
        found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
p AS (
  SELECT doc_id, t, len(any_value(ts)) AS n, count(*) AS tf
  FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY 1, 2),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (
  SELECT t, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, c WHERE t IN (SELECT t FROM q) GROUP BY 1),
s AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY 1, 2),
r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
