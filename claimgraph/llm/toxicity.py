"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms, hashed into a fixed number of buckets. The machine adds to the linear weights the
products of learned vectors of every pair of terms, so an insult beside the mention of a group weighs more than
both alone. The pair sum costs one pass: half of the squared sum of vectors less the sum of squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.language import held_out
from claimgraph.llm.words import chunks, words_of

BITS = 18
FACTORS = 4
#: About so many labelled documents of each class are learned from (a bound of the classifier's fit).
SAMPLE = {1: 4000, 0: 8000}
LEAST_DOCUMENTS = 3  # of the sample that a term must occur in
SCREEN_ROUNDS = 150
PENALTY = 0.7
NEWTON_STEPS = 12
#: A pair is learned if both terms together occur in so many sampled documents, and their surplus of toxic ones is so
#: many standard deviations and so many times that of either term alone.
PAIR_DOCUMENTS = 10
PAIR_DEVIATIONS = 6.0
PAIR_OVER_TERMS = 1.5
#: Pairs are sought among so many terms at most, those of most toxic documents of the sample.
PAIR_TERMS = 2000
EPOCHS = 250
RATE = 0.05
L2 = 0.3
TOXIC = 0.7


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # by bucket
    vectors: np.ndarray  # buckets x factors
    known: np.ndarray  # buckets that were learned

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each row; ``terms`` are distinct buckets, ``first`` the rows' offsets."""
        n = len(first) - 1
        out = np.full(n, self.bias)
        full = np.diff(first) > 0
        if full.any():
            at = first[:-1][full]
            v = self.vectors[terms]
            sums = np.add.reduceat(v, at, axis=0)
            squares = np.add.reduceat((v * v).sum(1), at)
            out[full] += np.add.reduceat(self.weights[terms], at) + 0.5 * ((sums * sums).sum(1) - squares)
        return out


def term_sets(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term buckets of each text (those in ``known``), and the rows' offsets."""
    w = words_of(column, lower=True, terms=True)
    bucket = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    row = w.doc
    if known is not None:
        seen = known[bucket]
        bucket, row = bucket[seen], row[seen]
    keys = np.unique((row << BITS) | bucket)
    first = np.searchsorted(keys, np.arange(len(w.first)) << BITS)
    return keys & ((1 << BITS) - 1), first


def _odds_error(raw: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels


def lasso(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, size: int, penalty: float) -> np.ndarray:
    """Weights of an L1-penalised logistic regression (accelerated proximal gradient)."""
    row = np.repeat(np.arange(len(labels)), np.diff(first))
    w = ahead = np.zeros(size + 1)  # the last is the bias
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w[-1] = np.log(share / (1 - share))
    scale = 4.0 / max(1, np.diff(first).max(initial=1)) / max(1.0, np.sqrt(len(labels)))
    momentum = 1.0
    for _ in range(SCREEN_ROUNDS):
        raw = np.bincount(row, ahead[terms], minlength=len(labels)) + ahead[-1]
        error = _odds_error(raw, labels)
        slope = np.append(np.bincount(terms, error[row], minlength=size), error.sum())
        new = ahead - scale * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - scale * penalty)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w[:-1]


def refitted(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Chance of each row under a logistic regression without the L1 penalty (Newton, a ridge of 1); for few terms."""
    w, ridge = np.zeros(size + 1), np.append(np.ones(size), 1e-6)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w[-1] = np.log(share / (1 - share))
    row = np.repeat(np.arange(len(labels)), np.diff(first))
    for step in range(NEWTON_STEPS + 1):
        raw = np.bincount(row, w[terms], minlength=len(labels)) + w[-1]
        chance = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        if step == NEWTON_STEPS:
            return chance
        slope, curve = ridge * w, np.diag(ridge)
        for low in range(0, len(labels), 1000):  # so many rows are dense at once
            high = min(low + 1000, len(labels))
            x = np.zeros((high - low, size + 1))
            x[:, -1] = 1
            i, j = first[low], first[high]
            x[row[i:j] - low, terms[i:j]] = 1
            p = chance[low:high]
            slope += x.T @ (p - labels[low:high])
            curve += x.T @ (x * (p * (1 - p))[:, None])
        w -= np.linalg.solve(curve, slope)


def screen(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, size: int) -> np.ndarray:
    """Terms that tell the classes apart alone, or as one of a pair.

    Alone: those with a weight under a penalty, the root of the number of toxic documents, that chance differences
    between classes reach. In a pair: those whose joint occurrence is toxic more often than the single terms explain.
    """
    alone = lasso(terms, first, labels, size, max(1.0, PENALTY * np.sqrt(labels.sum()))) != 0
    number = np.cumsum(alone) - 1
    kept = alone[terms]
    # The chosen terms without the penalty, which would leave some of their own effect to the pairs.
    chance = refitted(number[terms[kept]], np.concatenate([[0], np.cumsum(kept)])[first], labels, int(alone.sum()))
    return alone | paired(terms, first, labels, chance, size)


def paired(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, chance: np.ndarray, size: int) -> np.ndarray:
    """Terms of pairs whose documents are toxic far beyond their ``chance``, and farther than those of either term."""
    out = np.zeros(size, dtype=bool)
    row = np.repeat(np.arange(len(labels)), np.diff(first))
    often = np.bincount(terms, minlength=size) >= PAIR_DOCUMENTS
    toxic = np.where(often, np.bincount(terms, labels[row], minlength=size), 0)
    names = np.argsort(-toxic, kind="stable")[:PAIR_TERMS]
    names = names[toxic[names] > 0]
    number = np.full(size, -1)
    number[names] = np.arange(len(names))
    kept = number[terms] >= 0
    own, row, first = number[terms[kept]], row[kept], np.concatenate([[0], np.cumsum(kept)])[first]
    sums = np.zeros((3, len(names), len(names)), dtype=np.float32)  # surplus, variance and documents of every pair
    for low in range(0, len(labels), 1000):  # so many rows are dense at once
        high = min(low + 1000, len(labels))
        x = np.zeros((high - low, len(names)), dtype=np.float32)
        x[row[first[low] : first[high]] - low, own[first[low] : first[high]]] = 1
        p = chance[low:high]
        for k, value in enumerate((labels[low:high] - p, p * (1 - p), np.ones(high - low))):
            sums[k] += x.T @ (x * value[:, None].astype(np.float32))
    z = sums[0] / np.sqrt(sums[1] + 1e-9)
    single = np.abs(np.diag(z))
    floor = np.maximum(PAIR_DEVIATIONS, PAIR_OVER_TERMS * np.maximum(single[:, None], single[None, :]))
    found = (z >= floor) & (sums[2] >= PAIR_DOCUMENTS)
    np.fill_diagonal(found, False)
    out[names[found.any(axis=0)]] = True
    return out


def fit(sets: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss with L2 terms over the screened terms. Without both classes the score is constant."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(
        float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)), np.zeros(size, dtype=bool)
    )
    if len(set(labels.tolist())) < 2:
        return machine
    terms, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    often = np.bincount(terms, minlength=size) >= LEAST_DOCUMENTS
    names = np.flatnonzero(often)
    number = np.full(size, -1)
    number[names] = np.arange(len(names))

    def only(keep: np.ndarray, terms: np.ndarray, first: np.ndarray):
        kept = keep[terms]
        return terms[kept], np.concatenate([[0], np.cumsum(kept)])[first]

    terms, first = only(often, terms, first)
    chosen = screen(number[terms], first, labels, len(names))
    machine.known[names[chosen]] = True
    terms, first = only(machine.known, terms, first)
    used = np.flatnonzero(machine.known)
    machine.vectors[used] = rng.normal(0, 0.05, (len(used), FACTORS))
    number[used] = np.arange(len(used))
    own, row = number[terms], np.repeat(np.arange(len(labels)), np.diff(first))
    state = [np.zeros((len(used) + 1, 1 + FACTORS)) for _ in range(2)]
    for turn in range(1, EPOCHS + 1):  # Adam over all rows; few terms are left
        each = _odds_error(machine.raw(terms, first), labels)[row]
        v = machine.vectors[terms]
        sums = np.stack([np.bincount(row, v[:, k], minlength=len(labels)) for k in range(FACTORS)], 1)
        pull = each[:, None] * (sums[row] - v)
        slope = np.zeros_like(state[0])
        slope[:-1, 0] = np.bincount(own, each, minlength=len(used)) + L2 * machine.weights[used]
        for k in range(FACTORS):
            slope[:-1, 1 + k] = np.bincount(own, pull[:, k], minlength=len(used)) + L2 * machine.vectors[used, k]
        slope[-1, 0] = _odds_error(machine.raw(terms, first), labels).sum()
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        step = RATE * (state[0] / (1 - 0.9**turn)) / (np.sqrt(state[1] / (1 - 0.999**turn)) + 1e-8)
        machine.weights[used] -= step[:-1, 0]
        machine.vectors[used] -= step[:-1, 1:]
        machine.bias -= step[-1, 0]
    return machine


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Machine:
    """Learn from labelled documents that are not held out; rows with a null label or id teach nothing.

    Documents are drawn by a hash of their id, about ``sample`` of each class, and only their term sets reach the driver.
    Scores mean the same whatever share of each class is drawn.
    """
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = {label: min(1.0, most / sizes[label]) for label, most in sample.items() if sizes.get(label)}
    share = F.lit(0.0)
    for label, rate in rates.items():
        share = F.when(F.col("toxic") == label, rate).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < share * (1 << 20))

    def described(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                terms, first = term_sets(rows["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"], rows["toxic"],
                        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(terms, pa.int32())),
                    ],
                    ["doc_id", "toxic", "terms"],
                )

    # The drawn ids are as few as the parameter says, so they go to the documents, not the texts to them.
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
        .select("doc_id", F.col("toxic").cast("int"), "text")
        .mapInArrow(described, "doc_id long, toxic int, terms array<int>")
        .toPandas().sort_values("doc_id", kind="stable")
    )
    machine = fit([np.asarray(t, dtype=np.int64) for t in rows["terms"]], rows["toxic"].to_numpy(dtype=float))
    # The classes are drawn at their own rates; the log odds are brought back to those of all labelled documents.
    machine.bias += float(np.log(rates.get(0, 1.0) / rates.get(1, 1.0)))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    A null or empty text gets the bias alone. Repeated rows get equal scores; other columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                raw = shared.value.raw(*term_sets(rows["text"], shared.value.known))
                value = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["held_out"], pa.array(value), pa.array((value >= TOXIC).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int"
    )
