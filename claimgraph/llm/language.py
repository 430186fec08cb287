"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a
word is the sum over all its segmentations (forward algorithm), never the best one alone; the
probabilities are learned by expectation maximisation with the same sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import chunks, mix, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: At most about so many documents of each language are learned from (a bound of the classifier's fit).
SAMPLE_DOCUMENTS = 1500
ROUNDS = 3
MAX_PIECE = 8  # code points
SMOOTHING = 0.02
CACHED_WORDS = 150_000
UNDETERMINED = "und"
#: A document whose best language has a lower posterior is rejected by :func:`identified`.
LEAST_SCORE = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece file in lower case, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {
        model.id_to_piece(i).lower()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    }
    return sorted(p for p in pieces if 0 < len(p) <= MAX_PIECE)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of short texts, one row each, padded with 0."""
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row, so that a slice's hash is a subtraction."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _STEP + codes[:, j].astype(np.uint64) + np.uint64(1)
    return out


@dataclass
class Model:
    """Piece probabilities by language; the last row stands for a character outside the vocabulary."""

    languages: list[str]
    hashes: np.ndarray  # sorted piece hashes
    order: np.ndarray  # piece number of each
    known: np.ndarray  # filter over the top bits of a hash
    chance: np.ndarray  # (pieces + 1) x languages
    prior: np.ndarray  # log
    cache: dict = field(default_factory=dict)  # word scores seen by a worker; never sent

    def lookup(self, slices: np.ndarray) -> np.ndarray:
        """Piece numbers of slice hashes, -1 where there is no such piece."""
        out = np.full(len(slices), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.known[(slices >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.hashes, slices[maybe])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == slices[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out


def blank_model(pieces: list[str], languages: list[str], prior: np.ndarray) -> Model:
    """All pieces equally likely in all languages."""
    width = max((len(p) for p in pieces), default=1)
    rolled = _rolling(_codes(pieces, width))
    hashes = mix(rolled[np.arange(len(pieces)), [len(p) for p in pieces]])
    order = np.argsort(hashes)
    known = np.zeros(1 << _FILTER_BITS, dtype=bool)
    known[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    n = len(pieces) + 1
    return Model(languages, hashes[order], order, known, np.full((n, len(languages)), 1 / n), prior)


def _pieces_at(model: Model, rolled: np.ndarray, j: int) -> list[tuple[int, np.ndarray]]:
    """``(length, piece numbers)`` of the slices that end at ``j``; single characters always have one."""
    found = []
    for size in range(1, min(MAX_PIECE, j) + 1):
        power = np.uint64(pow(int(_STEP), size, 1 << 64))
        ids = model.lookup(mix(rolled[:, j] - rolled[:, j - size] * power))
        if size == 1:
            ids[ids < 0] = len(model.chance) - 1
        elif not (ids >= 0).any():
            continue
        found.append((size, ids))
    return found


def _forward(model: Model, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log likelihood of each row under each language, summed over all segmentations."""
    n, width = codes.shape
    rolled = _rolling(codes)
    state = np.zeros((width + 1, n, model.chance.shape[1]))
    state[0] = 1
    logs, out = np.zeros((n, model.chance.shape[1])), np.zeros((n, model.chance.shape[1]))
    for j in range(1, width + 1):
        for size, ids in _pieces_at(model, rolled, j):
            rows = np.flatnonzero(ids >= 0)
            state[j, rows] += state[j - size, rows] * model.chance[ids[rows]]
        ended = lengths == j
        out[ended] = np.log(state[j, ended]) + logs[ended]
        if j % MAX_PIECE == 0:  # keep the numbers in range
            top = state[j]
            logs += np.log(top)
            state[max(0, j - MAX_PIECE) : j + 1] /= top
    return out


def _grouped(words: list[str]):
    """Rows of words of similar length, so that padding stays small."""
    lengths = np.array([len(w) for w in words])
    bucket = (lengths + 7) // 8 * 8
    for width in np.unique(bucket):
        rows = np.flatnonzero(bucket == width)
        for at in range(0, len(rows), max(1, 400_000 // int(width))):
            part = rows[at : at + max(1, 400_000 // int(width))]
            yield part, _codes([words[i] for i in part], int(width)), lengths[part]


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log likelihood by language of the letter runs of raw words; 0 for a word without letters."""
    runs, owner = [], []
    for i, word in enumerate(words):
        for run in _LETTERS.findall(word.lower()):
            runs.append("▁" + run)
            owner.append(i)
    out = np.zeros((len(words), len(model.languages)))
    owner = np.array(owner, dtype=np.int64)
    for rows, codes, lengths in _grouped(runs):
        np.add.at(out, owner[rows], _forward(model, codes, lengths))
    return out


def expected_counts(model: Model, words: list[str], weights: np.ndarray, language: int) -> np.ndarray:
    """Expected uses of every piece, over all segmentations of letter runs of one language."""
    chance = model.chance[:, language]
    total = np.zeros(len(chance))
    marked = ["▁" + w for w in words]
    for rows, codes, lengths in _grouped(marked):
        n, width = codes.shape
        rolled = _rolling(codes)
        ahead = np.zeros((width + 1, n))
        ahead[0] = 1
        scale = np.ones((width + 1, n))
        found = {}
        for j in range(1, width + 1):
            found[j] = _pieces_at(model, rolled, j)
            live = lengths >= j
            for size, ids in found[j]:
                r = np.flatnonzero((ids >= 0) & live)
                product = ahead[j - size, r] * chance[ids[r]]
                for k in range(j - size + 1, j):
                    product /= scale[k, r]
                ahead[j, r] += product
            scale[j, live] = ahead[j, live]
            ahead[j, live] = 1
        back = np.zeros((width + 1, n))
        back[lengths, np.arange(n)] = 1
        for j in range(width, 0, -1):
            live = lengths >= j
            for size, ids in found[j]:
                r = np.flatnonzero((ids >= 0) & live & (back[j] > 0))
                product = back[j, r] * chance[ids[r]]
                for k in range(j - size + 1, j + 1):
                    product /= scale[k, r]
                back[j - size, r] += product
                total += np.bincount(ids[r], product * weights[rows][r], minlength=len(total))
    return total


def _letter_counts(stream):
    """Counts of lower-case letter runs by language."""
    from collections import Counter

    for batch in stream:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.update((lang, run) for run in _LETTERS.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )


def train(labelled: DataFrame, path: str = VOCABULARY, per_language: int = SAMPLE_DOCUMENTS) -> Model:
    """Learn from ``doc_id, text, lang``; rows without a language or a letter teach nothing.

    About ``per_language`` documents of each language are drawn by a hash of their id. Every round is a
    Spark job over their word counts; the driver holds the table of piece by language.
    """
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    prior = np.log(np.array([sizes[c] for c in languages], dtype=float) / max(1, sum(sizes.values())))
    model = blank_model(vocabulary(path), languages, prior)
    if not languages:
        return model
    share = F.create_map(*(
        F.lit(x) for c in languages for x in (c, min(1.0, per_language / sizes[c]))
    ))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    counts = Scratch(spark, "language").write(
        rows.where(drawn).mapInArrow(_letter_counts, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition("word"),
        "language-words",
    )
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def expect(stream, shared=shared):
            now = shared.value
            total = np.zeros(now.chance.shape)
            for batch in stream:
                langs = np.array(batch["lang"].to_pylist())
                words = np.array(batch["word"].to_pylist(), dtype=object)
                n = batch["n"].to_numpy()
                for i, lang in enumerate(now.languages):
                    own = np.flatnonzero(langs == lang)
                    total[:, i] += expected_counts(now, list(words[own]), n[own].astype(float), i)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(language), pa.array(total[piece, language])],
                ["piece", "language", "uses"],
            )

        uses = (
            counts.mapInArrow(expect, "piece long, language long, uses double")
            .groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        )
        total = np.full(model.chance.shape, SMOOTHING)
        total[uses["piece"], uses["language"]] += uses["uses"]
        model.chance = total / total.sum(0)
    return model


def _predict(shared):
    def batches(stream):
        model = shared.value
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                langs, scores = predict_texts(model, rows["text"], model.cache)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["held_out"], pa.array(langs, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return batches


def predict_texts(model: Model, column: pa.Array, cache: dict) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text. ``cache`` keeps word scores between calls."""
    w = words_of(column)
    n = len(w.first) - 1
    distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    if len(cache) > CACHED_WORDS:
        cache.clear()
    keys = distinct.tolist()
    new = [i for i, key in enumerate(keys) if key not in cache]
    raw = w.data.tobytes()
    words = [raw[w.start[at[i]] : w.end[at[i]]].decode("utf-8", "replace") for i in new]
    for i, score in zip(new, word_scores(model, words), strict=True):
        cache[keys[i]] = score
    table = np.array([cache[k] for k in keys]).reshape(len(keys), len(model.languages))
    sums = np.zeros((n, len(model.languages)))
    spoken = np.zeros(n, dtype=bool)
    full = np.diff(w.first) > 0
    if full.any() and model.languages:
        starts = w.first[:-1][full]
        sums[full] = np.add.reduceat(table[back], starts, axis=0)
        spoken[full] = np.logical_or.reduceat((table < 0).any(1)[back], starts)
    sums += model.prior
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    best = sums.argmax(1)
    share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
    langs = [model.languages[i] if s else UNDETERMINED for i, s in zip(best, spoken, strict=True)]
    return langs, np.where(spoken, share, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text``).

    ``score`` is the posterior of the predicted language. A text that is null, empty or has no letter
    gives ``und`` and 0, and so does every text if nothing was learned. Repeated rows get equal results;
    other columns of ``docs`` are ignored. ``held_out`` is false for a row without an id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def held_out():
    """Whether a row is kept from learning: its id's checksum leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learned_from(docs: DataFrame) -> DataFrame:
    """The rows that may teach: with an id, and not held out."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose language is determined with at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                _, scores = predict_texts(shared.value, rows["text"], shared.value.cache)
                yield rows.filter(pa.array(scores >= least))

    return docs.mapInArrow(keep, docs.schema)
