"""Quality rules from tokeniser fertility.

The words of a text are split by a fixed public vocabulary with byte fallback. Tokens per word, characters per token,
the shares of byte tokens and of tokens without letter or digit, and the entropy of the tokens are held against bands
measured over all documents of the language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import chunks, mix, per_row, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
#: A band reaches so many times the distance between the quartiles beyond them ...
WIDTH = 4.0
#: ... and at least so far, so that a uniform corpus rejects no near neighbours. A text of few tokens is measured less
#: surely: at SHORT tokens the reach is doubled.
LEAST_REACH = {"tokens_per_word": 1.0, "chars_per_token": 0.5, "byte_share": 0.1, "mark_share": 0.1, "evenness": 0.15}
SHORT = 60
MEASURES = tuple(LEAST_REACH)
#: So many languages' bands are sent to every executor; with more the rows are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
_MODELS: dict[str, object] = {}


def _model(path: str, raw: bytes):
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = range(model.get_piece_size())
        bytes_ = np.array([model.is_byte(i) or model.is_unknown(i) for i in pieces])
        texts = [model.id_to_piece(i).strip("\u2581") for i in pieces]
        marks = np.array([bool(t) and not any(c.isalnum() for c in t) for t in texts]) & ~bytes_
        _MODELS[path] = (model, bytes_, marks)
    return _MODELS[path]


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(worded) - len(set(worded))


def repeated_words(w) -> np.ndarray:
    """Per row, the words inside windows of five words that the row holds twice or more."""
    n = len(w.hash)
    out = np.zeros(len(w.first) - 1, dtype=np.int64)
    if n < WINDOW:
        return out
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for step in range(WINDOW):
        rolled = mix(rolled + w.hash[step : n - WINDOW + 1 + step])
    inside = np.flatnonzero(w.doc[: n - WINDOW + 1] == w.doc[WINDOW - 1 :])
    keys = mix(rolled[inside] ^ mix(w.doc[inside].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    at = inside[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    np.add.at(out, w.doc[np.cumsum(cover[:-1]) > 0], 1)
    return out


def measured(column: pa.Array, path: str, raw_model: bytes) -> dict[str, np.ndarray]:
    """The counts and measures of each text; measures of a text without words are 0."""
    model, is_byte, is_mark = _model(path, raw_model)
    w = words_of(column)
    rows = len(w.first) - 1
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    word_chars = per_row((points[w.end] - points[w.start]).astype(np.int64), w.first, np.add, 0)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    marks = np.concatenate([[0], np.cumsum(symbol[w.data])])
    texts = column.to_pylist()
    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    ids = model.encode([raw[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in at], num_threads=1)
    size = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.array([i for x in ids for i in x], dtype=np.int64)
    start = np.cumsum(size) - size
    count = size[back]
    n_tokens = per_row(count, w.first, np.add, 0)
    # The tokens of all words in text order, then counted per text.
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    tokens = flat[np.repeat(start[back], count) + within]
    row = np.repeat(w.doc, count)
    n_bytes = np.bincount(row[is_byte[tokens]], minlength=rows)
    n_marks = np.bincount(row[is_mark[tokens]], minlength=rows)
    keys = np.sort(row * len(is_byte) + tokens)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(keys)))
    bits = np.bincount(keys[new] // len(is_byte), times * np.log2(times), minlength=rows) if len(keys) else np.zeros(rows)
    n = np.maximum(n_tokens, 1)
    entropy = np.maximum(0, np.log2(n) - bits / n)
    return {
        "n_words": np.diff(w.first), "word_chars": word_chars,
        "n_symbols": marks[w.bounds[1:]] - marks[w.bounds[:-1]],
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in texts], dtype=np.int64),
        "n_repeat_words": repeated_words(w), "n_tokens": n_tokens,
        "tokens_per_word": n_tokens / np.maximum(np.diff(w.first), 1),
        "chars_per_token": word_chars / n, "byte_share": n_bytes / n, "mark_share": n_marks / n,
        "entropy": entropy,
        # Of what so many tokens could have: long texts repeat tokens of the vocabulary anyway.
        "evenness": entropy / np.log2(np.clip(n_tokens, 2, 4096)),
    }


_SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, tokens_per_word double, chars_per_token double, byte_share double, mark_share double, "
    "entropy double, evenness double"
)


def quality(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Counts, measures and verdicts of every row of ``docs`` (``doc_id, text, lang``).

    ``base_failed``: under 10 words, or over 20 % of the words in repeated five-word windows. ``kept``: not that, and every
    measure inside its language's band; a null language is one of its own. Bands come from all documents that did not fail.
    A null or empty text has no words and fails. Repeated rows get equal results; other columns are
    ignored; an empty table gives no rows.
    """
    with open(path, "rb") as file:
        raw_model = file.read()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(raw_model)

    def described(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                found = measured(rows["text"], path, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["lang"], *map(pa.array, found.values())], ["doc_id", "lang", *found]
                )

    scratch = Scratch(spark, "quality")
    rows = scratch.write(
        docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
        .select("doc_id", "lang", "text").mapInArrow(described, _SCHEMA)
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")),
        ),
        "measures",
    )
    points = F.array(F.lit(0.25), F.lit(0.75))
    bands = rows.where("NOT base_failed").groupBy("lang").agg(*(
        F.percentile_approx(m, points, F.lit(10_000)).alias(f"__{m}") for m in MEASURES
    ))
    bands = scratch.write(bands, "bands")
    inside = F.lit(True)
    # A text without tokens has failed the base rule; it must only not divide by them.
    unsure = 1 + F.lit(float(SHORT)) / F.greatest(F.col("n_tokens"), F.lit(1))
    for m in MEASURES:
        low, high = F.col(f"__{m}")[0], F.col(f"__{m}")[1]
        reach = F.greatest(F.lit(LEAST_REACH[m]), WIDTH * (high - low)) * unsure
        inside = inside & F.col(m).between(low - reach, high + reach)
    few = bands.count() <= BROADCAST_LANGUAGES
    return (
        rows.join(F.broadcast(bands) if few else bands, "lang", "left")
        .withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))
        .drop("lang", *(f"__{m}" for m in MEASURES))
    )
