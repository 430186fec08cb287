"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document is a vector of counts over hashed features. Its weight is the mean gain of its features, and the sum
behind that mean is taken on bit planes: plane ``i`` of a document holds bit ``i`` of all its bucket counts, the
gains are cut into signed bit planes likewise, and each pair of planes adds ``2**(i + j)`` for every bit they
share. AND, popcount and powers of two give the exact integer, with no product of counts and gains.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import chunks, words_of

BUCKETS = 10000
SHORT = 64  # bytes; the checksum of a longer word is taken on its own
ROWS = 256  # documents whose planes are held at once
LANES = -(-BUCKETS // 64)


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with ``least_words`` or more are drawn; ``seed`` names the noise."""

    percent: int = 25
    least_words: int = 20
    seed: int = 7


def _byte_table() -> np.ndarray:
    """CRC-32 of one more byte, for every low byte of the state."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> 1) ^ ((state & 1) * np.uint32(0xEDB88320))
    return state


def _shift_tables(table: np.ndarray) -> np.ndarray:
    """``[n, k, byte]``: what byte ``k`` of a state becomes when ``n`` zero bytes follow it."""
    out = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(SHORT):
        out[n + 1] = table[out[n] & 255] ^ (out[n] >> 8)
    return out


_TABLE = _byte_table()
_SHIFT = _shift_tables(_TABLE)


def word_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, a byte of all the ranges at a time."""
    size = end - start
    state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    by_size = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    begin, length = start[by_size], np.minimum(size, SHORT + 1)[by_size]
    left = state[by_size]
    for k in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -k, side="left"))  # ranges longer than k
        left[:n] = _TABLE[(left[:n] ^ data[begin[:n] + k]) & 255] ^ (left[:n] >> 8)
    state[by_size] = left ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return state


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of one or two words, and the number of words of every row."""
    w = words_of(column, lower=True, hashed=False, terms=True)
    one = word_checksums(w.data, w.start, w.end)
    n_words = np.diff(w.first)
    pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    head, tail = one[pair], one[pair + 1]
    # The checksum of a joined text is that of its head, moved on by the tail's length, and the tail's.
    head = ~head
    head = ~(_TABLE[(head ^ np.uint32(32)) & 255] ^ (head >> 8))
    size = (w.end - w.start)[pair + 1]
    short = np.minimum(size, SHORT)
    two = tail.copy()
    for k in range(4):
        two ^= _SHIFT[short, k, (head >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(size > SHORT):
        p = pair[i]
        two[i] = zlib.crc32(w.data[w.start[p + 1] : w.end[p + 1]].tobytes(), int(head[i]))
    rows = np.concatenate([w.doc, w.doc[pair]])
    return rows, np.concatenate([one, two]) % np.uint32(BUCKETS), n_words


def _counted(stream):
    """Features of each bucket in all the texts of a task."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in stream:
        for a, b in chunks(batch["text"]):
            total += np.bincount(features(batch["text"].slice(a, b - a))[1], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n`` over all texts; at most ``BUCKETS`` rows."""
    return (
        texts.select("text").mapInArrow(_counted, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` of every bucket: how much likelier, in thousandths of a log, the target holds it."""
    held, wanted = bucket_counts(docs), bucket_counts(target)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    both = (
        every.join(held.withColumnRenamed("n", "s"), "bucket", "left")
        .join(wanted.withColumnRenamed("n", "t"), "bucket", "left")
    )
    # A table of BUCKETS rows: the totals stand beside each of them.
    all_rows = Window.partitionBy()
    all_s, all_t = F.sum(s).over(all_rows), F.sum(t).over(all_rows)
    odds = ((t + 1).cast("double") * (all_s + BUCKETS).cast("double")) / (
        (s + 1).cast("double") * (all_t + BUCKETS).cast("double")
    )
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(odds)).cast("long").alias("gain"))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Planes of non-negative integers: ``(bits, rows, LANES)`` words for ``(rows, BUCKETS)`` values."""
    bits = int(values.max(initial=0)).bit_length()
    out = np.zeros((bits, len(values), LANES * 8), dtype=np.uint8)
    for i in range(bits):
        plane = np.packbits((values >> i) & 1 == 1, axis=1, bitorder="little")
        out[i, :, : plane.shape[1]] = plane
    return out.view(np.uint64)


def plane_sums(counts: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """The sum of count times gain of each row, from planes of the counts and of the two signs of the gains."""
    total = np.zeros(counts.shape[1], dtype=np.int64)
    for i, plane in enumerate(counts):
        for sign, side in ((1, positive), (-1, negative)):
            for j, gain in enumerate(side):
                shared = np.bitwise_count(plane & gain[0]).sum(axis=1, dtype=np.int64)
                total += sign * (shared << (i + j))
    return total


def _weighed(gain: np.ndarray):
    positive = bit_planes(np.maximum(gain, 0)[None, :])
    negative = bit_planes(np.maximum(-gain, 0)[None, :])

    def batches(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                row, bucket, n_words = features(batch["text"].slice(a, b - a))
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order].astype(np.int64)
                sums, sizes = np.zeros(b - a, np.int64), np.bincount(row, minlength=b - a)
                for low in range(0, b - a, ROWS):
                    high = min(low + ROWS, b - a)
                    i, j = np.searchsorted(row, [low, high])
                    counts = np.bincount(
                        (row[i:j] - low) * BUCKETS + bucket[i:j], minlength=(high - low) * BUCKETS
                    ).reshape(high - low, BUCKETS)
                    sums[low:high] = plane_sums(bit_planes(counts), positive, negative)
                weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return batches


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    ``docs`` needs ``doc_id`` and ``text``, ``target`` needs ``text``; further columns are ignored. Null, empty and
    wordless texts have no features and weight 0. ``rank`` is 1, 2, 3 ... over the drawn rows by falling score and
    rising id, null for the others. Rows that repeat an id are documents of their own with equal noise, in any order
    where all else is equal. A row without an id has neither score nor rank and does not count among those drawn
    from. Empty tables give no rows; an empty target prefers buckets that are rare.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gain = np.zeros(BUCKETS, dtype=np.int64)
    for r in gains(docs, target).collect():  # BUCKETS rows at any size
        gain[r["bucket"]] = r["gain"]
    weighed = docs.select("doc_id", "text").mapInArrow(
        _weighed(gain), "doc_id long, n_words long, n_features long, weight long"
    )
    digest = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.col("doc_id").cast("string")), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(chance)))
    scored = scratch.write(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= draw.least_words)
    # Scores are whole thousandths of a log, so there are some ten thousand of them at any size: rows before
    # a score are summed over that short table, and only rows of one score are ordered among themselves.
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.col("score").desc())
    before = by_score.select(
        "score",
        (F.sum("n").over(falling) - F.col("n")).alias("before"),
        (F.sum("n").over(Window.partitionBy()) * draw.percent).alias("hundredths"),
    )
    before = before.withColumn("wanted", F.expr("hundredths div 100")).drop("hundredths")
    before = scratch.write(before.where("before < wanted"), "before")
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    drawn = (
        scored.where(able).join(F.broadcast(before), "score")
        .withColumn("rank", F.col("before") + within)
        .withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    )
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    low = scored.where(able).join(F.broadcast(before), "score", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return drawn.select(*columns).unionByName(rest.select(*columns)).unionByName(low.select(*columns))


def _sql_crc(text: str) -> str:
    """CRC-32 of a text's bytes as a fold over them."""
    table = ", ".join(str(int(x)) for x in _TABLE)
    step = f"xor(([{table}])[(xor(s, b) & 255) + 1], s >> 8)"
    return (
        f"xor(list_reduce(list_transform(range(0, octet_length(encode({text}))), "
        f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT), lambda s, b: {step}, 4294967295::BIGINT), 4294967295)"
    )


def oracle() -> str:
    """SQL for the default draw, of every distinct feature's checksum once."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    listed = (
        "SELECT {id}, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f "
        f"FROM (SELECT {{id}}, {words} AS ws FROM {{table}})"
    )
    return f"""
WITH d AS ({listed.format(id="doc_id", table="documents")}),
b AS ({listed.format(id="item_id", table="benchmark")}),
k AS (SELECT f, {_sql_crc("f")} % {BUCKETS} AS k FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT k, count(*) AS s FROM d JOIN k USING (f) GROUP BY 1),
t AS (SELECT k, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
g AS (
  SELECT n.k, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + {BUCKETS})::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS k) n LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
w AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM d JOIN k USING (f) JOIN g ON g.k = k.k GROUP BY 1),
e AS (
  SELECT doc_id, len({words}) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce(floor(gain::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN w USING (doc_id)),
x AS (
  SELECT doc_id, n_words, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)
"""
