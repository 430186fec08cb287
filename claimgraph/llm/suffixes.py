"""Removal of repeated passages by ordering suffixes only as far as the threshold.

Suffixes are told apart to a depth of ``DEPTH`` bytes and no further: two suffixes that agree that far start
the same window. As in a most-significant-digit radix sort, each pass deals the suffixes of the open groups
by one more digit, and a group that lies within one document closes; a unique suffix costs one pass.

* First digit: a 28-gram that the window picks by its own bytes (mod-minimizer sampling), wherever in the window it
  stands. Neighbouring suffixes pick the same one, so one row stands for a run of some 15 suffixes, and equal windows
  have equal digits.
* Second digit: all bytes that the run's windows cover. Runs equal in it are one class; all but those of its
  first document are repeated whole, so thousands of copies need no further pass.
* Third digit: the single windows, of one run per class and only where a first digit has several classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import buffers, chunks, range_hashes

DEPTH = 50
GRAM = 28
PICK = 4  # least length of the short grams whose order decides
SEGMENT = 1 << 19  # windows whose digits a worker works out at once; also the room for a place in a key
CROWD = 50_000  # contexts of one gram that meet in one task, of some 30 windows of 40 bytes
_PLACE = np.uint32(SEGMENT * 2 - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def _mixed(data: np.ndarray, size: int) -> np.ndarray:
    """32 bits of every ``size`` bytes in a row, in no telling order."""
    n = len(data) - size + 1
    out = np.zeros(n, dtype=np.uint32)
    for k in range(size):
        out = (out ^ data[k : k + n]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


def runs(data: np.ndarray, bounds: np.ndarray, depth: int):
    """Runs of windows that pick one gram: ``row, start, count, gram, context`` arrays, a segment at a time.

    ``start`` counts from the beginning of the row's text. A window and its gram depend on its bytes alone,
    so equal windows anywhere belong to runs of equal ``gram``. The least short gram of a window stands at some place
    in it; the gram picked is at that place modulo the number of grams, so neighbours seldom pick different ones.
    Segments bound the memory; a run that a segment cuts is two runs.
    """
    grams = depth - GRAM + 1
    short = PICK + (GRAM - PICK) % grams
    if not len(data):
        return
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Starts of windows that end within their text: the last ``depth - 1`` starts of every text do not count.
    inside = np.ones(len(data), dtype=bool)
    for back in range(1, depth):
        ends = bounds[1:] - back
        inside[ends[ends >= bounds[:-1]]] = False
    # What a place of the short gram in the window means for that of the gram.
    turned = np.arange(depth - short + 1, dtype=np.int32) % grams
    for a in range(0, len(data) - depth + 1, SEGMENT):
        part = data[a : a + SEGMENT + depth - 1]
        n = len(part) - depth + 1
        begin = np.arange(n, dtype=np.int32)
        key = (_mixed(part, short) & ~_PLACE) | np.arange(len(part) - short + 1, dtype=np.uint32)
        place = (_least(key, depth - short + 1) & _PLACE).astype(np.int32)
        place = begin + turned[place - begin]
        row, whole = of[a : a + n], inside[a : a + n]
        new = np.ones(n, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & whole)
        if not len(first):
            continue
        # A run ends where the next begins or its text has no whole window left.
        stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True)) + 1
        last = stop[np.searchsorted(stop, first, side="right")]
        at = place[first].astype(np.int64)
        gram, context = range_hashes(part, at, at + GRAM), range_hashes(part, first, last + depth - 1)
        yield row[first], first + a - bounds[row[first]], last - first, gram, context


def _digits(depth: int, whole: bool):
    """First digits with their document; ``whole`` adds the text's number, the place and the second digit."""

    def batches(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                data, bounds = buffers(rows["text"])
                for row, start, count, gram, context in runs(data, bounds, depth):
                    own = rows.select(["doc_id"]).take(pa.array(row))["doc_id"]
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), own], ["gram", "doc_id"])
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), own,
                            rows["part"].take(pa.array(row)), pa.array(start), pa.array(count.astype(np.int32)),
                        ],
                        ["gram", "context", "doc_id", "part", "start", "count"],
                    )

    return batches


def _contexts(depth: int):
    """The bytes of the listed runs of a text."""

    def batches(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                data, bounds = buffers(rows["text"])
                listed = rows["listed"]
                flat = listed.flatten()
                row = np.repeat(np.arange(len(rows)), np.diff(np.asarray(listed.offsets)))
                start = np.asarray(flat.field("start")) + bounds[row]
                size = np.asarray(flat.field("count")).astype(np.int64) + depth - 1
                ends = np.append(0, np.cumsum(size))
                at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
                covered = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[at])]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("gram"), flat.field("context"), rows["doc_id"].take(pa.array(row)),
                        flat.field("count"), flat.field("crowded"), covered,
                    ],
                    ["gram", "context", "doc_id", "count", "crowded", "covered"],
                )

    return batches


def _covered(size: int, start: np.ndarray, count: np.ndarray, mask: np.ndarray, depth: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a listed window."""
    steps = np.zeros(size + 1, dtype=np.int32)
    whole = mask == -1
    np.add.at(steps, start[whole], 1)
    np.add.at(steps, (start + count - 1 + depth)[whole], -1)
    start, count, mask = start[~whole], count[~whole], mask[~whole]
    for k in range(int(count.max(initial=0))):
        some = start[(mask >> np.int64(k)) & 1 == 1] + k
        np.add.at(steps, some, 1)
        np.add.at(steps, some + depth, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(depth: int, keep_text: bool):
    """The bytes that no listed window covers."""

    def batches(stream):
        for batch in stream:
            data, bounds = buffers(batch["text"])
            listed = batch["listed"]
            flat = listed.values
            start, count, mask = (np.asarray(flat.field(c)) for c in ("start", "count", "mask"))
            offsets, known = np.asarray(listed.offsets), listed.is_valid().to_numpy(zero_copy_only=False)
            removed, spans, digests, kept = [], [], [], []
            for r in range(len(batch)):
                own = data[bounds[r] : bounds[r + 1]]
                n_removed = n_spans = 0
                if known[r]:
                    at = slice(offsets[r], offsets[r + 1])
                    gone = _covered(len(own), start[at], count[at], mask[at], depth)
                    n_removed = int(gone.sum())
                    n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    own = own[~gone]
                rest = own.tobytes()
                removed.append(n_removed)
                spans.append(n_spans)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return batches


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, part``: several texts under one id get numbers of their own, equal ones the same."""
    texts = docs.select("doc_id", "text")
    named = texts.where("doc_id IS NOT NULL")
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return texts.withColumn("part", F.lit(0))
    mark = F.concat(F.sha2("text", 256), F.length("text").cast("string"))
    marked = texts.withColumn("mark", F.coalesce(mark, F.lit("")))
    sorted_marks = F.array_sort(F.collect_set("mark"))
    parts = marked.join(again, "doc_id").groupBy("doc_id").agg(sorted_marks.alias("marks")).select(
        "doc_id", F.posexplode("marks").alias("part", "mark")
    )
    return marked.join(parts, ["doc_id", "mark"], "left").select(
        "doc_id", "text", F.coalesce("part", F.lit(0)).alias("part")
    )


def repeated_windows(docs: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """``doc_id, part, start, count, mask``: runs of windows that also start in a document of a smaller id.

    ``docs`` has ``doc_id, text, part``. A mask of -1 means all ``count`` windows from ``start``, else its bits do.
    """
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    first_digit = (
        named.select("doc_id", "text").mapInArrow(_digits(depth, False), "gram long, doc_id long")
        .groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    )
    shared = scratch.write(first_digit.where("low < high").select("gram"), "shared")
    open_runs = scratch.write(
        named.mapInArrow(
            _digits(depth, True), "gram long, context long, doc_id long, part int, start long, count int"
        ).join(shared.hint("shuffle_hash"), "gram"),  # the grams are hashed, so the many rows need no sort
        "open-runs",
    )
    scratch.drop("shared")
    # The first document of each class, and one place where it stands in it. Both follow the same order, so they
    # are of one row.
    place = F.shiftleft("start", 7).bitwiseOR(F.col("count").cast("long"))
    classes = scratch.write(
        open_runs.groupBy("gram", "context").agg(
            F.min("doc_id").alias("head"), F.min_by("part", "doc_id").alias("part"), F.min_by(place, "doc_id").alias("place")
        ),
        "classes",
    )
    several = (
        classes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
        .select("gram", (F.col("n") > CROWD).alias("crowded"))
    )
    # One run for each class that is still open, in its first document.
    run = F.struct(
        "gram", "context", F.shiftright("place", 7).alias("start"),
        F.col("place").bitwiseAND(F.lit(127)).cast("int").alias("count"), "crowded",
    )
    heads = (
        classes.join(several, "gram").groupBy(F.col("head").alias("doc_id"), "part").agg(F.collect_list(run).alias("listed"))
    )
    covered = scratch.write(
        named.join(heads, ["doc_id", "part"]).select("doc_id", "text", "listed")
        .mapInArrow(_contexts(depth), "gram long, context long, doc_id long, count int, crowded boolean, covered binary"),
        "heads",
    )

    def singles(rows: DataFrame) -> DataFrame:
        offset = rows.select("gram", "context", "doc_id", "covered", F.explode(F.expr("sequence(0, count - 1)")).alias("offset"))
        window = F.xxhash64(F.substring("covered", F.col("offset") + 1, F.lit(depth)))
        return offset.select("gram", "context", "doc_id", "offset", window.alias("window"))

    # The few runs of a usual gram meet in one task, where their windows are told apart without another shuffle;
    # those of a gram with a crowd of contexts are dealt by window, summed before they are.
    usual = singles(covered.where("NOT crowded").repartition("gram")).withColumn(
        "least", F.min("doc_id").over(Window.partitionBy("gram", "window"))
    )
    crowd = singles(covered.where("crowded"))
    first = crowd.groupBy("gram", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    crowd = crowd.join(first.where("least < most").drop("most"), ["gram", "window"])
    bits = F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")
    masks = (
        usual.where("least < doc_id").groupBy("gram", "context").agg(bits)
        .unionByName(crowd.where("least < doc_id").groupBy("gram", "context").agg(bits))
    )
    marked = scratch.write(
        classes.select("gram", "context", "head").join(masks, ["gram", "context"], "left"), "marked"
    )
    scratch.drop("classes", "heads")
    found = (
        open_runs.join(marked, ["gram", "context"])
        .select(
            "doc_id", "part", "start", "count",
            F.when(F.col("doc_id") > F.col("head"), F.lit(-1)).otherwise(F.coalesce("mask", F.lit(0))).cast("long").alias("mask"),
        )
        .where("mask <> 0")
    )
    out = scratch.write(found, "repeated")
    scratch.drop("open-runs", "marked")
    return out


def without_repeats(docs: DataFrame, depth: int = DEPTH, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte that lies in a ``depth``-byte string which also starts in a document of a smaller id is removed;
    strings are judged on the input. ``docs`` needs ``doc_id`` (integer) and ``text``; further columns are
    ignored. Texts are UTF-8 bytes, so ``kept`` is binary (null without ``keep_text``). Null and empty texts
    have no bytes, texts shorter than ``depth`` lose none. Rows of one id take nothing from each other. A row
    without an id loses nothing and takes nothing. Repeated rows get equal results, an empty table none.
    ``depth`` is from 28 to 90, so that a run's windows fit the mask.
    """
    if not GRAM <= depth < GRAM + 63:
        raise ValueError("the depth must be from 28 to 90 bytes")
    scratch = Scratch(docs.sparkSession, "suffixes")
    numbered = _numbered(docs)
    gone = repeated_windows(numbered, depth, scratch).groupBy("doc_id", "part").agg(
        F.collect_list(F.struct("start", "count", "mask")).alias("listed")
    )
    return numbered.join(gone, ["doc_id", "part"], "left").select("doc_id", "text", "listed").mapInArrow(
        _cut(depth, keep_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )


#: Windows of 100 hex digits, two for a byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k
  FROM (SELECT doc_id, x, unnest(range(0, greatest(0, len(x) // 2 - 49))) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS m FROM w GROUP BY 1),
r AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (k) WHERE m < doc_id),
g AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM r),
h AS (SELECT doc_id, i, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS e FROM h GROUP BY 1, 2),
t AS (SELECT doc_id, run, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
p AS (
  SELECT doc_id, count(*) AS n, sum(e - a) AS gone, max(e) AS rest,
    string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
  coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""
