"""Benchmark decontamination by the q-gram lemma.

A window of ``w`` characters within ``e`` edits of a text region shares at least ``w + 1 - q - q * e``
of its q-grams with it, and all of them lie in a diagonal band of the dot plot. Shared q-grams are counted in
overlapping bands, bands that reach the bound are verified by banded alignment, and nothing
within the edit budget is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.words import buffers, chunks, lowered, mix

Q = 8  # bytes, so a q-gram is one 64-bit number
WINDOW = 80
EDITS = 5  # for a whole window; shorter items have a share of it
#: Benchmark text indexed at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 1 << 20
_EXPANDED = 2_000_000
_ALIGNED = 20_000


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with runs of ASCII non-alphanumerics as one blank, row bounds, source offsets."""
    low = lowered(data)
    solid = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    first = np.zeros(len(low) + 1, dtype=bool)
    first[bounds] = True
    keep = solid.copy()
    # A blank stays where it ends a run of solid bytes inside its row.
    keep[1:] |= solid[:-1] & ~first[1:-1]
    text = np.where(solid, low, np.uint8(32))[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return text, kept[bounds], np.flatnonzero(keep)


def qgrams(text: np.ndarray) -> np.ndarray:
    """The 8-byte numbers at every position that has 8 bytes after it."""
    if len(text) < Q:
        return np.empty(0, dtype=np.uint64)
    x = text.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


@dataclass
class Index:
    """The items of one benchmark block end to end, a window at every place, and the postings of their q-grams."""

    items: np.ndarray  # their ids
    text: np.ndarray  # all of them, with WINDOW bytes of 1 after the last
    start: np.ndarray  # of each item in the text
    last: np.ndarray  # where the last window of each item starts
    lengths: np.ndarray  # of the windows of each item
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that the lemma asks for
    grams: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # offsets of their postings
    item: np.ndarray
    place: np.ndarray  # in the text
    known: np.ndarray  # filter over hashed q-grams
    shift: int


def build_index(rows: list[tuple[int, str]]) -> Index:
    """A window starts at every byte that has a whole one after it; a shorter item is one. Items under 8 bytes have none."""
    column = pa.array([t for _, t in rows], pa.string())
    text, bounds, _ = normalised(*buffers(column))
    items, parts = [], []
    for (item, _), a, b in zip(rows, bounds[:-1], bounds[1:], strict=True):
        whole = text[a:b].tobytes().strip()
        if len(whole) >= Q:
            items.append(item)
            parts.append(whole)
    n = len(parts)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    start = np.cumsum(sizes) - sizes
    lengths = np.minimum(sizes, WINDOW)
    edits = np.minimum(lengths * EDITS // WINDOW, np.maximum(0, (lengths - Q) // Q))
    flat = np.frombuffer(b"".join(parts) + bytes([1]) * WINDOW, np.uint8)
    item = np.repeat(np.arange(n), sizes - Q + 1)
    place = np.arange(len(item)) + item * (Q - 1)  # an item's last bytes start no q-gram
    grams = qgrams(flat)[place]
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    bits = min(24, max(12, int(64 * max(1, len(distinct))).bit_length()))
    known = np.zeros(1 << bits, dtype=bool)
    known[(mix(distinct) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Index(
        np.array(items, dtype=np.int64), flat, start, start + sizes - lengths, lengths, edits,
        lengths + 1 - Q - Q * edits, distinct, np.append(first, len(grams)), item[order], place[order], known, 64 - bits,
    )


def alignments(
    index: Index, text: np.ndarray, window: np.ndarray, length: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray, width: int
):
    """Least edits of the window of ``length`` at each place against its band, and where in ``text`` the best match ends.

    Row i, lane k of the band pairs the first i bytes of the window with the text up to
    ``base + i + k``; the text outside ``[low, high)`` matches nothing.
    """
    n = len(window)
    lanes = np.arange(width)
    cost = np.zeros((n, width), dtype=np.int32)
    best, ends = np.full(n, 1 << 20, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(1, WINDOW + 1):
        at = base[:, None] + (i - 1) + lanes
        inside = (at >= low[:, None]) & (at < high[:, None])
        seen = np.where(inside, text[np.clip(at, 0, len(text) - 1)], 0)
        step = cost + (seen != index.text[np.minimum(window + i, len(index.text)) - 1][:, None])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - lanes, axis=1) + lanes
        done = length == i
        if done.any():
            lane = cost[done].argmin(1)
            best[done] = cost[done, lane]
            ends[done] = base[done] + i + lane
    return best, ends


def matches(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """``(row, item, start, end, edits, windows)`` of every text that holds a window of an item."""
    data, raw_bounds = buffers(column)
    text, bounds, source = normalised(data, raw_bounds)
    grams = qgrams(text)
    if not len(grams) or not len(index.grams):
        return []
    maybe = np.flatnonzero(index.known[(mix(grams) >> np.uint64(index.shift)).astype(np.int64)])
    row = np.searchsorted(bounds, maybe, side="right") - 1
    maybe = maybe[maybe + Q <= bounds[row + 1]]
    # No window can be met where fewer q-grams than any window needs lie in a stretch of its length.
    reach = WINDOW + int(index.edits.max())
    need = int(max(1, index.least.min()))
    ahead = np.searchsorted(maybe, maybe + reach) - np.arange(len(maybe))
    cover = np.zeros(len(maybe) + 1, dtype=np.int64)
    dense = np.flatnonzero(ahead >= need)
    np.add.at(cover, dense, 1)
    np.add.at(cover, dense + ahead[dense], -1)
    maybe = maybe[np.cumsum(cover[:-1]) > 0]
    at = np.searchsorted(index.grams, grams[maybe])
    at[at == len(index.grams)] = 0
    hit = index.grams[at] == grams[maybe]
    where, at = maybe[hit], at[hit]
    count = index.first[at + 1] - index.first[at]
    row = np.searchsorted(bounds, where, side="right") - 1
    out: dict[tuple[int, int], list[int]] = {}
    edge = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
    grown = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(edge) - 1:  # whole rows, a bounded number of postings at a time
        hi = max(lo + 1, int(np.searchsorted(grown[edge], grown[edge[lo]] + _EXPANDED)) - 1)
        s = slice(edge[lo], edge[min(hi, len(edge) - 1)])
        lo = hi
        _count_bands(index, text, bounds, row[s], where[s], at[s], count[s], out)
    found = []
    for (r, item), (start, end, edits, windows) in sorted(out.items()):
        a, b = source[min(max(start, bounds[r]), len(source) - 1)], source[end - 1] + 1
        lead = data[raw_bounds[r] : b]
        points = np.cumsum((lead & 0xC0) != 0x80)
        begin = a - raw_bounds[r]
        found.append((r, item, int(points[begin]) - 1, int(points[-1]), edits, windows))
    return found


def _count_bands(index, text, bounds, row, where, at, count, out) -> None:
    """Shared q-grams per row, item and diagonal band; windows that reach the bound in one are aligned."""
    reps = np.repeat(np.arange(len(row)), count)
    within = np.arange(len(reps)) - np.repeat(np.cumsum(count) - count, count)
    posting = index.first[at][reps] + within
    item, place, r = index.item[posting], index.place[posting], row[reps]
    diagonal = where[reps] - (place - index.start[item]) + int((index.last + index.lengths - index.start).max())  # never negative
    step = int(index.edits.max()) + 1
    for half in (0, step):  # bands of two steps, each overlapping the next by one
        band = (diagonal + half) // (2 * step)
        order = np.lexsort([place, band, item, r])
        rr, ii, bb, pp = r[order], item[order], band[order], place[order]
        n = len(order)
        same = (rr[1:] == rr[:-1]) & (ii[1:] == ii[:-1]) & (bb[1:] == bb[:-1])
        # A window whose first shared q-gram is this one starts after the one before, and holds enough of those that follow.
        least = np.maximum(1, index.least[ii])
        end = np.arange(n) + least - 1
        group = np.concatenate([[0], np.cumsum(~same)]) if n else np.empty(0, np.int64)
        held = end < n
        end = np.minimum(end, n - 1)
        held &= group[end] == group
        from_ = np.maximum(index.start[ii], pp[end] - (index.lengths[ii] - Q))
        from_[1:] = np.where(same, np.maximum(from_[1:], pp[:-1] + 1), from_[1:])
        windows = np.where(held, np.minimum(pp, index.last[ii]) - from_ + 1, 0)
        windows = np.maximum(windows, 0)
        some = np.flatnonzero(windows)
        total = np.concatenate([[0], np.cumsum(windows[some])])
        for lo in range(0, int(total[-1]), _ALIGNED):  # a bounded number of windows at a time
            number = np.arange(lo, min(lo + _ALIGNED, int(total[-1])))
            k = np.searchsorted(total, number, side="right") - 1
            hit = some[k]
            window, own, length = from_[hit] + number - total[k], ii[hit], index.lengths[ii[hit]]
            shift = window - index.start[own]
            base = bb[hit] * 2 * step - half - int((index.last + index.lengths - index.start).max()) - step + shift
            best, ends = alignments(index, text, window, length, base, bounds[rr[hit]], bounds[rr[hit] + 1], 4 * step)
            for i in np.flatnonzero(best <= index.edits[own]):
                name = (int(rr[hit[i]]), int(index.items[own[i]]))
                begin, stop = int(ends[i] - length[i]), int(ends[i])
                old = out.get(name, [begin, stop, 1 << 20, 0])
                out[name] = [min(old[0], begin), max(old[1], stop), min(old[2], int(best[i])), old[3] + 1]


def _scan(shared):
    def batches(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                found = matches(shared.value, rows["text"])
                ids = rows["doc_id"].to_pylist()
                columns = list(zip(*((ids[f[0]], *f[1:]) for f in found), strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "item_id", "start", "end", "edits", "bands"],
                )

    return batches


def _indexes(benchmark: DataFrame):
    """One broadcast index per block of the benchmark; a block is bounded, their number is not."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield build_index([(r["item_id"], r["text"]) for r in own.toLocalIterator()])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits, bands`` for each document that holds part of an item.

    A part is any window of 80 normalised bytes, wherever it starts (the whole of a shorter item), within 5 edits (a share of
    it). ``start`` and ``end`` are code points of the text around all matched windows (the start is exact
    up to the edit budget), ``edits`` the least edits of one, ``bands`` how often a window passed in a diagonal band.
    Null and empty texts and items under 8 bytes match nothing; repeated rows give repeated results; a
    row without id is reported without id; no other column is read. Empty tables give no rows.
    """
    texts = docs.select("doc_id", "text")
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits long, bands long"
    found = spark.createDataFrame([], schema)
    for index in _indexes(benchmark):
        found = found.unionByName(texts.mapInArrow(_scan(spark.sparkContext.broadcast(index)), schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no part of any benchmark item."""
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(stream, shared=shared):
            for batch in stream:
                for a, b in chunks(batch["text"]):
                    rows = batch.slice(a, b - a)
                    clean = np.ones(b - a, dtype=bool)
                    clean[[m[0] for m in matches(shared.value, rows["text"])]] = False
                    yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
