"""Personal data by patterns and by a character model: bidirectional LSTM with CRF transitions, in numpy.

The patterns give the base spans. On a bounded sample their spans are the labels from which the model learns;
some phone numbers among them lose their country code, so that the model also finds numbers that no pattern
does. At decoding, overlapping windows are scored and their scores are averaged, and one path is decoded over each
whole stretch of windows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.words import buffers, chunks

KINDS = ("email", "ip", "card", "phone")
#: About so many documents are learned from (a bound of the classifier's fit), and so many windows at most of each.
SAMPLE_DOCUMENTS = 20_000
WINDOWS_OF_ONE = 4
TRAINED_WINDOWS = 4000
WINDOW, STRIDE = 96, 48
EMBEDDED, HIDDEN, STEPS, BATCH, RATE = 12, 20, 600, 64, 0.01
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str):
    """``[local]+@domain``: found from each @ backwards, so a long run of local characters is read once."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            free = at = found.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, kind number, end)`` of the patterns' matches that pass their tests."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _codes(text: str) -> np.ndarray:
    """A class per character: ASCII as it is, other letters 1, anything else 2; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.where(points < 128, np.maximum(points, 2), np.where(points < 0x2000, 1, 2))


def anchors(text: str) -> np.ndarray:
    """Places of digits and @. A span without one is none of the kinds, so only windows around them are read."""
    c = _codes(text)
    return np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))


@dataclass
class Tagger:
    embedding: np.ndarray
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, np.ndarray]
    moves: np.ndarray  # CRF transitions, from row to column

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.forward, *self.backward, *self.out, self.moves]

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (windows x places x tags) of padded windows."""
        x = self.embedding[codes]
        ahead = _lstm(x, *self.forward)[0]
        back = _lstm(x[:, ::-1], *self.backward)[0][:, ::-1]
        return np.concatenate([ahead, back], axis=2) @ self.out[0] + self.out[1]


def new_tagger(seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)

    def weights(n: int, m: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(n), (n, m)).astype(np.float32)

    def bias() -> np.ndarray:
        b = np.zeros(4 * HIDDEN, dtype=np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
        return b

    n = EMBEDDED + HIDDEN
    return Tagger(
        rng.normal(0, 0.3, (128, EMBEDDED)).astype(np.float32), (weights(n, 4 * HIDDEN), bias()),
        (weights(n, 4 * HIDDEN), bias()), (weights(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32)),
        np.zeros((TAGS, TAGS), np.float32),
    )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, w, b):
    """Hidden states, and what the gradient needs."""
    n, steps, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((n, steps, HIDDEN), np.float32)
    kept = []
    for t in range(steps):
        joined = np.concatenate([x[:, t], h], axis=1)
        gates = joined @ w + b
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[:, t] = h
        kept.append((joined, i, f, o, g, before, squashed))
    return states, kept


def _lstm_gradient(slopes, kept, w):
    """Gradients of the weights, bias and inputs from those of the states."""
    n, steps, _ = slopes.shape
    dw, db = np.zeros_like(w), np.zeros(w.shape[1], np.float32)
    dx = np.empty((n, steps, w.shape[0] - HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        joined, i, f, o, g, before, squashed = kept[t]
        dh = dh + slopes[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        dg = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1
        )
        dw += joined.T @ dg
        db += dg.sum(0)
        back = dg @ w.T
        dx[:, t], dh, dc = back[:, : -HIDDEN], back[:, -HIDDEN:], dc * f
    return dw, db, dx


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf_gradient(scores, tags, moves):
    """Gradients of the negative log likelihood of the tag paths."""
    n, steps, k = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0]
    for t in range(1, steps):
        ahead[:, t] = scores[:, t] + _log_sum(ahead[:, t - 1, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        back[:, t] = _log_sum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    whole = _log_sum(ahead[:, -1], 1)
    d_scores = np.exp(ahead + back - whole[:, None, None])
    pairs = np.exp(
        ahead[:, :-1, :, None] + moves + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
    ).sum((0, 1))
    d_scores[np.arange(n)[:, None], np.arange(steps), tags] -= 1
    np.add.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    return d_scores.astype(np.float32), pairs.astype(np.float32)


def fit(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 5) -> Tagger | None:
    """Learn from ``(text, [(start, kind, end)])`` windows by Adam; without windows there is no model."""
    if not windows:
        return None
    codes = np.zeros((len(windows), WINDOW), dtype=np.int64)
    tags = np.zeros((len(windows), WINDOW), dtype=np.int64)
    for i, (text, spans) in enumerate(windows):
        own = _codes(text[:WINDOW])
        codes[i, : len(own)] = own
        for start, kind, end in spans:
            tags[i, start:end] = 2 + 2 * kind
            tags[i, start] = 1 + 2 * kind
    tagger, rng = new_tagger(), np.random.default_rng(seed)
    values = tagger.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    turn = 0
    while turn < STEPS:
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = tagger.embedding[codes[rows]]
            ahead, kept_a = _lstm(x, *tagger.forward)
            back, kept_b = _lstm(x[:, ::-1], *tagger.backward)
            states = np.concatenate([ahead, back[:, ::-1]], axis=2)
            scores = states @ tagger.out[0] + tagger.out[1]
            d_scores, d_moves = _crf_gradient(scores, tags[rows], tagger.moves)
            d_states = d_scores @ tagger.out[0].T
            dw_a, db_a, dx_a = _lstm_gradient(d_states[:, :, :HIDDEN], kept_a, tagger.forward[0])
            dw_b, db_b, dx_b = _lstm_gradient(d_states[:, ::-1, HIDDEN:], kept_b, tagger.backward[0])
            d_embedding = np.zeros_like(tagger.embedding)
            np.add.at(d_embedding, codes[rows], dx_a + dx_b[:, ::-1])
            slopes = [
                d_embedding, dw_a, db_a, dw_b, db_b,
                states.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS), d_scores.sum((0, 1)), d_moves,
            ]
            turn += 1
            for value, slope, m, v in zip(values, slopes, first, second, strict=True):
                slope = np.clip(slope / len(rows), -1, 1)
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return tagger


_ALLOWED = np.array([
    [0.0 if b % 2 == 1 or b == 0 or a in (b, b - 1) else -1e4 for b in range(TAGS)] for a in range(TAGS)
])  # inside follows the begin or inside of its own kind


def decode(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag path over the places of one stretch."""
    moves = moves + _ALLOWED
    best = scores[0] + _ALLOWED[0]
    trace = np.empty(scores.shape, dtype=np.int8)
    for t in range(1, len(scores)):
        options = best[:, None] + moves
        trace[t] = options.argmax(0)
        best = options.max(0) + scores[t]
    path = np.empty(len(scores), dtype=np.int64)
    path[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = trace[t, path[t]]
    return path


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of windows of the common grid that hold an anchor or stand next to one that does."""
    places = anchors(text)
    if not len(places):
        return []
    cells = np.unique(np.concatenate([places // STRIDE - 1, places // STRIDE, places // STRIDE + 1]))
    cells = cells[(cells >= 0) & (cells * STRIDE < len(text))]
    cut = np.flatnonzero(np.diff(cells) > 1) + 1
    return [(int(c[0]), int(c[-1]) + 1) for c in np.split(cells, cut)]


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans ``(start, kind, end)`` that the model reads in each text."""
    jobs = [(i, a, b) for i, text in enumerate(texts) for a, b in _stretches(text)]
    starts = [(i, w * STRIDE) for i, a, b in jobs for w in range(a, b)]
    codes = {i: _codes(texts[i]) for i in {j[0] for j in jobs}}
    scores = np.empty((len(starts), WINDOW, TAGS), dtype=np.float32)
    for at in range(0, len(starts), 256):
        part = starts[at : at + 256]
        block = np.zeros((len(part), WINDOW), dtype=np.int64)
        for k, (i, s) in enumerate(part):
            own = codes[i][s : s + WINDOW]
            block[k, : len(own)] = own
        scores[at : at + 256] = tagger.emissions(block)
    # A window counts most in its middle, where it has seen both sides.
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    for i, a, b in jobs:
        low, size = a * STRIDE, min(len(texts[i]), (b - 1) * STRIDE + WINDOW) - a * STRIDE
        total, weights = np.zeros((size + WINDOW, TAGS)), np.zeros((size + WINDOW, 1))
        for w in range(a, b):
            s = w * STRIDE - low
            total[s : s + WINDOW] += scores[at] * weight
            weights[s : s + WINDOW] += weight
            at += 1
        path = decode(total[:size] / weights[:size], tagger.moves)
        begins = np.flatnonzero(path % 2 == 1)
        for s in begins:
            e = s + 1
            while e < size and path[e] == path[s] + 1:
                e += 1
            out[i].append((low + int(s), int(path[s] // 2), low + int(e)))
    return out


def _plausible(text: str, kind: int) -> bool:
    """What any span of a kind must hold, whoever found it."""
    digits = sum(c.isdigit() and c.isascii() for c in text)
    if kind == 0:
        return "@" in text[1:-1]
    return digits >= (4, 14, 7)[kind - 1] and not any(c.isspace() for c in (text[0], text[-1]))


def all_spans(text: str, found: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Base spans, and base and model spans together; the model's stay clear of the base ones."""
    base = base_spans(text)
    taken = np.zeros(len(text) + 1, dtype=bool)
    for start, _, end in base:
        taken[start:end] = True
    more = [
        (s, k, e) for s, k, e in found if not taken[s:e].any() and _plausible(text[s:e], k)
    ]
    return base, sorted(base + more)


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _has_anchor(column: pa.Array) -> np.ndarray:
    data, bounds = buffers(column)
    hit = ((data >= 48) & (data <= 57)) | (data == 64)
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[bounds[1:]] > sums[bounds[:-1]]


def training_windows(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A few labelled windows of a text: around its first base spans, or around its first anchor."""
    out = []
    spans = base_spans(text)
    places = [s for s, _, _ in spans] or [int(p) for p in anchors(text)[:1]]
    for place in places[:WINDOWS_OF_ONE]:
        shift = int(hashlib.md5(text[place : place + 40].encode("utf-8", "replace")).hexdigest(), 16)
        low = max(0, place - 8 - shift % 40)
        own = [(s - low, k, e - low) for s, k, e in spans if s >= low and e <= low + WINDOW]
        cut = [s for s, _, e in spans if s < low + WINDOW < e]
        part = text[low : min([low + WINDOW, *cut])]
        out.append((part, own))
        for s, k, e in own[:1]:
            code = re.match(r"\+[0-9]+ ?", part[s:e])
            if k == 3 and code and not code.end() + s >= e:  # the same number without its country code
                n = code.end()
                later = [(a - n, b, c - n) for a, b, c in own if a >= e]
                out.append((part[:s] + part[s + n :], [(s, 3, e - n), *later]))
    return out


def train(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Tagger | None:
    """Learn from about ``sample`` documents, drawn by a hash of the id; only windows reach the driver."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 20)) < share * (1 << 20))

    def labelled(stream):
        for batch in stream:
            texts, spans = [], []
            for text, hit in zip(batch["text"].to_pylist(), _has_anchor(batch["text"]), strict=True):
                for part, own in training_windows(text) if hit else ():
                    texts.append(part)
                    spans.append(";".join(f"{s},{k},{e}" for s, k, e in own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["text", "spans"]
            )

    found = (
        drawn.mapInArrow(labelled, "text string, spans string").distinct()
        .orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(TRAINED_WINDOWS).collect()
    )
    return fit([
        (r["text"], [tuple(map(int, s.split(","))) for s in r["spans"].split(";") if s]) for r in found
    ])


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row of ``docs`` (``doc_id, text``).

    Spans are ``kind:start:end`` in code points, by start, then kind. A null or empty text has none. Repeated rows
    get equal results; other columns are ignored; an empty table gives no rows. Texts without a digit or @ hold no
    span of any kind and are not read further.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def scanned(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                n = b - a
                counts = np.zeros((len(KINDS), n), dtype=np.int64)
                hashes, listed = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
                hit = np.flatnonzero(_has_anchor(rows["text"]))
                texts = rows["text"].take(pa.array(hit)).to_pylist()
                found = model_spans(shared.value, texts) if shared.value else [[]] * len(texts)
                for i, text, more in zip(hit, texts, found, strict=True):
                    base, spans = all_spans(text, more)
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                    hashes[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                    listed[i] = _listed(spans)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], *map(pa.array, counts), pa.array(hashes, pa.string()), pa.array(listed, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        scanned, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
