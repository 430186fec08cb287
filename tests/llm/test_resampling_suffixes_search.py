"""Importance resampling, suffix dedup and ranked search against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimgraph.llm import importance, ranked, suffixes

ODD = [
    (1, "The cat sat on a warm mat near old red doors while rain fell over grey hills and wide green fields", "x"),
    (1, "The cat sat on a warm mat near old red doors while rain fell over grey hills and wide green fields", "x"),
    (2, None, None), (3, "", "y"), (4, " \t\n ", None), (None, "words without an id " * 9, "z"),
    (5, "x" * 30_000 + " long " * 20_000, "x"), (6, "1234 5678 !!! ???", "x"), (7, "é" * 200 + " " + "ß ẞ ÄÖ äö", "x"),
]
EXTRA = ("score", "gram", "part", "mark", "count", "term", "bucket", "gain", "rank", "weight", "n", "listed")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *["x"] * (len(EXTRA) - 1)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- suffix dedup ----------------------------------------------------------------------------------------


def cut(docs, depth):
    """Kept bytes by brute force, for rows in order."""
    first = {}
    for d, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - depth + 1):
            if d is not None:
                key = data[i : i + depth]
                first[key] = min(first.get(key, d), d)
    out = []
    for d, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            if d is not None and first[data[i : i + depth]] < d:
                gone[i : i + depth] = b"\1" * depth
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def removed(frame, depth=suffixes.DEPTH):
    rows = suffixes.without_repeats(frame, depth).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:5], bytes(r[5])) for r in rows)


def test_repeated_strings_go_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (5, 12, 13, 14, 30, 80)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            parts.append(rng.choice([p, p[a:b], p[:a] + "#" + p[b:], word() * 12, " ".join(word() for _ in range(9))]))
        docs.append((rng.randrange(90), rng.choice([" ", "", "\n"]).join(parts)))
    docs += [(200, "=" * 400), (201, "=" * 90 + "-" * 60), (202, "=" * 49), (3, passages[-1]), (None, passages[-1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert removed(frame) == cut(docs, 50)
    assert removed(frame, 28) == cut(docs, 28)
    assert removed(frame, 61) == cut(docs, 61)
    monkeypatch.setattr(suffixes, "CROWD", 1)  # every gram with several contexts is a crowd
    assert removed(frame) == cut(docs, 50)


def test_windows_over_segments_and_hidden_starts(spark, monkeypatch):
    """Segments shorter than texts, in this process: every window is in one run, and equal windows share their gram."""
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 49, 50, 51, 130, 700)] + ["a" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    grams, seen = {}, Counter()
    for row, start, count, gram, _ in suffixes.runs(data, bounds, 50):
        for r, s, n, g in zip(row, start, count, gram, strict=True):
            for at in range(s, s + n):
                seen[r, at] += 1
                assert grams.setdefault(texts[r][at : at + 50], g) == g
    assert seen == {(r, at): 1 for r, t in enumerate(texts) for at in range(len(t) - 49)}


def test_suffixes_of_odd_rows(odd, none):
    docs = [(d, t) for d, t, _ in ODD]
    assert removed(odd) == cut(docs, 50)
    assert suffixes.without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        suffixes.without_repeats(none, 8)


# --- importance resampling -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    ws = WORD.findall(lower(text))
    return Counter(zlib.crc32(f.encode()) % 10000 for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]), len(ws)


def drawn(docs, target, percent=25):
    held, wanted = Counter(), Counter()
    for _, text in docs:
        held += bag(text)[0]
    for text in target:
        wanted += bag(text)[0]
    s, t = sum(held.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((held[b] + 1) * (t + 10000)))) for b in range(10000)}
    rows = []
    for d, text in docs:
        own, n_words = bag(text)
        n = sum(own.values())
        weight = sum(gain[b] * c for b, c in own.items()) // n if n else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, n, weight, score, None, n_words])
    able = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(5)
    names = ["a", "Z", "né", "x9", "q" * 63, "r" * 64, "s" * 65, "t" * 200] + [f"w{i}" for i in range(60)]
    docs = [(i, rng.choice([" ", "-", "\x7f"]).join(rng.choice(names) for _ in range(rng.randrange(90)))) for i in range(300)]
    docs.append((400, "the same word again " * 3000))
    target = [" ".join(rng.choice(names[:9]) for _ in range(30)) for _ in range(5)]
    found = importance.resampled(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(t,) for t in target], "text string"),
    ).collect()
    assert sorted(map(tuple, found), key=str) == drawn(docs, target)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 70_000, (9, importance.BUCKETS)) * (rng.random((9, importance.BUCKETS)) < 0.1)
    gain = rng.integers(-20_000, 20_000, importance.BUCKETS)
    positive, negative = (importance.bit_planes(np.maximum(s * gain, 0)[None]) for s in (1, -1))
    assert (importance.plane_sums(importance.bit_planes(counts), positive, negative) == counts @ gain).all()


def test_resampling_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "cat on a mat"), (2, None)], "item_id long, text string")
    found = sorted(map(tuple, importance.resampled(odd, bench).collect()), key=str)
    expected = drawn([(d, t) for d, t, _ in ODD], ["cat on a mat", None])
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert sorted(r[4] for r in found if r[4]) == sorted(r[4] for r in expected if r[4])
    assert importance.resampled(none, bench).count() == 0
    assert importance.resampled(odd, bench.limit(0)).count() == len(ODD)


# --- ranked search ---------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def best(docs, items, top=50):
    terms = [(d, TERM.findall(lower(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        wanted = {t for i, text in items if i == item for t in TERM.findall(lower(text))}
        scores = []
        for d, ts in terms:
            tf, m = Counter(ts), 50 + (50 * len(ts) * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in wanted if tf[t]
            )
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    names = [f"t{i}" for i in range(150)] + ["É", "straße", "A1"]
    pick = lambda: names[min(int(rng.expovariate(0.03)), len(names) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rng.randrange(80)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)]  # ties, more than are listed
    items = [(i, " ".join(pick() for _ in range(rng.randrange(25)))) for i in range(40)] + [(3, "t1 t149"), (None, "t2")]
    frames = [spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")]
    expected = best(docs, items)
    assert sorted(map(tuple, ranked.search(*frames).collect())) == expected
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 200)  # several blocks
    assert sorted(map(tuple, ranked.search(*frames).collect())) == expected


def test_shared_sums_are_the_queries():
    rng = random.Random(9)
    queries = {q: {min(int(rng.expovariate(0.1)), 59) for _ in range(rng.randrange(20))} for q in range(80)}
    graph = ranked.share(queries, 60)
    holds = [Counter([t]) for t in range(60)]
    for a, b in graph.joins:
        holds.append(holds[a] + holds[b])
    assert {q: sum((holds[p] for p in parts), Counter()) for q, parts in graph.parts.items()} == {
        q: Counter(terms) for q, terms in queries.items()
    }
    used = len(graph.joins) + sum(map(len, graph.parts.values()))
    assert used < 0.7 * sum(map(len, queries.values()))  # sums that are shared are taken once
    assert not any(  # no pair is left that two queries hold
        n > 1 for n in Counter((a, b) for p in graph.parts.values() for a in p for b in p if a < b).values()
    )


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "cat MAT long 1234"), (2, None), (3, ""), (None, "cat"), (4, "ä ß äö words"), (5, "zzz")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    found = sorted(map(tuple, ranked.search(odd, frame).collect()))
    assert found == best([(d, t) for d, t, _ in ODD], items)
    assert ranked.search(none, frame).count() == 0
    assert ranked.search(odd, frame.limit(0)).count() == 0


def test_checksums_are_those_of_zlib():
    texts = ["", "a", "é" * 40, "b" * 64, "c" * 65, "d" * 5000]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    found = importance.word_checksums(data, np.append(0, ends[:-1]), ends)
    assert found.tolist() == [zlib.crc32(t.encode()) for t in texts]
    row, bucket, n = importance.features(pa.array(["A b", None, "c" * 70 + " " + "d" * 80]))
    assert n.tolist() == [2, 0, 2]
    assert Counter(zip(row.tolist(), bucket.tolist())) == Counter(
        [(0, b) for b in bag("A b")[0].elements()] + [(2, b) for b in bag("c" * 70 + " " + "d" * 80)[0].elements()]
    )
