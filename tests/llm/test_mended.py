"""Cases that earlier versions of the corpus operators got wrong."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from claimgraph.llm import fertility, mixing, near, secrets, toxicity, wrapper
from claimgraph.llm.dom import parse

PROSE = "the of and to in that is was for on with as by at from it an be this are".split()


def prose(rng, n):
    words = PROSE + ["house", "river", "window", "morning", "people", "garden", "letter", "market", "summer", "winter"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n))


# Source mixing --------------------------------------------------------------------------


def test_a_weight_of_zero_takes_no_share_of_the_levels_above(spark):
    rng = random.Random(1)
    docs = [(i, "w " * 50, "fr" if i % 10 else "en", "src1") for i in range(400)]  # web, 90 % French
    docs += [(1000 + i, "w " * 50, "en", "src9") for i in range(200)]  # reference
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 0.5, "reference": 0.5}, "lang": {"en": 1.0, "fr": 0.0}, "source": {}}
    mix = mixing.Mix(weights=weights, share=1 / 3, epochs=1)  # 10,000 of 30,000 tokens
    taken = mixing.mixed(frame, mix, with_text=False).groupBy("domain", "lang").sum("n_tokens").collect()
    # The web has 2,000 tokens of English, so the reference gives the other 8,000.
    assert {(r[0], r[1]): r[2] for r in taken} == {("web", "en"): 2000, ("reference", "en"): 8000}


# The near-duplicate stage ---------------------------------------------------------------


def test_unlike_texts_of_one_id_both_stay(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(60)) for _ in range(5)]
    rows = [
        (1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " end"), (3, texts[2]), (3, texts[2] + " more"),
        (4, texts[2]), (5, texts[3]), (5, None), (5, None), (5, ""), (None, texts[3]), (None, texts[3]),
    ]
    frame = spark.createDataFrame(
        [(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, str(tmp_path)).collect()]
    groups = [[texts[0]], [texts[1], texts[1] + " end"], [texts[2], texts[2] + " more"]]
    for group in groups:  # one document of each group
        assert sum(t in group for _, t in out) == 1
    assert (1, texts[0]) in out and {d for d, t in out if t in groups[2]} == {3}
    assert sorted((d, t) for d, t in out if d == 5 and t) == [(5, texts[3])]
    assert [t for d, t in out if d == 5].count(None) == 1 and [t for d, t in out if d == 5].count("") == 1
    assert [t for d, t in out if d is None] == [texts[3]] * 2


def test_a_large_group_of_near_copies_on_both_sides_of_the_threshold(spark):
    """Copies that differ from the first in a few words; some pairs are links, others fall just short of them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(1500):
        own = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4, 5])):
            own[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    found = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    sets = [{*zip(t.split(), t.split()[1:])} for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if root(i) != root(j):
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: root(i) for i in range(len(docs))}


# Quality rules --------------------------------------------------------------------------


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, rng.choice([12, 40, 200])), "en") for i in range(300)]
    marks = ["###", "$$$", "%%%", "&&&", "***", "|"]
    junk = [(1000 + i, " ".join(w + rng.choice(marks) for w in prose(rng, 80).split()), "en") for i in range(10)]
    junk += [(2000 + i, " ".join("".join(rng.choice("qxzjkvw0123") for _ in range(14)) for _ in range(60)), "en") for i in range(10)]
    frame = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    rows = fertility.quality(frame).collect()
    assert not any(r["base_failed"] for r in rows if r["doc_id"] >= 1000)
    assert [r["doc_id"] for r in rows if r["doc_id"] >= 1000 and r["kept"]] == []
    wrong = [r["doc_id"] for r in rows if r["doc_id"] < 1000 and not r["base_failed"] and not r["kept"]]
    assert wrong == []


# Toxicity -------------------------------------------------------------------------------


def odds_of(texts, labels, asked):
    terms, first = toxicity.term_sets(pa.array(texts))
    machine = toxicity.fit([terms[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], np.array(labels, dtype=float))
    return machine, 1 / (1 + np.exp(-machine.raw(*toxicity.term_sets(pa.array(asked), machine.known))))


def test_terms_that_are_toxic_only_together():
    """Both words are as common in clean texts as in toxic ones; only their pair tells."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(1200):
        own = [f"w{rng.randrange(300)}" for _ in range(25)] + [["alpha", "beta"], [], ["alpha"], ["beta"]][i % 4]
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append(int(i % 4 < 2))
    machine, p = odds_of(texts, labels, ["w1 w2 alpha beta", "w1 alpha w9", "w2 beta w7"])
    assert machine.known.sum() < 10 and p[0] > 0.9 and p[1] < 0.1 and p[2] < 0.1


def test_chance_gives_no_pair_a_weight():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(120)}" for _ in range(30)) for _ in range(1500)]
    labels = [int(rng.random() < 0.1) for _ in texts]
    terms, first = toxicity.term_sets(pa.array(texts))
    own = np.unique(terms, return_inverse=True)[1]
    chance = np.full(len(texts), np.mean(labels))
    assert not toxicity.paired(own, first, np.array(labels, dtype=float), chance, own.max() + 1).any()
    assert odds_of(texts, labels, texts[:50])[1].max() < 0.5


# Secrets --------------------------------------------------------------------------------


def test_thousands_of_secrets_in_one_text_are_placed(spark):
    rng = random.Random(7)
    text, expected = "", []
    for i in range(2050):  # many blocks of matches, the last one not full
        text += rng.choice(["é ", "so it goes, ", "\n"])
        value = f"ab{i:05d}" if i % 3 else "short"
        expected += [("assign", len(text), len(text) + len(f"token={value}"))] if i % 3 else []
        text += f"token={value} "
    found = secrets.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in found] == expected


# HTML extraction ------------------------------------------------------------------------


def test_a_page_inside_a_form_is_not_lost():
    story = "<h1>Title</h1>" + "".join(f"<p>Sentence {i} of a story that goes on for a while.</p>" for i in range(8))
    whole = "Title " + " ".join(f"Sentence {i} of a story that goes on for a while." for i in range(8))
    nav = "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav>"
    for inside in (f"<article>{story}</article>", story):
        page = f"<body><form id='aspnetForm'>{nav}{inside}<input name='q'><label>Search</label></form></body>"
        assert wrapper.main_text(parse(page)) == whole
    beside = f"<body>{nav}<article>{story}</article><form><p>Leave your address and we will write.</p></form></body>"
    assert wrapper.main_text(parse(beside)) == whole
    assert wrapper.main_text(parse("<body><form><p>Sign in</p><label>Name</label><input></form></body>")) == ""


def test_a_story_in_two_articles_is_whole_and_teasers_are_not_taken():
    part = lambda k: "".join(f"<p>Part {k} sentence {i} says something of some length here.</p>" for i in range(9))
    said = lambda k: " ".join(f"Part {k} sentence {i} says something of some length here." for i in range(9))
    page = f"<body><main><article>{part(1)}</article><article>{part(2)}</article></main></body>"
    assert wrapper.main_text(parse(page)) == said(1) + " " + said(2)
    teaser = "<article><a href='/x'>Something else that is worth a look, says the site</a></article>"
    page = f"<body><main><article>{part(1)}</article>{teaser * 4}</main></body>"
    assert wrapper.main_text(parse(page)) == said(1)
