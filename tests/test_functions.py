"""Column functions on small literal inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import confidence as conf
from claimgraph.functions import temporal as time
from claimgraph.functions import text
from claimgraph.schema import BOUNDS


def values(df, name="x"):
    return [r[name] for r in df.collect()]


def test_bands_are_inclusive_below(spark):
    points = [0.95, 0.90, 0.89, 0.70, 0.69, 0.40, 0.39, 0.20, 0.19, 0.0, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, p double").orderBy("i")
    assert values(df.select(conf.confidence_band(F.col("p")).alias("x"))) == [
        "very_strong", "very_strong", "strong", "strong", "moderate", "moderate",
        "weak", "weak", "very_weak", "very_weak", "unscored",
    ]


def test_unscored_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.1), (4, None)], "i int, p double")
    def kept(t, flag):
        return sorted(values(df.where(conf.passes_confidence(F.col("p"), t, flag)), "i"))
    assert kept(0.5, False) == [1, 2]
    assert kept(0.0, False) == [1, 2, 3]
    assert kept(0.99, True) == [4]


def test_unknown_bounds_rule_nothing_out(spark):
    rows = [
        ("1590-01-01", None, None, "1626-12-31"), (None, None, None, None),
        ("1590-01-01", "1595-12-31", "1610-01-01", "1626-12-31"), ("1700-01-01", None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{b} string" for b in BOUNDS)).select(
        *[F.col(b).cast("date").alias(b) for b in BOUNDS]
    )
    w = time.window_bounds("1600", "1600")
    out = df.select(
        time.possibly_active(*w).alias("p"), time.certainly_active(*w).alias("c"), time.is_undated().alias("u")
    ).collect()
    assert [tuple(r) for r in out] == [
        (True, False, False), (True, False, True), (True, True, False), (False, False, False),
    ]


@pytest.mark.parametrize(
    "code,first,last,circa",
    [
        ("IN", "1561-01-01", "1561-12-31", False), ("ca", "1561-01-01", "1561-12-31", True),
        ("AF/IN", "1561-01-01", None, False), ("BF/IN", None, "1561-12-31", False),
        ("AF", "1561-12-31", None, False), ("BF", None, "1561-01-01", False),
        ("", "1561-01-01", "1561-12-31", False), ("??", "1561-01-01", "1561-12-31", False),
    ],
)
def test_date_codes(spark, code, first, last, circa):
    point = time.interpret_endpoint(F.lit(code), F.lit(1561))
    row = spark.range(1).select(point.alias("x")).select("x.*").first()
    assert (row[0] and str(row[0]), row[1] and str(row[1]), row[2]) == (first, last, circa)


def test_year_grammar(spark):
    texts = ["1561", " 1561 ", "+5", "1_561", "1__5", "circ", "", None, "15.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [tuple(r[0]) for r in df.select(time.parse_year(F.col("t"))).collect()]
    assert out == [
        (1561, False), (1561, False), (5, False), (1561, False), (None, True), (None, True),
        (None, False), (None, False), (None, True),
    ]


def test_window_text_forms():
    assert time.expand_date_text("1600", True) == "1600-12-31"
    assert time.expand_date_text("1600-05-01", True) == "1600-05-01"
    assert time.expand_date_text(" ", False) is None
    with pytest.raises(ValueError):
        time.expand_date_text("May 1600", False)


def test_fuzzy_text(spark):
    def text_of(e, lt, circa):
        d = [F.lit(x).cast("date") for x in (e, lt)]
        return spark.range(1).select(time.format_fuzzy(*d, F.lit(circa))).first()[0]
    assert text_of("1561-01-01", "1561-12-31", True) == "c. 1561"
    assert text_of("1561-01-01", "1563-12-31", False) == "1561–1563"
    assert text_of("1561-01-01", None, False) == "after 1561"
    assert text_of(None, "1626-01-01", True) == "before c. 1626"
    assert text_of(None, None, False) == "date unknown"


RECORDS = [
    {"b": 1, "a": "é", "n": None, "x": [1, {"z": "q", "y": 0.97}]},
    {"mark": "😀 – ü", "id": "7", "flag": True},
]


@pytest.mark.parametrize("record", RECORDS)
def test_hashes_equal_those_of_sorted_json(spark, record):
    def digest(ascii_only):
        out = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
        return hashlib.sha256(out.encode()).hexdigest()
    raw = F.lit(json.dumps(record, ensure_ascii=False))
    row = spark.range(1).select(text.content_hash(raw), text.content_hash(raw, "letter")).first()
    assert row[0] == "sha256:" + digest(False)
    assert row[1] == digest(True)[:16]


def test_trigrams_pad_each_word(spark):
    row = spark.range(1).select(text.trigrams(F.lit("Cat, dog!"))).first()[0]
    assert sorted(row) == sorted(["  c", " ca", "cat", "at ", "  d", " do", "dog", "og "])


def test_name_normalisation_eats_unicode_spaces(spark):
    row = spark.range(1).select(text.normalize_name(F.lit(" Ada  \t Lovel ace "))).first()[0]
    assert row == "Ada Lovel ace"
