"""Entity resolution: candidate profiles, scores, bands and their quality.

Entities with the same names and life dates are interchangeable, so they are folded
into one *profile* first and only distinct profiles are compared. A group of n copies
costs n rows, never n squared pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import gram_similarity, normalize_name, trigrams

#: Names of one gram's list that one task meets with the names that may be alike.
LIST_ROWS = 2000


def profiles(names: DataFrame, dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct profiles, and ``entity_id, profile_id`` of every entity.

    ``names``: ``entity_id, name``. ``dates``: ``entity_id, born_year, died_year``. A
    profile is a name with life years; its id is the lowest entity that has it.
    """
    key = ["name", "born_year", "died_year"]
    rows = (
        names.select("entity_id", F.lower(normalize_name(F.col("name"))).alias("name"))
        .distinct()
        .join(dates, "entity_id", "left")
    )
    found = rows.groupBy(*key).agg(
        F.min("entity_id").alias("profile_id"), F.count("*").alias("members")
    )
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    member = (
        rows.alias("r").join(found.alias("p"), same)
        .select(F.col("r.entity_id").alias("entity_id"), F.col("p.profile_id").alias("profile_id"),
                F.col("r.name").alias("name"))
    )
    return found, member


def _prefix(names: DataFrame, floor: float) -> DataFrame:
    """The rarest grams of each name, enough that similar names must share one.

    Two gram sets with similarity ``floor`` share at least ``ceil(floor * n)`` of n,
    so each has a common gram among its n - ceil(floor * n) + 1 rarest. Frequent
    grams fall out by proof, not by a cap. ``place`` counts the name's rarer grams, which ``before`` holds.
    """
    grams = names.select("name", F.explode("grams").alias("gram"), F.size("grams").alias("n"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = grams.join(rarity, "gram").groupBy("name", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram")))["gram"].alias("_all")  # as many as the name has
    )
    needed = F.col("n") - F.ceil(F.round(F.col("n") * F.lit(floor), 9)) + 1
    return ordered.withColumn("_own", F.slice("_all", F.lit(1), needed.cast("int"))).select(
        "name", "n", "_own", F.posexplode("_own").alias("place", "gram")
    ).select("name", "gram", "n", "place", F.slice("_own", F.lit(1), F.col("place")).alias("before"))


def similar_names(names: DataFrame, floor: float) -> DataFrame:
    """``name_a < name_b, similarity`` of distinct names at least ``floor`` alike.

    A pair comes out of the join once, at the rarest gram that both have, and only if what can still follow that
    gram on both sides suffices. The lists of a gram are cut by size of the names, since sizes bound the
    similarity, and a long list is dealt over several tasks.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor must be in (0, 1]")
    distinct = names.select("name").distinct().withColumn("grams", trigrams(F.col("name")))
    # Sizes that the floor still allows lie at most one band apart.
    band = F.floor(F.log("n") / F.lit(math.log(1 / floor) + 1e-9)).cast("long")
    listed = _prefix(distinct, floor).withColumn("band", band)
    pieces = (
        listed.groupBy("gram", "band").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("pieces")).where("pieces > 1")
    )

    def side(rows: DataFrame, tag: str, piece: Column) -> DataFrame:
        dealt = rows.join(pieces, ["gram", "band"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        return dealt.select(
            "gram", "band", piece.alias("piece"), *[F.col(c).alias(f"{c}_{tag}") for c in ("name", "n", "place", "before")]
        )

    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))
    left = side(listed, "a", F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int"))
    right = side(listed.withColumn("band", near), "b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    after = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    shared = (F.col("n_a") + F.col("n_b")) * F.lit(floor / (1 + floor))
    candidates = left.join(right, ["gram", "band", "piece"]).where(
        (F.col("name_a") < F.col("name_b"))
        & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(floor) - F.lit(1e-9))
        & (after >= shared - F.lit(1e-9))
        & ~F.arrays_overlap("before_a", "before_b")
    ).select("name_a", "name_b")

    def grams_of(name: str) -> DataFrame:
        return distinct.select(F.col("name").alias(name), F.col("grams").alias(f"_{name}"))

    return (
        candidates.join(grams_of("name_a"), "name_a")
        .join(grams_of("name_b"), "name_b")
        .withColumn("similarity", gram_similarity(F.col("_name_a"), F.col("_name_b")))
        .where(F.col("similarity") >= F.lit(floor))
        .select("name_a", "name_b", "similarity")
    )


def _compatible(a: str, b: str, tolerance: int) -> Column:
    gap = F.abs(F.col(a) - F.col(b))
    return gap.isNull() | (gap <= tolerance)


def block_pairs(found: DataFrame, floor: float = 0.6, year_tolerance: int = 5) -> DataFrame:
    """Candidate pairs of profiles: similar names, life years not ruled out.

    Profiles of one name are compared too when their years differ.
    """
    names = found.select("name").distinct()
    alike = similar_names(names, floor)
    same = names.select(
        F.col("name").alias("name_a"), F.col("name").alias("name_b"),
        F.lit(1.0).alias("similarity"),
    )

    def side(tag: str) -> DataFrame:
        return found.select(
            F.col("name").alias(f"name_{tag}"),
            F.col("profile_id").alias(f"profile_{tag}"),
            F.col("born_year").alias(f"born_{tag}"),
            F.col("died_year").alias(f"died_{tag}"),
        )

    # Born years meet through bands as wide as the tolerance, so one common name does
    # not pair all its years; only profiles of unknown birth meet every other.
    named, other = alike.unionByName(same).join(side("a"), "name_a"), side("b")
    band = F.floor(F.col("born_a") / (year_tolerance + 1))
    born_b = other.where(F.col("born_b").isNotNull())
    near = named.withColumn("_band", band).join(
        born_b.withColumn("_near", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(
            "_band", F.floor(F.col("born_b") / (year_tolerance + 1)) + F.col("_near")
        ),
        ["name_b", "_band"],
    ).drop("_band", "_near")
    open_a = named.where(F.col("born_a").isNull()).join(other, "name_b")
    open_b = named.where(F.col("born_a").isNotNull()).join(
        other.where(F.col("born_b").isNull()), "name_b"
    )
    pairs = near.unionByName(open_a).unionByName(open_b)
    distinct = (F.col("name_a") != F.col("name_b")) | (F.col("profile_a") < F.col("profile_b"))
    return pairs.where(
        distinct
        & (F.col("profile_a") != F.col("profile_b"))
        & _compatible("born_a", "born_b", year_tolerance)
        & _compatible("died_a", "died_b", year_tolerance)
    ).select(
        F.least("profile_a", "profile_b").alias("a"),
        F.greatest("profile_a", "profile_b").alias("b"),
        "similarity",
        F.abs(F.col("born_a") - F.col("born_b")).alias("born_gap"),
        F.abs(F.col("died_a") - F.col("died_b")).alias("died_gap"),
    ).groupBy("a", "b").agg(
        F.max("similarity").alias("similarity"),
        F.min("born_gap").alias("born_gap"),
        F.min("died_gap").alias("died_gap"),
    )


@dataclass(frozen=True)
class MatchModel:
    """Agreement probabilities: ``m`` among matches, ``u`` among non-matches."""

    prior: float = 0.01
    name_m: tuple[float, float, float] = (0.05, 0.25, 0.70)
    name_u: tuple[float, float, float] = (0.90, 0.08, 0.02)
    year_m: tuple[float, float, float] = (0.05, 0.25, 0.70)
    year_u: tuple[float, float, float] = (0.80, 0.15, 0.05)


def agreement_levels(pairs: DataFrame) -> DataFrame:
    """Levels 0 to 2 per field; NULL where a field is unknown on either side."""
    def year(gap: str) -> Column:
        return F.when(F.col(gap) == 0, 2).when(F.col(gap) <= 2, 1).when(F.col(gap) > 2, 0)

    s = F.col("similarity")
    return pairs.withColumns(
        {
            "name_level": F.when(s >= 0.9, 2).when(s >= 0.75, 1).otherwise(0),
            "born_level": year("born_gap"),
            "died_level": year("died_gap"),
        }
    )


def _weight(level: str, m, u) -> Column:
    expr = None
    for i, (hit, miss) in enumerate(zip(m, u, strict=True)):
        w = F.log2(F.lit(hit) / F.lit(miss))
        expr = (F.when if expr is None else expr.when)(F.col(level) == i, w)
    return expr.otherwise(F.lit(0.0))


def score_pairs(pairs: DataFrame, model: MatchModel = MatchModel()) -> DataFrame:
    """Add ``weight`` (summed log-likelihood ratios) and ``p``, the match probability."""
    levels = agreement_levels(pairs)
    weight = (
        _weight("name_level", model.name_m, model.name_u)
        + _weight("born_level", model.year_m, model.year_u)
        + _weight("died_level", model.year_m, model.year_u)
    )
    odds = F.lit(model.prior / (1 - model.prior)) * F.pow(F.lit(2.0), F.col("weight"))
    return levels.withColumn("weight", weight).withColumn("p", odds / (1 + odds))


def agreement_patterns(pairs: DataFrame) -> DataFrame:
    """Pairs per agreement pattern: at most 64 rows, all that re-estimation needs."""
    return agreement_levels(pairs).groupBy("name_level", "born_level", "died_level").agg(
        F.count("*").alias("n")
    )


def reestimate(pairs: DataFrame, model: MatchModel = MatchModel(), rounds: int = 5) -> MatchModel:
    """Refine the model by expectation maximisation over the agreement patterns.

    Each round is one aggregate over the patterns, whose number is fixed.
    """
    patterns = agreement_patterns(pairs).cache()
    fields = {"name": "name_level", "born": "born_level", "died": "died_level"}
    for _ in range(rounds):
        weight = (
            _weight("name_level", model.name_m, model.name_u)
            + _weight("born_level", model.year_m, model.year_u)
            + _weight("died_level", model.year_m, model.year_u)
        )
        odds = F.lit(model.prior / (1 - model.prior)) * F.pow(F.lit(2.0), weight)
        scored = patterns.withColumn("hit", F.col("n") * odds / (1 + odds)).withColumn(
            "miss", F.col("n") - F.col("hit")
        )
        sums = {
            f"{f}{i}{side}": F.coalesce(F.sum(F.when(F.col(level) == i, F.col(side))), F.lit(0.0))
            for f, level in fields.items()
            for i in range(3)
            for side in ("hit", "miss")
        }
        row = scored.agg(
            F.sum("hit").alias("hit"), F.sum("n").alias("n"),
            *[c.alias(n) for n, c in sums.items()],
        ).first()
        if not row["n"]:
            break

        def share(names: tuple[str, ...], side: str):
            counts = [sum(row[f"{f}{i}{side}"] for f in names) + 1e-6 for i in range(3)]
            return tuple(c / sum(counts) for c in counts)

        model = MatchModel(
            prior=min(max(row["hit"] / row["n"], 1e-9), 1 - 1e-9),
            name_m=share(("name",), "hit"),
            name_u=share(("name",), "miss"),
            year_m=share(("born", "died"), "hit"),
            year_u=share(("born", "died"), "miss"),
        )
    patterns.unpersist()
    return model


def split_candidates(
    scored: DataFrame, low: float = 0.5, high: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """Inferred ``same-as`` links above ``high``, the review queue between the bands."""
    same_as = scored.where(F.col("p") >= high).select(
        F.col("a").alias("subject_entity_id"),
        F.lit("same-as").alias("predicate"),
        F.col("b").alias("object_entity_id"),
        F.lit("inferred").alias("method"),
        F.col("p").alias("confidence_point"),
    )
    queue = scored.where((F.col("p") >= low) & (F.col("p") < high)).select(
        F.col("a").alias("entity_a"),
        F.col("b").alias("entity_b"),
        F.col("p").alias("score"),
        F.to_json(F.struct("similarity", "born_gap", "died_gap")).alias("features"),
        F.lit("queued").alias("state"),
    )
    return same_as, queue


def same_profile_links(member: DataFrame) -> DataFrame:
    """``a, b``: each entity of a profile linked to the profile's lowest entity."""
    return member.where(F.col("entity_id") != F.col("profile_id")).select(
        F.col("profile_id").alias("a"), F.col("entity_id").alias("b")
    ).distinct()


def entity_links(
    scored: DataFrame, member: DataFrame, low: float = 0.5, high: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """:func:`split_candidates` for all entities: members of one profile are linked to its lowest entity.

    They agree in all that was compared, so their links bear the score of full agreement.
    """
    same_as, queue = split_candidates(scored, low, high)
    inside = score_pairs(same_profile_links(member).withColumns(
        {"similarity": F.lit(1.0), "born_gap": F.lit(0), "died_gap": F.lit(None).cast("int")}
    ))
    of_one = split_candidates(inside, low, low)[0]
    # A pair found both ways is one link, by its better score.
    both = same_as.unionByName(of_one)
    keys = [c for c in both.columns if c != "confidence_point"]
    return both.groupBy(*keys).agg(F.max("confidence_point").alias("confidence_point")), queue


def er_quality(
    predicted: DataFrame, gold: DataFrame, threshold: float, member: DataFrame
) -> DataFrame:
    """Precision and recall of profile pairs ``a, b, p`` against entity pairs ``a, b, is_match``.

    ``member`` says which profiles an entity stands in. A pair is predicted when its entities share a profile or
    stand in two that score ``threshold``. Only labelled pairs count; a labelled match never proposed is a miss.
    """
    of = member.select("entity_id", "profile_id").distinct()
    sides = (
        gold.join(of.toDF("a", "_pa"), "a", "left").join(of.toDF("b", "_pb"), "b", "left")
        .withColumns({"_low": F.least("_pa", "_pb"), "_high": F.greatest("_pa", "_pb")})
    )
    sure = predicted.where(F.col("p") >= threshold).select(
        F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high"), F.lit(True).alias("_sure")
    )
    hit = (F.col("_pa") == F.col("_pb")) | F.col("_sure")
    both = (
        sides.join(sure, ["_low", "_high"], "left").groupBy("a", "b", "is_match")
        .agg(F.coalesce(F.bool_or(F.coalesce(hit, F.lit(False))), F.lit(False)).alias("said"))
    )
    tp = F.count_if(F.col("said") & F.col("is_match"))
    return both.agg(
        tp.alias("true_positives"),
        F.count_if(F.col("said") & ~F.col("is_match")).alias("false_positives"),
        F.count_if(~F.col("said") & F.col("is_match")).alias("false_negatives"),
        (tp / F.nullif(F.count_if("said"), F.lit(0))).alias("precision"),
        (tp / F.nullif(F.count_if("is_match"), F.lit(0))).alias("recall"),
    )
