"""MinHash near duplicates by an inverted join over signature coordinates.

Every document class (equal shingle sets) is posted under (coordinate, value) pairs of its MinHash
signature. Two sets at the similarity threshold agree in at least ``MATCHES`` of ``COORDINATES``
values but for about one pair in a million, so a class needs posting only under its rarest pairs (prefix), and
the collisions in the longer lists are counted from the signatures (skip). Candidates are confirmed
on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.components import components
from claimgraph.llm.scratch import Scratch
from claimgraph.llm.words import chunks, mix, per_row, words_of

COORDINATES = 32
MATCHES = 14
PARITY_BITS = 1024
SHINGLE_WORDS = 2
SIMILARITY = 80  # hundredths of intersection over union
_DESCRIBED = (
    "doc_id long, n_shingles long, high long, low long, signature array<int>, parity array<bigint>"
)
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of each text's slice.

    A text with fewer words than ``size`` has its whole word sequence as the one shingle; a text
    without words has none.
    """
    w = words_of(column, lower=True)
    n_words = np.diff(w.first)
    out, first = [], [0]
    rolled = w.hash * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
    for step in range(1, size):
        shifted = np.roll(w.hash, -step)
        rolled = mix(rolled ^ np.uint64(step)) + shifted * np.uint64(0xD6E8FEB86659FD93)
    rolled = mix(rolled)
    for row, n in enumerate(n_words):
        at = w.first[row]
        if n >= size:
            own = np.unique(rolled[at : at + n - size + 1])
        elif n:
            whole = np.uint64(n)
            for h in w.hash[at : at + n]:
                whole = mix(np.array([whole ^ h], dtype=np.uint64))[0]
            own = np.array([whole], dtype=np.uint64)
        else:
            own = np.empty(0, dtype=np.uint64)
        out.append(own)
        first.append(first[-1] + len(own))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(first)


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (rows x COORDINATES, 32 bits) of shingle sets."""
    out = np.empty((len(first) - 1, COORDINATES), dtype=np.uint32)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = per_row((sets * factor) >> np.uint64(32), first, np.minimum, 0)
    return out


def parities(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1024 bits per set (16 longs): each shingle flips one, so two sets differ in at least as many shingles
    as their bits differ in places. That bound rejects most candidates without a look at the sets."""
    n = len(first) - 1
    out = np.empty((n, PARITY_BITS // 64), dtype=np.int64)
    cell = (sets >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    for a in range(0, n, 2048):
        b = min(n, a + 2048)
        row = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
        odd = np.bincount(row * PARITY_BITS + cell[first[a] : first[b]], minlength=(b - a) * PARITY_BITS) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, -1), axis=1).view(np.int64)
    return out


def _near_enough(similarity: int):
    """Whether the parities and sizes of ``a`` and ``b`` allow the similarity; exact, it rejects no link."""
    differing = sum(
        (F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)),
        F.lit(0),
    )
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    return (
        (F.lit(100) * F.least("n_shingles_a", "n_shingles_b") >= F.lit(similarity) * F.greatest("n_shingles_a", "n_shingles_b"))
        & (differing * (100 + similarity) <= total * (100 - similarity))
    )


def _describe(size: int):
    def batches(stream):
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                sets, first = shingle_sets(rows["text"], size)
                high = per_row(mix(sets), first, np.add, 0)
                low = per_row(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, np.add, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"],
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(
                            pa.array(signatures(sets, first).ravel().view(np.int32)), COORDINATES
                        ).cast(pa.list_(pa.int32())),
                        pa.FixedSizeListArray.from_arrays(
                            pa.array(parities(sets, first).ravel()), PARITY_BITS // 64
                        ).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "high", "low", "signature", "parity"],
                )

    return batches


def _sets(size: int):
    def batches(stream):
        last = None  # rows arrive sorted by id after the join: a repeated row is passed over
        for batch in stream:
            for a, b in chunks(batch["text"]):
                rows = batch.slice(a, b - a)
                sets, first = shingle_sets(rows["text"], size)
                names, own = [], []
                for rep, s, e in zip(rows["rep"].to_pylist(), first[:-1], first[1:], strict=True):
                    found = (rep, sets[s:e].tobytes())
                    if found != last:
                        names.append(rep)
                        own.append(found[1])
                    last = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(own, pa.binary())], ["rep", "shingles"]
                )

    return batches


def _confirm(similarity: int):
    def batches(stream):
        for batch in stream:
            keep = []
            for a, b in zip(batch["set_a"], batch["set_b"], strict=True):
                x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return batches


def _collisions(matches: int):
    def batches(stream):
        for batch in stream:
            a = batch["sig_a"].flatten().to_numpy()
            b = batch["sig_b"].flatten().to_numpy()
            same = (a.reshape(-1, COORDINATES) == b.reshape(-1, COORDINATES)).sum(1)
            yield batch.select(["u", "v"]).filter(pa.array(same >= matches))

    return batches


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """Each class under the rarest of its shared coordinate values, as many as the prefix needs."""
    values = classes.select("rep", "n_shingles", F.posexplode("signature").alias("k", "value"))
    # A value that one class alone has matches nothing and takes its place in the prefix.
    frequent = values.groupBy("k", "value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(frequent, ["k", "value"])
    own = shared.groupBy("rep", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("df", "k", "value"))).alias("own"),
        F.sum(F.log("df")).alias("centre"),
    ).where(F.size("own") >= matches)
    return own.select(
        "rep", "n_shingles", "centre",
        F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1)).alias("p"),
    ).select("rep", "n_shingles", "centre", "p.k", "p.value")


def _collided():
    """The coordinates in which the signatures of ``a`` and ``b`` agree, as bits."""
    bits = F.lit(0).cast("long")
    for k in range(COORDINATES):
        same = F.col("signature_a")[k] == F.col("signature_b")[k]
        bits = bits.bitwiseOR(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    similarity: int = SIMILARITY,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``docs`` needs ``doc_id`` (integer) and ``text``; further columns are ignored. Two documents are
    linked if ``100 * |A and B| >= similarity * |A or B|`` for their sets of ``size``-word shingles (A-Z in
    lower case). ``component_id`` is the smallest id that links reach, ``kept`` whether it is the row's
    own. Null, empty and blank texts have no shingle and link with nothing. Rows of one id are one
    document: all of them get what any of their texts reaches. A row without an id is not linked, its
    component is null and it is kept. An empty table gives no rows.

    Equal sets are one class, so thousands of copies cost one posting. In each list the members are
    first tried against the most central one; what that links is one component, and only pairs of
    different components are tried after it. So a large group of near copies takes a number of tries near its size,
    and no link between components is lost.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select("doc_id", "text")
    described = scratch.write(
        texts.mapInArrow(
            _describe(size), _DESCRIBED
        ),
        "signatures",
    )
    named = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["high", "low", "n_shingles"]
    classes = scratch.write(
        named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("parity").alias("parity")),
        "classes",
    )
    # Sets whose sizes the threshold still allows lie at most one band apart.
    posted = scratch.write(
        _postings(classes, matches).withColumn(
            "band", F.floor(F.log("n_shingles") / (F.log(F.lit(100 / similarity)) + 1e-9))
        ),
        "postings",
    )
    in_list = ["k", "value", "band"]
    listed = posted.withColumn("own", F.lit(True)).unionByName(
        posted.withColumn("band", F.col("band") + 1).withColumn("own", F.lit(False))
    )
    hubs = posted.groupBy(*in_list).agg(
        F.max_by("rep", F.struct("centre", -F.col("rep"))).alias("hub")
    )
    stars = (
        listed.join(hubs, in_list)
        .where("rep <> hub")
        .select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v"))
        .distinct()
    )

    def confirmed(counted: DataFrame, name: str) -> DataFrame:
        """The pairs that are links by the full sets of those they name."""
        wanted = counted.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
        sets = scratch.write(
            texts.join(wanted, texts.doc_id == wanted.rep)
            .select("rep", "text")
            .mapInArrow(_sets(size), "rep long, shingles binary"),
            f"{name}-sets",
        )
        sure = scratch.write(
            counted.join(sets.toDF("u", "set_a"), "u").join(sets.toDF("v", "set_b"), "v")
            .mapInArrow(_confirm(similarity), "u long, v long").distinct(),
            f"{name}-links",
        )
        scratch.drop(f"{name}-sets")
        return sure

    a = classes.select(F.col("rep").alias("u"), *(F.col(c).alias(f"{c}_a") for c in ("n_shingles", "parity", "signature")))
    b = classes.select(F.col("rep").alias("v"), *(F.col(c).alias(f"{c}_b") for c in ("n_shingles", "parity", "signature")))
    to_hub = scratch.write(
        stars.join(a, "u").join(b, "v").where(_near_enough(similarity))
        .select("u", "v", F.col("signature_a").alias("sig_a"), F.col("signature_b").alias("sig_b"))
        .mapInArrow(_collisions(matches), "u long, v long").distinct(),
        "to-hub",
    )

    # An id that has several texts ties their classes together.
    members = scratch.write(
        described.drop("signature", "parity").join(classes.drop("signature", "parity"), key, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")),
        "members",
    )
    several_texts = (
        members.where("rep IS NOT NULL").groupBy("doc_id")
        .agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last")
    )
    same_id = members.join(several_texts, "doc_id").select(F.col("rep").alias("u"), "v")
    around = components(confirmed(to_hub, "star").unionByName(same_id))

    # A list that holds one component is done. In the others the members outside the central member's
    # component meet all members, so the pairs inside a large component are never formed.
    placed = listed.join(around.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    open_lists = (
        placed.groupBy(*in_list)
        .agg(
            F.min("component").alias("one"), F.max("component").alias("two"),
            F.max_by("component", F.struct("centre", -F.col("rep"))).alias("main"),
        )
        .where("one < two").select(*in_list, "main")
    )
    in_open = placed.join(open_lists, in_list).select("rep").distinct()
    # The coordinates that a class is posted under, as bits: two classes share a list where both are and agree.
    described_by = (
        posted.join(in_open, "rep", "left_semi").groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("under"))
        .join(classes.select("rep", "parity", "signature"), "rep")
    )
    opened = scratch.write(
        placed.join(open_lists, in_list)
        .select(*in_list, "own", "rep", "n_shingles", "component", (F.col("component") != F.col("main")).alias("out"))
        .join(described_by, "rep"),
        "open-lists",
    )
    sides = ("own", "rep", "n_shingles", "component", "out", "under", "parity", "signature")
    a = opened.where("out").select(*in_list, *(F.col(c).alias(f"{c}_a") for c in sides))
    b = opened.select(*in_list, *(F.col(c).alias(f"{c}_b") for c in sides))
    apart = F.expr("component_a <> component_b AND (NOT out_b OR rep_a < rep_b) AND (own_a OR own_b)")
    # A pair may share many lists and is met in the first of them alone.
    shared = _collided().bitwiseAND(F.col("under_a")).bitwiseAND(F.col("under_b"))
    once = shared.bitwiseAND(-shared) == F.call_function("shiftleft", F.lit(1).cast("long"), a["k"])
    # All tests are part of the join: only pairs of like sizes, parities and signatures leave it, each once.
    crossing = scratch.write(
        a.join(b, [
            *(a[c] == b[c] for c in in_list), apart, _near_enough(similarity), F.bit_count(_collided()) >= matches, once,
        ])
        .select(F.least("rep_a", "rep_b").alias("u"), F.greatest("rep_a", "rep_b").alias("v")),
        "crossing",
    )
    crossed = confirmed(crossing, "cross")
    scratch.drop("signatures", "classes", "postings", "open-lists", "to-hub", "crossing")
    found = components(around.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(crossed))
    return (
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
