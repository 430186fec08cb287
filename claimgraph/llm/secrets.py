"""Secret scan over a trigram inverted index, with Spark expressions only.

Every rule's regular expression gives a Boolean trigram query: which trigrams a text must hold for the
rule to match. The trigrams that some rule asks for are posted by document, each clause
intersects its postings, and only the documents left are verified with the expression itself. A rule
without mandatory trigrams is tried on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # pragma: no cover - older interpreters
    import sre_constants as sre
    import sre_parse as sre_parser

MOST_STRINGS = 64
BLOCK = 100  # matches of a text that are placed together
_SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` may have one group, the value; ``least`` is the length its value (or match) must have."""

    kind: str
    pattern: str
    least: int
    base: bool = False


_KEYWORDS = "|".join(
    [*map(_any_case, ("password", "passwd", "secret", "token")), f"{_any_case('api')}_?{_any_case('key')}"]
)
#: What follows a key's header: all up to its END line; where that is missing, the base64 block (which ends in a
#: long run) and a short last line. Classes and short repeats alone, so that long texts need no deep recursion.
_KEY_BODY = (
    r"(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\x20\t\r\n\\rn]+(?:Proc-Type|DEK-Info|Key-Info|Content-Domain):\x20*[A-Za-z0-9,-]*){0,9}"
    r"(?:[A-Za-z0-9+/=\x20\t\r\n\\\x22\x27]*[A-Za-z0-9+/=]{16})?"
    r"(?:[\x20\t\r\n\\]+[A-Za-z0-9+/]{1,64}={1,2}|[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/]{1,64}(?:[\r\n]|$))?)"
)
RULES = (
    Rule("assign", rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, True),  # runs are maximal, so a shorter run is no match
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_BODY, 20),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
)


def _strings(node) -> set[str] | None:
    """The few lower-case strings a node can match, or None if they are many."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        found: set[str] = set()
        for part, x in value:
            if part is sre.LITERAL:
                found.add(chr(x).lower())
            elif part is sre.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is sre.SUBPATTERN:
        return _joined(list(value[-1]))
    if kind is sre.BRANCH:
        options = [_joined(list(x)) for x in value[1]]
        return None if None in options else set().union(*options)
    if kind is sre.MAX_REPEAT and value[0] == 0 and value[1] == 1:
        inner = _joined(list(value[2]))
        return None if inner is None else inner | {""}
    return None


def _joined(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _clauses(strings: set[str]) -> set[frozenset[str]]:
    """One clause of trigrams for each string; a string under three characters asks for nothing."""
    return {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}


def _all_of(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    """Either side must hold; a clause that another one implies is left out."""
    both = {x | y for x in a for y in b}
    return {x for x in both if not any(y < x for y in both)}


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams; one of them must be wholly in any text that matches.

    ``{frozenset()}`` means that no trigram is mandatory.
    """
    query, run = {frozenset()}, {""}

    def walk(nodes):
        nonlocal query, run
        for node in nodes:
            strings = _strings(node)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, strings)}
                continue
            query, run = _all_of(query, _clauses(run)), strings or {""}
            if strings is None and node[0] is sre.MAX_REPEAT and node[1][0] >= 1:
                walk(list(node[1][2]))
                query, run = _all_of(query, _clauses(run)), {""}
            elif strings is None and node[0] is sre.SUBPATTERN:
                walk(list(node[1][-1]))
                query, run = _all_of(query, _clauses(run)), {""}

    walk(list(sre_parser.parse(pattern)))
    return _all_of(query, _clauses(run))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """``(start, no, end, kind)`` of the rule's matches in code points, those that are too short left out."""
    whole = f"({rule.pattern})"
    value = F.lit(2 if re.compile(whole).groups == 2 else 1)
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("m"),
        F.regexp_extract_all(text, F.lit(whole), value).alias("v"),
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.greatest(F.lit(0), F.size(F.split(text, rule.pattern, -1)) - 1)).alias("g"),
    )
    lengths = F.transform(
        found,
        lambda x: F.struct(
            F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("size"),
            (F.char_length(x["v"]) >= rule.least).alias("good"),
        ),
    )
    # A list that grows by one copies itself each time, so matches are placed a block at a time: first how long each
    # block is, then where it begins, then its spans.
    def in_blocks(rows: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(rows, b * BLOCK + 1, BLOCK),
        )

    def begins(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
            lambda s, block: F.struct(
                (s["at"] + F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])).alias("at"),
                F.concat(s["begins"], F.array(s["at"])).alias("begins"),
            ),
        )["begins"]

    def placed(block: Column, begin: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.when(
                    x["good"],
                    F.concat(s["spans"], F.array(F.struct(
                        (s["at"] + x["gap"]).alias("start"), F.lit(number).alias("no"),
                        (s["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"),
                    ))),
                ).otherwise(s["spans"]).alias("spans"),
            ),
        )["spans"]

    # An array of one names its content, so that it is worked out once and not for every block.
    blocks = F.transform(F.array(lengths), in_blocks)
    spans = F.flatten(F.transform(blocks, lambda b: F.flatten(F.zip_with(b, begins(b), placed))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPANS))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, rules)``: by their trigrams, the documents that each rule may match."""
    clauses = [
        (no, c, trigrams)
        for no, rule in enumerate(rules)
        for c, trigrams in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
        if trigrams
    ]
    asked = sorted({t for *_, trigrams in clauses for t in trigrams})
    spark = docs.sparkSession
    # As many rows as the rules have trigrams, whatever the size of the documents.
    queries = F.broadcast(spark.createDataFrame(
        [(asked.index(t), no, c, len(trigrams)) for no, c, trigrams in clauses for t in trigrams],
        "trigram int, rule int, clause int, needed int",
    ))
    # Lowered in a projection of its own, so that it is done once and not for every trigram.
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(
        F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(asked)
    )))
    postings = low.select("doc_id", F.explode(held).alias("trigram"))
    met = (
        postings.join(queries, "trigram")
        .groupBy("doc_id", "rule", "clause", "needed")
        .agg(F.size(F.collect_set("trigram")).alias("have"))
        .where("have = needed")
    )
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _marked(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``docs`` with the sorted spans of each text as ``__spans``."""
    may = candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)
    may = may.select(F.col("doc_id").alias("__id"), F.col("rules").alias("__rules"))
    text, none = F.coalesce(docs["text"], F.lit("")), F.array().cast(_SPANS)
    each = [
        _spans(text, i, r) if frozenset() in trigram_query(r.pattern)
        else F.when(F.array_contains("__rules", i), _spans(text, i, r)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return docs.join(may, docs["doc_id"].eqNullSafe(F.col("__id")), "left").select(
        *(docs[c] for c in docs.columns), F.array_sort(F.concat(*each)).alias("__spans")
    )


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs`` (``doc_id, text``): sorted (start, no, end, kind) structs.

    Matches are leftmost and non-overlapping per kind, in code points with the end exclusive. A null or
    empty text has no span. Repeated rows and rows without an id get their own spans; other columns
    are ignored, and an empty table gives no rows.
    """
    marked = _marked(docs.select("doc_id", "text"), rules)
    return marked.select("doc_id", F.col("__spans").alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of base kinds, the hash of base spans and the text of all spans."""
    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    base = [i for i, r in enumerate(rules) if r.base]

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["no"] == no)).cast("long")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{rules[i].kind}") for i in base),
        F.sha2(listed(F.filter("spans", lambda s: s["no"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``<KIND>``; all rows and other columns stay.

    ``n_chars``, where there is one, is counted anew. Spans that overlap go together, under the kind that
    starts first. A null text stays null.
    """
    marked = _marked(docs, rules)
    text = F.col("text")
    state = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] < s["at"],
            F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")),
        ).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(
                s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]),
                F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")),
            ).alias("out"),
        )),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    out = marked.withColumn("text", F.when(F.size("__spans") > 0, state).otherwise(text)).drop("__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest in SQL: matches with the gaps between them, every rule on every text."""
    parts, base = [], [r.kind for r in rules if r.base]
    for no, rule in enumerate(rules):
        whole = f"({rule.pattern})".replace("'", "''")
        value = 2 if re.compile(whole).groups == 2 else 1
        parts.append(f"""
  SELECT doc_id, {no} AS no, '{rule.kind}' AS kind, s AS start, s + length(m) AS "end" FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1),
      lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{whole}', 1) AS ms, regexp_extract_all(t, '{whole}', {value}) AS vs,
      regexp_split_to_array(t, '{rule.pattern.replace("'", "''").replace("(", "(?:").replace("(?:?:", "(?:")}') AS gs
      FROM t WHERE regexp_matches(t, '{rule.pattern.replace("'", "''")}'))) WHERE length(v) >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (no = {i}) AS n_{k}" for i, k in enumerate(base))
    zeros = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    listed = "kind || ':' || start || ':' || \"end\", ',' ORDER BY start, no, \"end\""
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT doc_id, {counts}, string_agg({listed}) FILTER (no < {len(base)}) AS b, string_agg({listed}) AS spans
  FROM s GROUP BY 1)
SELECT doc_id, {zeros}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""
