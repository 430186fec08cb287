"""Checks of interchange lines and of stored claims.

Lines are parsed once into a variant; every rule is a column expression on it, so a
batch of any size is checked in one scan. Parts are closed: an unknown key is an
error, as is a missing one. The type of a line tells of most of its parts that they
are in order; only the rules of the others are examined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.temporal import DATE_FORM
from claimgraph.operators.ordered import once
from claimgraph.schema import BOUNDS, LITERAL_KINDS, METHODS, SCHEMA_VERSION

SLUG_FORM = "^[a-z][a-z0-9-]*$"
_CLAIM_NEEDS = (
    "schema_version", "subject", "predicate", "object", "confidence", "method", "asserted_by",
    "support",
)
_CLAIM_MAY = _CLAIM_NEEDS + ("valid_time", "method_detail")
_REF = ("authority", "id")
_REF_FORM = "OBJECT<authority: STRING, id: STRING>"
_SCORED = ("kind", "scale", "raw", "point", "calibrated")
_SUPPORT = ("source", "record_kind", "external_id", "content_hash", "raw")
_INTERVAL = BOUNDS + ("approximate", "original")


def _part(v: Column, path: str, dtype: str = "variant") -> Column:
    return F.try_variant_get(v, path, dtype)


def _type(v: Column, path: str = "$") -> Column:
    """Type name at a path; NULL when the path is absent."""
    return F.schema_of_variant(_part(v, path))


def _keys(v: Column, path: str = "$") -> Column:
    """Keys of the object at a path; NULL when it is absent or no object."""
    return F.map_keys(_part(v, path, "map<string,variant>"))


def _no(condition: Column) -> Column:
    """True where a condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def _is_text(v: Column, path: str) -> Column:
    return (_type(v, path) == "STRING") & (_part(v, path, "string") != "")


def _is_number(v: Column, path: str) -> Column:
    return _type(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _closed(keys: Column, needs, may=None) -> Column:
    """Keys hold everything needed and nothing that is not allowed."""
    has = F.array(*[F.lit(k) for k in needs])
    allowed = F.array(*[F.lit(k) for k in (may or needs)])
    return (F.size(F.array_except(has, keys)) == 0) & (F.size(F.array_except(keys, allowed)) == 0)


def _ref_ok(v: Column, path: str) -> Column:
    filled = _filled(_part(v, f"{path}.authority", "string"), _part(v, f"{path}.id", "string"))
    return (_type(v, path) == _REF_FORM) & filled


def _literal_ok(v: Column, path: str) -> Column:
    value = _type(v, f"{path}.value")
    plain = (value == "STRING") | (value == "BOOLEAN") | _is_number(v, f"{path}.value")
    authority = _type(v, f"{path}.authority")
    return (
        _closed(_keys(v, path), ("kind", "value"), ("kind", "value", "authority"))
        & _part(v, f"{path}.kind", "string").isin(*LITERAL_KINDS)
        & plain
        & (authority.isNull() | (authority == "STRING"))
    )


def _date_ok(v: Column, path: str) -> Column:
    """Absent, null, or a signed ISO date that the calendar knows."""
    kind, text = _type(v, path), _part(v, path, "string")
    real = (kind == "STRING") & text.rlike(DATE_FORM) & text.try_cast("date").isNotNull()
    return kind.isNull() | (kind == "VOID") | real


def _interval_ok(v: Column) -> Column:
    path = "$.valid_time"
    approximate = _type(v, f"{path}.approximate")
    ok = _closed(_keys(v, path), (), _INTERVAL) & (
        approximate.isNull() | (approximate == "BOOLEAN")
    )
    for bound in BOUNDS:
        ok = ok & _date_ok(v, f"{path}.{bound}")
    return ok


def _confidence_ok(v: Column) -> Column:
    path = "$.confidence"
    keys, kind = _keys(v, path), _part(v, f"{path}.kind", "string")
    point = _part(v, f"{path}.point", "double")
    scored = (
        (kind == "source_native_scalar")
        & _closed(keys, _SCORED)
        & (_type(v, f"{path}.scale") == "STRING")
        & _is_number(v, f"{path}.point")
        & point.between(0, 1)
        & (_type(v, f"{path}.calibrated") == "BOOLEAN")
        & ~_part(v, f"{path}.calibrated", "boolean")
    )
    return F.when(kind == "unscored", _closed(keys, ("kind",))).otherwise(scored)


def _support_ok(v: Column) -> Column:
    items = _part(v, "$.support", "array<variant>")

    def one(item: Column) -> Column:
        ok = _closed(_keys(item), _SUPPORT)
        for name in _SUPPORT[:-1]:
            ok = ok & _is_text(item, f"$.{name}")
        texts = _filled(*[_part(item, f"$.{name}", "string") for name in _SUPPORT[:-1]])
        plain = F.schema_of_variant(item).rlike(f"^{_record_form()}$") & texts
        return F.coalesce(plain, F.lit(False)) | F.coalesce(ok, F.lit(False))

    return (F.size(items) > 0) & F.forall(items, one)


def _absent(v: Column, path: str) -> Column:
    return _part(v, path).isNull()


def claim_rules(v: Column) -> list[tuple[str, Column]]:
    """Message and failure test of each rule, in the order they are reported."""
    keys = _keys(v)
    obj = _keys(v, "$.object")
    entity, lit = F.array_contains(obj, "entity"), F.array_contains(obj, "literal")
    return [
        ("not an object", keys.isNull()),
        ("a required key is missing", _no(
            F.size(F.array_except(F.array(*map(F.lit, _CLAIM_NEEDS)), keys)) == 0)),
        ("an unknown key is present", _no(
            F.size(F.array_except(keys, F.array(*map(F.lit, _CLAIM_MAY)))) == 0)),
        (f"schema_version is not {SCHEMA_VERSION}",
         _no(_part(v, "$.schema_version", "string") == SCHEMA_VERSION)),
        ("subject is not a reference", _no(_ref_ok(v, "$.subject"))),
        ("predicate is not a slug", _no(
            (_type(v, "$.predicate") == "STRING")
            & _part(v, "$.predicate", "string").rlike(SLUG_FORM))),
        ("object is not exactly one of entity and literal", _no((entity != lit) & (F.size(obj) == 1))),
        ("object entity is not a reference", F.coalesce(entity, F.lit(False)) & _no(_ref_ok(v, "$.object.entity"))),
        ("object literal is malformed", F.coalesce(lit, F.lit(False)) & _no(_literal_ok(v, "$.object.literal"))),
        ("valid_time is malformed", ~_absent(v, "$.valid_time") & _no(_interval_ok(v))),
        ("confidence is malformed", _no(_confidence_ok(v))),
        ("method is unknown", _no(_part(v, "$.method", "string").isin(*METHODS))),
        ("method_detail is not an object",
         ~_absent(v, "$.method_detail") & _keys(v, "$.method_detail").isNull()),
        ("asserted_by is blank", _no(_is_text(v, "$.asserted_by"))),
        ("support is empty or malformed", _no(_support_ok(v))),
    ]


def entity_rules(v: Column) -> list[tuple[str, Column]]:
    needs, may = ("schema_version", "ref", "entity_type"), ("external_ids",)
    keys = _keys(v)
    anchors = _part(v, "$.external_ids", "array<variant>")
    return [
        ("not an object", keys.isNull()),
        ("keys are missing or unknown", _no(_closed(keys, needs, needs + may))),
        (f"schema_version is not {SCHEMA_VERSION}",
         _no(_part(v, "$.schema_version", "string") == SCHEMA_VERSION)),
        ("ref is not a reference", _no(_ref_ok(v, "$.ref"))),
        ("entity_type is not text", _no(_type(v, "$.entity_type") == "STRING")),
        ("external_ids are malformed", ~_absent(v, "$.external_ids") & _no(
            F.forall(anchors, lambda a: F.coalesce(_ref_ok(a, "$"), F.lit(False))))),
    ]


# The layout of a claim line, keys in alphabetical order at every level. What may hold
# anything, or an explicit null, stays a variant.
TYPED_CLAIM = (
    "asserted_by string, "
    "confidence struct<calibrated boolean, kind string, point variant, raw variant, scale string>, "
    "method string, method_detail variant, "
    "object struct<entity struct<authority string, id string>, "
    "literal struct<authority string, kind string, value variant>>, "
    "predicate string, schema_version string, subject struct<authority string, id string>, "
    "support array<struct<content_hash string, external_id string, raw variant, "
    "record_kind string, source string>>, "
    f"valid_time struct<approximate boolean, {', '.join(f'{b} string' for b in BOUNDS)}, original variant>"
)


def _filled(*texts: Column) -> Column:
    ok = F.lit(True)
    for text in texts:
        ok = ok & text.isNotNull() & (text != "")
    return ok


def _any_form(depth: int = 4) -> str:
    """Pattern of the type of any value that nests no deeper. A quoted key is not in it, so it ends where it seems to."""
    inside = "[^<>`]*+"
    for _ in range(depth):
        inside = f"(?:[^<>`]++|<{inside}>)*+"
    return f"[A-Z]+(?:\\([0-9,]+\\))?(?:<{inside}>)?"


def _record_form() -> str:
    return (
        f"OBJECT<content_hash: STRING, external_id: STRING, raw: {_any_form()}, record_kind: STRING, source: STRING>"
    )


def _interval_form() -> str:
    parts = ["approximate: BOOLEAN", *[f"{b}: (?:STRING|VOID)" for b in BOUNDS], f"original: {_any_form()}"]
    return f"OBJECT<(?:(?:{'|'.join(parts)})(?:, |(?=>)))*>"


def _part_forms() -> dict[str, str]:
    """Pattern of the type of each part of a line, without unknown or missing keys or values of another type.

    Keys stand in alphabetical order. An array has the type that its items have in common, so a key that some of
    them lack needs a look.
    """
    anything, number = _any_form(), "(?:BIGINT|DECIMAL\\([0-9,]+\\)|DOUBLE|FLOAT)"
    scored = f"calibrated: BOOLEAN, kind: STRING, point: {number}, raw: {anything}, scale: STRING"
    literal = f"OBJECT<(?:authority: STRING, )?kind: STRING, value: (?:STRING|BOOLEAN|{number})>"
    return {
        "asserted_by": "STRING",
        "confidence": f"OBJECT<(?:kind: STRING|{scored})>",
        "method": "STRING",
        "method_detail": f"OBJECT{anything.removeprefix('[A-Z]+(?:\\([0-9,]+\\))?')}",
        "object": f"OBJECT<(?:entity: {_REF_FORM}|literal: {literal})>",
        "predicate": "STRING",
        "schema_version": "STRING",
        "subject": _REF_FORM,
        "support": f"ARRAY<{_record_form()}>",
        "valid_time": _interval_form(),
    }


def _marks(v: Column) -> Column:
    """What the type of a line tells of its parts, from one run of one pattern.

    ``=``, then for each part a comma, its letter, the first letter of its key if it is there, and the first of its
    type if that is in order; behind ``!`` a letter of an unknown key. A line that is no object, or has a key that
    is quoted in its type, or dozens of keys, gets no marks.
    """
    anything, parts, told = _any_form(), [], "="
    for n, (key, form) in enumerate(_part_forms().items()):
        parts.append(f"({key[0]}){key[1:]}: (?:({form[0]}){form[1:]}(?=, |>)|{anything})")
        told += f",{chr(65 + n)}${2 * n + 1}${2 * n + 2}"
    parts.append(f"([A-Za-z0-9_])[A-Za-z0-9_]*+: {anything}")
    told += f"!${2 * len(_part_forms()) + 1}"
    # No part is read a second way, so a type that does not match is given up at once.
    return F.regexp_replace(F.schema_of_variant(v), f"^OBJECT<(?:(?>{'|'.join(parts)})(?:, |(?=>))){{1,40}}+>$", told)


def _in_order(t: Column, marks: Column) -> list[Column]:
    """For each of :func:`claim_rules`: true only where the line keeps the rule, told without examining the part."""
    forms = _part_forms()
    letters = {key: chr(65 + n) for n, key in enumerate(forms)}

    def there(key: str) -> Column:
        return marks.contains(f",{letters[key]}{key[0]}")

    def mark(key: str, without: tuple[str, ...] = ()) -> str:
        return f",{letters[key]}" + ("" if key in without else f"{key[0]}{forms[key][0]}")

    # The marks of most lines are these, with or without the parts that need not be there.
    may = ("method_detail", "valid_time")
    wholes = ["=" + "".join(mark(k, less) for k in forms) + "!" for less in ((), may[:1], may[1:], may)]
    whole = marks.isin(*wholes)

    def plain(key: str) -> Column:
        return (F.lit(False) if key in may else whole) | marks.contains(mark(key))

    told = whole | marks.startswith("=")
    needed = whole | (told & reduce(and_, map(there, _CLAIM_NEEDS)))
    entity, lit, c, support = t["object"]["entity"], t["object"]["literal"], t["confidence"], t["support"]
    point = F.try_variant_get(c["point"], "$", "double")
    score = (c["kind"] == "source_native_scalar") & ~c["calibrated"] & point.between(0, 1)
    dates = F.lit(True)
    for bound in BOUNDS:
        text = t["valid_time"][bound]
        dates = dates & (text.isNull() | (text.rlike(DATE_FORM) & text.try_cast("date").isNotNull()))
    records = F.forall(support, lambda r: r["raw"].isNotNull())
    for name in _SUPPORT[:-1]:
        records = records & ~F.array_contains(support[name], "")  # NULL where a text is missing
    ok = [
        told,
        needed,
        whole | (told & marks.endswith("!")),
        t["schema_version"] == SCHEMA_VERSION,
        plain("subject") & _filled(t["subject"]["authority"], t["subject"]["id"]),
        plain("predicate") & t["predicate"].rlike(SLUG_FORM),
        plain("object"),
        plain("object") & (entity.isNull() | _filled(entity["authority"], entity["id"])),
        plain("object") & (lit.isNull() | lit["kind"].isin(*LITERAL_KINDS)),
        told & (~there("valid_time") | (plain("valid_time") & dates)),
        plain("confidence") & (((c["kind"] == "unscored") & c["calibrated"].isNull()) | score),
        plain("method") & t["method"].isin(*METHODS),
        told & (~there("method_detail") | plain("method_detail")),
        plain("asserted_by") & _filled(t["asserted_by"]),
        plain("support") & records,
    ]
    return [F.coalesce(o, F.lit(False)) for o in ok]


def plainly_valid(t: Column, v: Column) -> Column:
    """True only for valid claims: the type of the whole line and a few tests of values tell it of every rule."""
    return reduce(and_, _in_order(t, _marks(v)))


def _errors(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(text)) for text, failed in rules]))


_BROKEN = ["invalid JSON"]


def validate_claims(lines: DataFrame) -> DataFrame:
    """Add ``parsed``, ``typed`` and ``errors``, empty for a valid claim line."""
    v, t = F.col("parsed"), F.col("typed")
    read = once(
        once(lines, parsed=F.try_parse_json("line")), typed=_part(v, "$", f"struct<{TYPED_CLAIM}>"), _marks=_marks(v)
    )
    kept = {f"_kept_{n}": ok for n, ok in enumerate(_in_order(t, F.col("_marks")))}
    rules = [(text, ~F.col(k) & failed) for k, (text, failed) in zip(kept, claim_rules(v), strict=True)]
    errors = (
        F.when(v.isNull(), F.array(*map(F.lit, _BROKEN)))
        .when(reduce(and_, map(F.col, kept)), F.array().cast("array<string>"))
        .otherwise(_errors(rules))
    )
    return once(read.withColumns(kept), errors=errors).drop("_marks", *kept)


def validate_entities(lines: DataFrame) -> DataFrame:
    """Add ``parsed`` and ``errors``, empty for a valid entity line."""
    v = F.col("parsed")
    errors = F.when(v.isNull(), F.array(*map(F.lit, _BROKEN))).otherwise(_errors(entity_rules(v)))
    return once(once(lines, parsed=F.try_parse_json("line")), errors=errors)


def validation_report(checked: DataFrame) -> DataFrame:
    """Lines seen, lines that failed, and how often each error occurs, counted in one pass."""
    failed = F.when(F.size("errors") > 0, F.lit("failed lines"))
    items = F.concat(F.array_compact(F.array(F.lit("lines"), failed)), "errors")
    seen = checked.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    totals = F.explode(F.array(F.lit("lines"), F.lit("failed lines"))).alias("item")
    none = checked.sparkSession.range(1).select(totals, F.lit(0).cast("long").alias("n"))
    return seen.unionByName(none).groupBy("item").agg(F.sum("n").alias("n"))


def _text_at(path: str) -> Column:
    return _part(F.col("parsed"), path, "string")


def parse_claims(checked: DataFrame) -> DataFrame:
    """Lines as flat columns; JSON parts stay canonical JSON text.

    Invalid lines keep their ``errors``; what cannot be read of them is NULL.
    """
    t = F.col("typed")
    c, entity, lit = t["confidence"], t["object"]["entity"], t["object"]["literal"]
    scored = c["kind"] == "source_native_scalar"
    support = F.transform(
        t["support"],
        lambda s: F.struct(*[s[n].alias(n) for n in _SUPPORT[:-1]], F.to_json(s["raw"]).alias("raw")),
    )
    return checked.select(
        "line_no",
        "errors",
        t["subject"]["authority"].alias("subject_authority"),
        t["subject"]["id"].alias("subject_key"),
        t["predicate"].alias("predicate"),
        entity["authority"].alias("object_authority"),
        entity["id"].alias("object_key"),
        F.when(lit.isNotNull(), F.to_json(lit)).alias("object_literal"),
        *[t["valid_time"][b].try_cast("date").alias(b) for b in BOUNDS],
        F.coalesce(t["valid_time"]["approximate"], F.lit(False)).alias("approximate"),
        F.to_json(t["valid_time"]["original"]).alias("valid_time_original"),
        c["kind"].alias("confidence_kind"),
        F.when(scored, F.try_variant_get(c["point"], "$", "double")).alias("confidence_point"),
        F.when(scored, c["scale"]).alias("confidence_scale"),
        F.when(scored, F.to_json(c["raw"])).alias("confidence_raw"),
        t["method"].alias("method"),
        F.to_json(t["method_detail"]).alias("method_detail"),
        t["asserted_by"].alias("asserted_by"),
        support.alias("support"),
    )


def parse_entities(checked: DataFrame) -> DataFrame:
    anchors = F.transform(
        _part(F.col("parsed"), "$.external_ids", "array<variant>"),
        lambda a: F.struct(*[_part(a, f"$.{n}", "string").alias(n) for n in _REF]),
    )
    ref = F.struct(
        _text_at("$.ref.authority").alias("authority"), _text_at("$.ref.id").alias("id")
    )
    return checked.where(F.size("errors") == 0).select(
        "line_no",
        _text_at("$.ref.authority").alias("authority"),
        _text_at("$.ref.id").alias("external_id"),
        _text_at("$.entity_type").alias("entity_type"),
        F.array_distinct(
            F.concat(F.array(ref), F.coalesce(anchors, F.array().cast("array<struct<authority:string,id:string>>")))
        ).alias("anchors"),
    )


def check_claims(claims: DataFrame) -> DataFrame:
    """``claim_id, violation`` for each store rule a claim breaks."""
    scored, point = F.col("confidence_kind") != "unscored", F.col("confidence_point")
    se, sl, ee, el = (F.col(b) for b in BOUNDS)
    rules = [
        ("object is not exactly one of entity and literal",
         F.col("object_entity_id").isNotNull() == F.col("object_literal").isNotNull()),
        ("unscored claim carries a point", ~scored & point.isNotNull()),
        ("scored claim carries no point", scored & point.isNull()),
        ("start bounds are out of order", F.coalesce(se > sl, F.lit(False))),
        ("end bounds are out of order", F.coalesce(ee > el, F.lit(False))),
    ]
    return claims.select("claim_id", F.explode(_errors(rules)).alias("violation"))
