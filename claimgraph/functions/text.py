"""Names, trigrams and canonical JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """Collapse runs of white space, Unicode spaces included, and trim."""
    return F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))


def canonical_json(raw: Column) -> Column:
    """JSON text with sorted keys and tight separators."""
    return F.to_json(F.try_parse_json(raw))


def _ascii_escape(text: Column) -> Column:
    def escape(ch: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(ch.rlike(r"^[\x00-\x7f]$"), ch).otherwise(units)

    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escape), ""))


def content_hash(raw: Column, style: str = "record") -> Column:
    """Hash of the canonical JSON of a source record.

    ``record``: ``sha256:`` and 64 hex digits. ``letter``: the first 16 hex digits,
    taken over the ASCII-escaped text.
    """
    text = canonical_json(raw)
    if style == "record":
        return F.concat(F.lit("sha256:"), F.sha2(text, 256))
    if style == "letter":
        return F.substring(F.sha2(_ascii_escape(text), 256), 1, 16)
    raise ValueError(f"unknown hash style {style!r}")


def literal_value(literal: Column) -> Column:
    """Text of the ``value`` field of a literal stored as JSON."""
    return F.get_json_object(literal, "$.value")


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of lower-cased alphanumeric words, each padded ``'  w '``."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
            ),
        )
    )
    return F.array_distinct(grams)


def shared_grams(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def gram_similarity(a: Column, b: Column) -> Column:
    """Shared over total distinct grams of two gram arrays; 0 when both are empty."""
    both = shared_grams(a, b)
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(0.0)).otherwise(both / total)


def trigram_similarity(a: Column, b: Column) -> Column:
    return gram_similarity(trigrams(a), trigrams(b))


def windows_of(text: Column, width) -> Column:
    """Distinct substrings of ``width`` characters of the lower-cased text."""
    low = F.lower(text)
    return F.when(
        F.length(low) >= width,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(low) - width + 1),
                lambda i: F.substring(low, i, F.lit(width)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))
