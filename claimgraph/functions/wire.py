"""Fragments of canonical JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member(key: str, value: Column, present: Column | None = None) -> Column:
    """``"key":value`` with a JSON null for NULL; nothing at all when not present."""
    text = F.to_json(F.struct(value.alias(key)), {"ignoreNullFields": "false"})
    out = F.substring(text, F.lit(2), F.length(text) - 2)
    return out if present is None else F.when(present, out)


def raw_member(key: str, json_text: Column) -> Column:
    """A member whose value is JSON text already; left out when NULL."""
    return F.when(json_text.isNotNull(), F.concat(F.lit(f'"{key}":'), json_text))


def json_object(*members: Column) -> Column:
    """Members in the order given, absent ones left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
