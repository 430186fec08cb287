"""Letter records to interchange entities and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import content_hash, normalize_name
from claimgraph.functions.wire import json_object, member
from claimgraph.operators.people import claim_struct, entity_ref, literal
from claimgraph.schema import INTERCHANGE_ENTITY, SCHEMA_VERSION

PERSON = "gnd"
LETTER = "correspsearch"
DATE_KEYS = ("when", "notBefore", "notAfter", "from", "to")


def gnd_id(uri: Column) -> Column:
    """The text after the last ``gnd/``; NULL when there is none."""
    tail = F.trim(F.substring_index(uri, "gnd/", -1))
    return F.when(uri.contains("gnd/") & (tail != ""), tail)


def _present(value: Column) -> Column:
    return F.when(value != "", value)


def partial_date(value: Column, is_end: bool) -> Column:
    """A full, month or year date widened to a bound; NULL when it has no such form.

    The last day of a month is always the 28th.
    """
    text = F.trim(value)
    month_end, year_end = ("-28", "-12-31") if is_end else ("-01", "-01-01")
    rest = (
        F.when(text.rlike(r"^\d{4}$"), F.lit(year_end))
        .when(text.rlike(r"^\d{1,6}-\d{1,2}$"), F.lit(month_end))
        .when(text.rlike(r"^\d{1,6}-\d{1,2}-\d{1,2}$"), F.lit(""))
    )
    # The date cast wants four digits of year or more.
    padded = F.regexp_replace(F.concat(text, rest), r"^(\d{1,3})-", "0000$1-")
    return padded.try_cast("date")


def letter_interval(action: Column) -> Column:
    """Four bounds of one action's date, NULL when undated or unreadable.

    ``when`` outranks the ranged attributes; a half-open range fills its inner bounds
    from the side it has.
    """
    when = _present(action["when"])
    lower = F.coalesce(_present(action["notBefore"]), _present(action["from"]))
    upper = F.coalesce(_present(action["notAfter"]), _present(action["to"]))
    original = json_object(
        *[member(k, action[k], action[k].isNotNull()) for k in sorted(DATE_KEYS)]
    )
    first, last = partial_date(when, False), partial_date(when, True)
    se, el = partial_date(lower, False), partial_date(upper, True)

    def interval(*bounds: Column) -> Column:
        return F.struct(*bounds, F.lit(False), original, F.lit("both"))

    exact = F.when(first.isNotNull(), interval(first, last, first, last))
    ranged = interval(se, F.coalesce(el, se), F.coalesce(se, el), el)
    return F.when(when.isNotNull(), exact).when(lower.isNotNull() | upper.isNotNull(), ranged)


def _bad_when(action: Column) -> Column:
    when = _present(action["when"])
    return F.coalesce(when.isNotNull() & partial_date(when, False).isNull(), F.lit(False))


def _prepared(letters: DataFrame, slug: str) -> DataFrame:
    key = F.coalesce(_present(F.col("key")), _present(F.col("ref")), F.lit("unknown"))
    support = F.array(
        F.struct(
            F.lit(slug).alias("source"),
            F.lit("letter").alias("record_kind"),
            key.alias("external_id"),
            content_hash(F.col("raw"), "letter").alias("content_hash"),
            F.col("raw").alias("raw"),
        )
    )
    return letters.withColumns(
        {
            "_support": support,
            "_from": _present(F.col("sent.gnd")),
            "_to": _present(F.col("received.gnd")),
            "_key": _present(F.col("key")),
        }
    )


def letter_entities(letters: DataFrame) -> DataFrame:
    """Sender, receiver and the letter itself, each when identified."""
    def record(authority: str, key: Column, kind: str) -> Column:
        ref = entity_ref(authority, key)
        row = F.struct(F.lit(SCHEMA_VERSION), ref, F.lit(kind), F.array(ref))
        return F.when(key.isNotNull(), row.cast(INTERCHANGE_ENTITY))

    rows = F.array(
        record(PERSON, _present(F.col("sent.gnd")), "person"),
        record(PERSON, _present(F.col("received.gnd")), "person"),
        record(LETTER, _present(F.col("key")), "document"),
    )
    return letters.select(F.inline(F.array_compact(rows)))


def letter_label() -> Column:
    def who(action: str) -> Column:
        return normalize_name(F.coalesce(_present(F.col(f"{action}.name")), F.lit("?")))

    when = F.coalesce(
        _present(F.col("sent.when")),
        _present(F.col("sent.notBefore")),
        _present(F.col("received.when")),
    )
    dated = F.when(when.isNotNull(), F.concat(F.lit(" ("), when, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Letter: "), who("sent"), F.lit(" → "), who("received"), dated)


def _names() -> Column:
    def person(action: str, key: Column) -> Column:
        name = normalize_name(F.col(f"{action}.name"))
        claim = claim_struct(
            entity_ref(PERSON, key), "has-name", F.col("_support"), value=literal("string", name)
        )
        return F.when(key.isNotNull() & (name != ""), claim)

    document = claim_struct(
        entity_ref(LETTER, F.col("_key")), "has-name", F.col("_support"),
        value=literal("string", letter_label()),
    )
    return F.array(
        person("sent", F.col("_from")),
        person("received", F.col("_to")),
        F.when(F.col("_key").isNotNull(), document),
    )


def _ties() -> Column:
    """Sender to receiver, unscored, only when both are identified."""
    tie = claim_struct(
        entity_ref(PERSON, F.col("_from")), "corresponded-with", F.col("_support"),
        entity=entity_ref(PERSON, F.col("_to")),
        valid_time=F.coalesce(letter_interval(F.col("sent")), letter_interval(F.col("received"))),
        method_detail=json_object(member("direction", F.lit("sent")), member("letter", F.col("key"))),
    )
    return F.array(F.when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), tie))


def _emit(letters: DataFrame, slug: str, rows: Column) -> DataFrame:
    return _prepared(letters, slug).select(F.inline(F.array_compact(rows)))


def letter_names(letters: DataFrame, slug: str = LETTER) -> DataFrame:
    return _emit(letters, slug, _names())


def letter_ties(letters: DataFrame, slug: str = LETTER) -> DataFrame:
    return _emit(letters, slug, _ties())


def letter_claims(letters: DataFrame, slug: str = LETTER) -> DataFrame:
    """Names and ties of every letter in one pass."""
    return _emit(letters, slug, F.concat(_names(), _ties()))


def letter_counters(letters: DataFrame) -> DataFrame:
    """``counter, n``: missing ends, unreadable dates and undated ties."""
    sender, receiver = _present(F.col("sent.gnd")), _present(F.col("received.gnd"))
    tied = sender.isNotNull() & receiver.isNotNull()
    from_sent = letter_interval(F.col("sent"))
    undated = from_sent.isNull() & letter_interval(F.col("received")).isNull()
    bad_sent = tied & _bad_when(F.col("sent"))
    bad_received = tied & from_sent.isNull() & _bad_when(F.col("received"))
    counted = {
        "letter_missing_sender_gnd": F.count_if(sender.isNull()),
        "letter_missing_receiver_gnd": F.count_if(receiver.isNull()),
        "letter_bad_date": F.count_if(bad_sent) + F.count_if(bad_received),
        "letter_undated": F.count_if(tied & undated),
    }
    totals = letters.agg(*[c.alias(n) for n, c in counted.items()])
    rows = [F.struct(F.lit(n).alias("counter"), F.col(n).alias("n")) for n in counted]
    return totals.select(F.inline(F.array(*rows)))


def transform(letters: DataFrame, slug: str = LETTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, claims and counters of a letter source."""
    return letter_entities(letters), letter_claims(letters, slug), letter_counters(letters)
