"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and written as

    ### role: text</turn>

one block for each run of turns of one role, whose texts stand apart by ``<+>``. In roles and texts a
backslash, ``#``, ``<`` and ``:`` (in roles) are escaped, so no text can forge a mark and every turn is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE, BETWEEN = "### ", ": ", "</turn>\n", "<+>"
LEARNED_ROLE = "assistant"
_ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in _ESCAPES if role else _ESCAPES[:3]:
        text = _replace(text, plain, code)
    return text


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`: between double backslashes, a backslash starts a code."""
    def decoded(part: Column) -> Column:
        for plain, code in _ESCAPES[1:]:
            part = _replace(part, code, plain)
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), decoded), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, segments, formatted`` per conversation of ``turns`` (``conv_id, turn, role, text``).

    ``segments`` are ``(piece, loss)`` structs in order; ``formatted`` is their pieces joined, and ``loss`` marks the
    escaped texts of assistant turns, which are to be learned. Turns sort by turn, role and text, nulls first; ties and
    repeated rows all stay. A null role or text is empty; rows without ``conv_id`` are one conversation. Other
    columns are ignored; an empty table gives no rows.
    """
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ))).alias("turns"))

    def turn(i: Column) -> Column:
        return F.element_at("turns", i.cast("int"))

    n = F.size("turns")
    # Where a run of one role begins; each run is merged by aggregation over its slice.
    starts = sorted_turns.withColumn("starts", F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (turn(i)["role"] != turn(F.greatest(i - 1, F.lit(1)))["role"]),
    ))

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("piece"), loss.alias("loss"))

    def block(start: Column, end: Column) -> Column:
        role, run = turn(start)["role"], F.slice("turns", start, end - start)
        texts = F.flatten(F.transform(run, lambda t, i: F.array(
            segment(F.when(i == 0, F.lit("")).otherwise(F.lit(BETWEEN)), F.lit(False)),
            segment(escaped(t["text"]), t["role"] == LEARNED_ROLE),
        )))
        return F.concat(
            F.array(segment(F.concat(F.lit(OPEN), escaped(role, True), F.lit(COLON)), F.lit(False))),
            texts, F.array(segment(F.lit(CLOSE), F.lit(False))),
        )

    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(n + 1))
    built = starts.select(
        "conv_id",
        F.filter(
            F.flatten(F.zip_with("starts", ends, block)), lambda s: (s["piece"] != "") | s["loss"]
        ).alias("segments"),
    )
    return built.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted")
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        colon = F.locate(COLON, block)
        role = unescaped(F.substring(block, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1))
        body = F.substring(block, colon + len(COLON), F.char_length(block))
        return F.transform(
            F.split(body, r"<\+>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the output: counts and hashes of turns and of the text under the loss mask."""
    read = formatted.select(
        "conv_id", read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(
            F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["piece"])
        ), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS opens,
    length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS size,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS role_size
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN opens THEN role_size + 14 ELSE 3 END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""
