"""Chat formatting with a loss mask. DataFrame functions alone.

The turns of a conversation are collected as structs and sorted; neighbours of one role share a
header; texts are joined with control strings that escaped text can't contain.

    ### user
    first text</turn>second text of the same role</turn>
    ### assistant
    reply</turn>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepline.llm.common import bound

HEAD, END = "### ", "</turn>"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
NEWLINE = ("\n", "\\n")


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    """No '#' and no '<' is left, and every backslash is followed by b, h or l."""
    return _replace(text, ESCAPES)


def unescape(text: Column) -> Column:
    return _replace(text, [(new, old) for old, new in reversed(ESCAPES)])


def _escape_role(role: Column) -> Column:
    return _replace(role, [*ESCAPES, NEWLINE])


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE[1]), F.lit(NEWLINE[0])))


def _new_block(turns: Column, i: Column) -> Column:
    return (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])


def _formatted(turns: Column) -> Column:
    def blocks(both: Column) -> Column:
        starts, turns = both["starts"], both["turns"]

        def block(k: Column) -> Column:
            start = F.get(starts, k)
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            texts = F.transform(
                F.sequence(start, end - 1), lambda j: F.concat(escape(F.get(turns, j)["text"]), F.lit(END))
            )
            role = _escape_role(F.get(turns, start)["role"])
            return F.concat(F.lit(HEAD), role, F.lit("\n"), F.array_join(texts, ""), F.lit("\n"))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(starts) - 1), block), "")

    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: _new_block(turns, i))
    return bound(F.struct(starts.alias("starts"), turns.alias("turns")), blocks)


def _mask(turns: Column, role: str) -> Column:
    """Runs (loss, length) over the whole formatted text: before each turn's text, then the text."""

    def runs(t: Column, i: Column) -> Column:
        head = F.when(
            _new_block(turns, i), F.length(_escape_role(t["role"])) + (len(HEAD) + 1) + F.when(i > 0, 1).otherwise(0)
        ).otherwise(0)
        lead = head + F.when(i > 0, len(END)).otherwise(0)
        return F.array(
            F.struct(F.lit(False).alias("loss"), lead.cast("int").alias("length")),
            F.struct((t["role"] == role).alias("loss"), F.length(escape(t["text"])).alias("length")),
        )

    last = F.array(F.struct(F.lit(False).alias("loss"), F.lit(len(END) + 1).alias("length")))
    return F.concat(F.flatten(F.transform(turns, runs)), last)


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(id, formatted, mask), one row per conversation.

    Turns are ordered by turn, then role, then text; a null turn comes first. Null roles and texts
    are empty. Repeated rows are turns of their own. Rows without an id are one conversation. Roles
    and texts may hold anything, control strings included. One conversation is one row, so it has to
    fit in memory; no more than that meets in a task. No rows give no rows; only the four columns are
    looked at.
    """
    rows = turns.select(
        turns[id_col].alias("conv"),
        F.struct(
            turns[turn_col].alias("turn"),
            F.coalesce(turns[role_col], F.lit("")).alias("role"),
            F.coalesce(turns[text_col], F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return sorted_turns.select(
        F.col("conv").alias(id_col),
        bound(F.col("turns"), _formatted).alias("formatted"),
        bound(F.col("turns"), lambda t: _mask(t, loss_role)).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def block(b: Column) -> Column:
        role = _unescape_role(F.substring_index(b, "\n", 1))
        rest = F.substr(b, F.instr(b, "\n") + 1)
        texts = F.split(rest, END, -1)
        return bound(
            F.struct(role.alias("role"), texts.alias("texts")),
            lambda x: F.transform(
                F.slice(x["texts"], F.lit(1), F.size(x["texts"]) - 1),
                lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text")),
            ),
        )

    blocks = F.split(formatted, HEAD, -1)
    return F.flatten(bound(blocks, lambda bs: F.transform(F.slice(bs, F.lit(2), F.size(bs) - 1), block)))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    def picked(both: Column) -> Column:
        parts, mask = both["parts"], both["mask"]

        def text(i: Column) -> Column:
            run = F.get(mask, 2 * i + 1)
            return F.when(run["loss"], F.right(F.get(parts, i), run["length"])).otherwise("")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(parts) - 2), text), "")

    parts = F.split(formatted, END, -1)
    return unescape(bound(F.struct(parts.alias("parts"), mask.alias("mask")), picked))
