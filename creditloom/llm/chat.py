"""Chat formatting with Spark expressions: turns to one marked string with a loss mask, and back.

Template: every run of turns with the same role is a block ``<|im_start|>role\\n texts <|im_end|>\\n``, its texts
separated by ``<|im_next|>``. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control
string can come from a text; a line break in a role becomes ``\\!``. The loss mask covers the texts of assistant
turns and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of the escapes of texts and roles; doubled backslashes are told apart first, from the left."""

    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\|"), F.lit("|")), F.lit("\\!"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def _blocks(turns: Column) -> Column:
    """Runs of turns with the same role: (role, texts)."""

    def add(done: Column, turn: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(last["role"] == turn["role"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(fresh))
        )

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), add)


def _spans(blocks: Column) -> Column:
    """(start, end) in code points of every learned text in the formatted string."""

    def block(state: Column, b: Column) -> Column:
        head = state["at"] + len(START) + F.length(b["role"]) + 1

        def text(inner: Column, t: Column) -> Column:
            end = inner["at"] + F.length(t)
            span = F.array(F.struct(inner["at"].alias("start"), end.alias("end")))
            spans = F.when(b["role"] == LEARNED, F.concat(inner["spans"], span)).otherwise(inner["spans"])
            return F.struct((end + len(NEXT)).alias("at"), spans.alias("spans"))

        inside = F.aggregate(b["texts"], F.struct(head.alias("at"), state["spans"].alias("spans")), text)
        return F.struct((inside["at"] - len(NEXT) + len(END) + 1).alias("at"), inside["spans"].alias("spans"))

    first = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans")
    )
    return F.aggregate(blocks, first, block)["spans"]


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation in ``turns`` (conv_id, turn, role, text, any other columns).

    Turns are ordered by (turn, role, text), nulls first, so ties have one order and repeated rows stay.
    Null roles and texts count as empty. Rows without conv_id form one conversation. loss_spans are
    (start, end) in code points, the end exclusive. A conversation is one string of the result, so its turns
    have to fit into one row; before the shuffle they are collected per task. An empty table gives an empty one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("__turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("__turn")).alias("turns"))
    escaped = F.transform(
        "turns",
        lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\!")).alias("role"), escape(t["text"]).alias("text")),
    )
    parts = sorted_turns.select("conv_id", _blocks(escaped).alias("blocks"))
    written = F.transform(
        "blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], NEXT), F.lit(END + "\n"))
    )
    return parts.select("conv_id", F.array_join(written, "").alias("formatted"), _spans(F.col("blocks")).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_texts`` read back from the string and its loss mask."""
    pattern = {c: c.replace("|", r"\|") for c in (START, NEXT)}

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        begin = F.length(role) + 2
        body = F.substring(b, begin, F.length(b) - begin - len(END))
        return F.transform(F.split(body, pattern[NEXT], -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    found = F.split("formatted", pattern[START], -1)
    blocks = F.slice(found, F.lit(2), F.size(found) - 1)
    masked = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, block)), "loss_texts": masked})
