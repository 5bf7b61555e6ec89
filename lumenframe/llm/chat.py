"""Chat formatting in relational expressions, reversible, with a loss mask.

A conversation is its rows in order of ``turn`` (null last; ties by role, then text). Adjacent rows
of one role become one block, its texts held apart by a mark, so that reading gives back every row:

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

In roles and texts a backslash follows each ``<``, ``[`` and backslash, so neither these marks nor
other templates' control strings occur inside a text, and dropping these backslashes restores it.

Defined results: null roles and texts are empty; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, r"\Q" + mark + r"\E", -1)


def format_chat(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Returns per conversation its id, ``formatted`` and ``loss_spans`` (start and length in characters of each text that counts for the loss)."""
    turn = F.struct(
        F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    turns = rows.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # a block starts where the role changes, and ends where the next starts
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", F.greatest(i - 2, F.lit(0)))["role"]))
    turns = turns.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("t") + 1))
    blocks = F.zip_with("starts", ends, lambda a, b: F.struct(F.get("t", a - 1)["role"].alias("role"), F.transform(F.slice("t", a, b - a), lambda x: escape(x["text"])).alias("texts")))
    turns = turns.select("__id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")

    def spans(acc: Column, b: Column) -> Column:
        inside = F.aggregate(
            b["texts"],
            F.struct((acc["at"] + F.length(head(b))).alias("at"), acc["spans"].alias("spans")),
            lambda a, t: F.struct(
                (a["at"] + F.length(t) + len(NEXT)).alias("at"),
                F.when(b["role"] == loss_role, F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(t).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
            ),
        )
        return F.struct((inside["at"] - len(NEXT) + len(END)).alias("at"), inside["spans"].alias("spans"))

    empty = F.array().cast("array<struct<start: bigint, length: bigint>>")
    mask = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), spans)["spans"]
    return turns.select(F.col("__id").alias(id_col), formatted.alias("formatted"), mask.alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(_split(formatted, END), lambda b: b != "")
    parts = F.transform(blocks, lambda b: _split(F.substring(b, len(START) + 1, 2**31 - 1), SEP))
    return F.flatten(F.transform(parts, lambda p: F.transform(_split(F.get(p, F.lit(1)), NEXT), lambda t: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
