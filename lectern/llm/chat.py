"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted and laid out as blocks of adjacent turns of one role:

    <|im_start|>role\\ntext<|turn|>text<|im_end|>\\n

`<|turn|>` keeps merged turns apart. In texts and roles, `<` followed by n backslashes and `|` gets one backslash more,
so no control string is left in them and unescaping takes it away again. In roles, a line feed becomes `<\\n|`, and
`<` followed by m backslashes, n and `|` gets one backslash more before that.

Edge cases: a null text or role counts as empty; turns with equal numbers go by role, then text; repeated rows are
turns of their own; null conv_id is a conversation of its own; extra columns are ignored; an empty table gives an
empty result. A conversation is one output row, so it must fit into a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """As a text, and without line feeds."""
    return F.regexp_replace(F.regexp_replace(escape(c), r"<(\\+)n\|", r"<$1\\n|"), "\n", r"<\\n|")


def unescape_role(c: Column) -> Column:
    # a single backslash stands for a line feed; more of them lose one
    return unescape(F.regexp_replace(F.regexp_replace(c, r"<\\n\|", "\n"), r"<\\(\\+)n\|", r"<$1n|"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss: (start, length) in code points of trained texts."""
    rows = columns(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def laid(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        same = (i > 0) & (before.role == t.role)
        head = F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), escape_role(t.role), F.lit("\n"))
        return F.struct(F.when(same, F.lit(TURN)).otherwise(head).alias("head"), escape(t.text).alias("body"), (t.role == loss_role).alias("loss"))

    parts = sorted_.select("conv_id", F.transform("turns", laid).alias("parts"))
    # where each body starts, by a running sum over the array
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def step(a: Column, p: Column) -> Column:
        start, n = a.at + F.length(p.head), F.length(p.body).cast("long")
        return F.struct((start + n).alias("at"), F.when(p.loss, F.concat(a.loss, F.array(F.struct(start.alias("start"), n.alias("length"))))).otherwise(a.loss).alias("loss"))

    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body)), ""), F.lit(END)).alias("formatted"),
        F.aggregate("parts", state, step, lambda a: a.loss).alias("loss"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns): the (role, text) turns read back from column formatted."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring(b, F.lit(len(START) + 1), F.length(b))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        role = unescape_role(role)
        return F.transform(F.split(text, r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"))


def loss_text(formatted: str = "formatted", loss: str = "loss") -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
