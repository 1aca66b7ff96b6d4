"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role share a block; the pieces are joined to one
string. Four control strings mark the structure. Inside roles and texts a backslash breaks up whatever could be
read as a control string of this template or of a common other one, and a backslash itself is doubled, so that
dropping one backslash of each escape gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """Reversible: ``\\`` becomes ``\\\\``, and ``<|``, ``[INST``, ``[/INST``, ``<s>``, ``</s>``, ``<<SYS``, ``<</SYS`` get a backslash after their first character."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"(?=<\||\[/?INST|</?s>|<</?SYS)(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and ``mask``, the (start, length) in code points of every text to learn from.

    Turns go by ``turn`` (nulls first), then role and text, so ties have one order; repeated rows are repeated
    turns. Null texts and roles count as empty. A null ``conv_id`` is a conversation like any other. Other columns
    play no part, and an empty table gives an empty result.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    safe = sorted_turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), escape(x["text"]).alias("text"))).alias("t"))
    role_at = lambda i: F.try_element_at("t", i.cast("int"))["role"]

    def piece(x: Column, i: Column) -> Column:
        opens = F.when((i > 0) & (role_at(F.greatest(i, F.lit(1))) == x["role"]), F.lit(MORE)).otherwise(F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)))
        closes = F.when(F.coalesce(role_at(i + 2) == x["role"], F.lit(False)), F.lit("")).otherwise(F.lit(END))
        return F.struct(opens.alias("opens"), x["text"].alias("text"), closes.alias("closes"), (x["role"] == LEARNT).alias("learnt"))

    pieces = safe.select("conv_id", F.transform("t", piece).alias("p"))
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["opens"], x["text"], x["closes"])), "")
    lengths = F.transform("p", lambda x: F.struct(F.length(x["opens"]).alias("before"), F.length(x["text"]).alias("n"), F.length(x["closes"]).alias("after"), x["learnt"].alias("learnt")))
    return pieces.select("conv_id", formatted.alias("formatted"), _spans(lengths).alias("mask"))


def _spans(lengths: Column) -> Column:
    """(start, n) of the learnt texts. Each block of some root-of-n pieces adds up its own, then blocks add up before one another, so a long conversation costs n^1.5 steps of copying at most."""
    width = F.greatest(F.ceil(F.sqrt(F.size(lengths))), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / width).cast("int")), lambda b: F.slice(lengths, b * width + 1, width))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("spans"))
    walk = lambda a, x: F.struct(
        (a["at"] + x["before"] + x["n"] + x["after"]).alias("at"),
        F.when(x["learnt"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["before"]).alias("start"), x["n"].alias("n"))))).otherwise(a["spans"]).alias("spans"),
    )
    done = F.transform(blocks, lambda block: F.aggregate(block, start, walk))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    ahead = lambda parts: F.aggregate(parts, first, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")))["seen"]
    moved = lambda parts: F.flatten(F.zip_with(parts, ahead(parts), lambda x, by: F.transform(x["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["n"].alias("n")))))
    return F.element_at(F.transform(F.array(done), moved), 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of ``role`` and ``text``."""
    quoted = {x: x.replace("|", r"\|") for x in (TURN, TEXT, MORE, END)}
    blocks = F.split(formatted, quoted[TURN])
    blocks = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        halves = F.split(block, quoted[TEXT], 2)
        body = F.split(halves[1], quoted[END], 2)[0]
        return F.transform(F.split(body, quoted[MORE]), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_learnt(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. ``mask`` ascends.

    Places count code points, so a cut runs through all text before it: stretches of some root-of-n spans are cut out first, then the spans out of those.
    """
    width = F.greatest(F.ceil(F.sqrt(F.size(mask))), F.lit(1)).cast("int")
    count = F.ceil(F.size(mask) / width).cast("int")
    blocks = F.when(F.size(mask) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(mask, b * width + 1, width))).otherwise(F.array().cast("array<array<struct<start:int,n:int>>>"))

    def stretch(spans: Column) -> Column:
        lo, last = F.element_at(spans, 1)["start"], F.element_at(spans, -1)
        text = F.substring(formatted, lo + 1, last["start"] + last["n"] - lo)
        within = lambda t: F.array_join(F.transform(spans, lambda s: unescape(F.substring(t, s["start"] - lo + 1, s["n"]))), "")
        return F.element_at(F.transform(F.array(text), within), 1)

    return F.array_join(F.transform(blocks, stretch), "")
