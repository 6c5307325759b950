r"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are sorted by (turn, role, text); neighbours of one role share a header:

    ### user
    first text</turn>
    second text of the same role</turn>
    ### assistant
    answer</turn>

Control strings inside roles and texts are escaped reversibly: \ as \s, ### as \h, </ as \l, and in roles a line break as \n.
After that every backslash starts an escape, and no marker can occur in a text. The loss mask is a list of spans over the
formatted string (code points, end exclusive), one per assistant turn.

Nulls: null texts and roles are empty; rows without conv_id form one conversation; null turns come first. Repeated rows are
turns of their own. An empty table gives an empty result. Extra columns are ignored. A conversation is one output row, so its
turns meet in one row; nothing in the formatting is quadratic in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.llm.native import before, let, pieces, text_of

HEAD, END = "### ", "</turn>\n"
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</", "\\l")]


def escaped(c: Column, role: bool = False) -> Column:
    for raw, safe in ESCAPES + [("\n", "\\n")] * role:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for raw, safe in [("\n", "\\n"), *ESCAPES[:0:-1], ESCAPES[0]]:
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def formatted(turns: DataFrame, conv: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """conv, formatted (string), loss_spans (array of s, e)."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text")))).alias("t"))
    parts = let(F.col("t"), lambda t: F.transform(t, lambda x, i: F.struct(
        F.when((i > 0) & (F.get(t, i - 1)["role"] == x["role"]), F.lit("")).otherwise(F.concat(F.lit(HEAD), escaped(x["role"], True), F.lit("\n"))).alias("head"),
        escaped(x["text"]).alias("body"), (x["role"] == learn).alias("learn"))))
    g = g.select(conv, parts.alias("p"))
    lengths = F.transform("p", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("bigint"))
    spans = let(before(lengths), lambda at: F.filter(F.transform("p", lambda x, i: F.struct(
        (F.get(at, i) + F.length(x["head"])).alias("s"), (F.get(at, i) + F.length(x["head"]) + F.length(x["body"])).alias("e"), x["learn"].alias("learn"))), lambda s: s["learn"]))
    return g.select(conv, F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
                    F.transform(spans, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))).alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""
    def of_block(block):
        return let(F.substring_index(block, "\n", 1), lambda role: let(F.split(F.substring(block, F.length(role) + 2, F.length(block)), END, -1), lambda texts: F.transform(
            F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))))
    return let(F.split(text, HEAD, -1), lambda b: F.flatten(F.transform(F.slice(b, 2, F.size(b) - 1), of_block)))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(pieces(text, spans), unescaped), "")
