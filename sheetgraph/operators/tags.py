"""Instrument tags: assembly of recognised lines, parsing and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph.functions import text
from sheetgraph.operators.suppress import SHEET
from sheetgraph.params import TagParams


def assemble(lines: DataFrame, keys=SHEET, node="node_id") -> DataFrame:
    """Lines of each node top to bottom: cleaned texts, the joined text and the mean confidence of all lines."""
    clean = F.trim(F.regexp_replace("txt", r"\s+", " "))
    d = lines.groupBy(*keys, node).agg(
        F.array_sort(F.collect_list(F.struct("y_center", "line_no", clean.alias("t")))).alias("l"), F.avg("conf").alias("tag_confidence"))
    texts = F.filter(F.transform("l", lambda x: x["t"]), lambda t: F.length(t) > 0)
    return d.select(*keys, node, texts.alias("texts"), F.array_join(texts, " ").alias("raw_text"), "tag_confidence")


def parse(d: DataFrame, p: TagParams = TagParams()) -> DataFrame:
    """Function, loop number and how they were read, from `texts` and `raw_text`.

    Two or more lines: first is the function, last the loop number or a placeholder; failing that the joined text is tried as
    one line. A single line is split if it can be.
    """
    n = F.size("texts")
    top, bottom = F.upper(F.element_at("texts", 1)), F.upper(F.element_at("texts", -1))
    ends = F.when(top.rlike(p.function_regex) & bottom.rlike(p.loop_regex), "ok")\
        .when(top.rlike(p.function_regex) & bottom.rlike(p.placeholder_regex), "ok_placeholder")
    joined = F.upper("raw_text")
    one_line = joined.rlike(p.single_line_regex)
    status = F.when(n == 0, "failed").when((n >= 2) & ends.isNotNull(), ends).when(one_line, "single_line_split")\
        .when(n == 1, "single_line_unsplit").otherwise("failed")
    d = d.withColumn("parse_status", status)
    pair = F.col("parse_status").isin("ok", "ok_placeholder")
    split = F.col("parse_status") == "single_line_split"
    part = lambda i: F.regexp_extract(joined, p.single_line_regex, i)
    return d.withColumns({"tag_function": F.when(pair, top).when(split, part(1)), "loop_number": F.when(pair, bottom).when(split, part(2))})


def scored(gt_tags: DataFrame, reads: DataFrame, keys=SHEET, id="gt_id") -> DataFrame:
    """Readable ground-truth tags beside what was read at the same symbol; nothing read counts as an empty string."""
    g = gt_tags.filter("label_status <> 'unreadable'").withColumn("want", text.normalised_tag(F.col("function"), F.col("loop")))
    r = reads.select(*keys, id, text.normalised_tag(F.col("tag_function"), F.col("loop_number")).alias("got"), F.lit(1).alias("matched"))
    return g.join(r, [*keys, id], "left").withColumns({"got": F.coalesce("got", F.lit("")), "matched": F.coalesce("matched", F.lit(0))})


def cer(d: DataFrame, by=()) -> DataFrame:
    """Edit distance over reference length, summed before dividing."""
    dist = F.sum(F.levenshtein("want", "got"))
    size = F.sum(F.greatest(F.lit(1), F.length("want")))
    return d.groupBy(*by).agg(dist.alias("edits"), size.alias("chars"), (dist / size).alias("cer"))


def exact_match(d: DataFrame) -> DataFrame:
    """Exact-match accuracy per label status and overall, with the pass gates (0.90 on ok rows, 0.80 overall)."""
    hit = F.sum((F.col("want") == F.col("got")).cast("bigint"))
    d = d.rollup("label_status").agg(n_rows().alias("n"), hit.alias("exact"), F.sum(1 - F.col("matched")).cast("bigint").alias("unmatched"), (hit / n_rows()).alias("accuracy"))
    gate = F.when(F.col("label_status") == "ok", F.col("accuracy") >= 0.90).when(F.col("label_status").isNull(), F.col("accuracy") >= 0.80)
    return d.withColumn("passed", gate.cast("int"))


def rejected(probes: DataFrame, status: str = "parse_status") -> DataFrame:
    """Known non-tags: how many were found, and how many of those the parser turned down."""
    return probes.agg(n_rows().alias("n"), F.count(status).alias("found"), F.count_if(F.col(status) == "failed").alias("rejected"))
