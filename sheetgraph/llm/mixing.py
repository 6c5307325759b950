"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words: its weight's share of the mix, never above `cap` times its own size, what it cannot take
going to the others by weight. A document's expected copies are target / source size; the prefix sum of expected copies along
a fixed order plus one random offset per source decides how many whole copies it gets: one per integer boundary crossed.

Order: within a source by the bit length of the size, a hash of the id, the size and the id. Prefix sums run per (source, bit length,
hash byte), and the totals of these buckets are summed over the few buckets of a source, so a source with a third of all rows
is spread over thousands of buckets and no task sorts a whole source.

Nulls: a null text has size 0; null sources form one source, last in order; null ids sort first. Rows of equal id and size are
told apart by `tie`. A source of size 0 gets target 0, an empty table an empty result. Sizes and prefix sums are integers
(expected copies in units of 2^-28), so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNIT = 1 << 28  # one whole copy, in fixed-point units
SEED = 20240229
COPY = "__copy"


def source_key(source: Column) -> Column:
    """Never null: the null source is the empty string, others start with '='."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(totals: DataFrame, weights=(3, 1, 2), share=1.5, cap=2.0) -> DataFrame:
    """Per source (columns k, source, source_size): target. The level at which capped shares add up is the largest of the levels
    reached when sources are capped in order of cap / weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "k")
    w = w.withColumns({"capped": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                       "open": F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
                       "whole": F.lit(float(share)) * F.sum("source_size").over(every)})
    w = w.withColumn("level", F.max((F.col("whole") - F.col("capped")) / F.col("open")).over(every))
    return w.select("k", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def with_copies(docs: DataFrame, size: str = "size", id: str = "doc_id", source: str = "source", tie: Column | None = None,
                weights=(3, 1, 2), share=1.5, cap=2.0, seed: int = SEED) -> DataFrame:
    """All rows with source_size, target and copies (long; 0 for a row the mix leaves out). `docs` has a bigint `size`."""
    d = docs.withColumns({"__k": source_key(F.col(source)), "__b": F.concat(
        F.lpad(F.length(F.bin(F.col(size))).cast("string"), 2, "0"), F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))), 1, 2))})
    buckets = d.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"), F.first(source).alias("source"))
    totals = buckets.groupBy(F.col("__k").alias("k")).agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("bigint")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("k"))), 1, 7), 16, 10).cast("bigint")
    plan = targets(totals, weights, share, cap).withColumns({"rate": rate, "u": offset})
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("__k").alias("k"), F.col("__b").alias("b"), "n").join(plan, "k")\
        .withColumn("start", F.col("u") + F.coalesce(F.sum(F.col("n") * F.col("rate")).over(earlier), F.lit(0)))\
        .select(F.col("k").alias("__k"), F.col("b").alias("__b"), "source_size", "target", F.col("rate").alias("__rate"), F.col("start").alias("__start"))
    inside = Window.partitionBy("__k", "__b").orderBy(F.col(size), F.col(id), *([] if tie is None else [tie]))
    d = d.drop("source_size", "target", "copies").withColumn("__n", F.row_number().over(inside).cast("bigint")).join(starts, ["__k", "__b"])
    whole = (F.shiftright(F.col("__start") + F.col("__n") * F.col("__rate"), 28) - F.shiftright(F.col("__start") + (F.col("__n") - 1) * F.col("__rate"), 28))
    return d.withColumn("copies", whole.cast("bigint")).drop("__k", "__b", "__n", "__rate", "__start")


def mixed(docs: DataFrame, size: str = "size", **options) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    taken = with_copies(docs, size, **options).filter("copies > 0")
    return taken.withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop(COPY, "source_size", "target", "copies")
