"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and never fewer than the `floor` smallest ones, so
short texts can be compared too. With its threshold (the fixed one, or the floor-th smallest hash if that is larger, or the end
of the range if all hashes are kept) a sketch is complete below that threshold: two sketches are compared below the smaller of
their thresholds, which estimates Jaccard likeness and containment between very unequal documents, and the union of two
sketches below the smaller threshold is the sketch of the united documents.

Nulls: a null text is empty. An empty text has the empty sketch; two empty sketches have likeness 1, an empty and another one 0.
Null ids come first in order; repeated ids are ordered by a hash of the text. A table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheetgraph.llm.native import let, shingle_hashes, text_of, words

WIDTH = 5
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FRACTION = 16       # hashes in the lowest 1/16 of the range are kept
FLOOR = 128         # and at least so many of the smallest
BUCKET = 1024       # ids per bucket when neighbours are sought
FIRSTS_ROWS = 1_000_000  # bucket starts (16 bytes each) that may be broadcast; beyond that a plain join


def sketch(text: Column, width: int = WIDTH, fraction: int = FRACTION, floor: int = FLOOR) -> Column:
    """Struct of top (threshold, bigint) and hashes (sorted bigints)."""
    limit = LOWEST + ((1 << 64) // fraction) - 1
    low = lambda top: F.lit(top).cast("bigint")
    def of(h):
        return let(F.array_sort(F.array_distinct(F.filter(h, lambda x: x <= limit))), lambda few: F.when(
            F.size(few) >= floor, F.struct(low(limit).alias("top"), few.alias("hashes"))).otherwise(let(F.array_sort(F.array_distinct(h)), lambda s: F.when(
                F.size(s) <= floor, F.struct(low(HIGHEST).alias("top"), s.alias("hashes"))).otherwise(
                F.struct(F.get(s, F.lit(floor - 1)).alias("top"), F.slice(s, 1, floor).alias("hashes"))))))
    return let(shingle_hashes(words(text), width), of)


def as_text(s: Column) -> Column:
    """The sketch as a string: threshold and hashes, 16 hex digits each."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat(digits(s["top"]), F.array_join(F.transform(s["hashes"], digits), ""))


def _common(a: Column, b: Column, of) -> Column:
    below = lambda s, top: F.filter(s["hashes"], lambda x: x <= top)
    return let(F.least(a["top"], b["top"]), lambda top: let(below(a, top), lambda x: let(below(b, top), lambda y: let(
        F.size(F.array_intersect(x, y)), lambda both: of(F.size(x), F.size(y), both)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness."""
    return _common(a, b, lambda n, m, both: F.when(n + m == 0, F.lit(1.0)).otherwise(both / (n + m - both)).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    return _common(a, b, lambda n, m, both: F.when(n == 0, F.lit(1.0)).otherwise(both / n).cast("double"))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents together."""
    top = F.least(a["top"], b["top"])
    return let(top, lambda t: F.struct(t.alias("top"), F.array_sort(F.array_union(
        F.filter(a["hashes"], lambda x: x <= t), F.filter(b["hashes"], lambda x: x <= t))).alias("hashes")))


def _previous_bucket(buckets: DataFrame) -> DataFrame:
    """(b, prev) for the distinct bucket numbers: the next smaller one that exists, the largest for the smallest. Two levels, so no
    task sorts them all."""
    d = buckets.withColumn("g", F.floor(F.col("b") / 4096))
    tops = d.groupBy("g").agg(F.max("b").alias("top"))
    tops = tops.select("g", F.coalesce(F.lag("top").over(Window.orderBy("g")), F.max("top").over(Window.partitionBy())).alias("before"))
    return d.withColumn("p", F.lag("b").over(Window.partitionBy("g").orderBy("b"))).join(tops, "g").select("b", F.coalesce("p", "before").alias("prev"))


def with_next_text(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket: int = BUCKET, firsts_rows: int = FIRSTS_ROWS) -> DataFrame:
    """(id, text, next_text) of every row, in order of id, the last followed by the first.

    Rows meet their neighbours inside buckets of ids; only the last row of a bucket looks for the first row of the next bucket. The
    text is shuffled once."""
    d = docs.select(F.coalesce(F.floor(F.col(id) / bucket), F.lit(LOWEST // bucket - 1)).cast("bigint").alias("b"), F.col(id).alias("id"), text_of(text).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    ids = docs.select(F.coalesce(F.floor(F.col(id) / bucket), F.lit(LOWEST // bucket - 1)).cast("bigint").alias("b"), F.col(id).alias("id"))
    starts = ids.groupBy("b").agg(F.min("id").alias("id"))
    starts = starts.join(_previous_bucket(starts.select("b")), "b").select(F.col("id").alias("first_id"), F.col("b").alias("first_b"), "prev")
    if starts.limit(firsts_rows + 1).count() <= firsts_rows:
        starts = F.broadcast(starts)  # at most firsts_rows rows of three longs
    firsts = d.join(starts, d["id"].eqNullSafe(F.col("first_id")) & (d["b"] == F.col("first_b")))\
        .groupBy(F.col("prev").alias("fb")).agg(F.min(F.struct("tie", "text")).alias("f")).select("fb", F.col("f.text").alias("first_text"))
    order = Window.partitionBy("b").orderBy("id", "tie")
    # the bucket's rows are brought together first, so that what is computed from the text comes after the shuffle
    seen = d.repartition("b").withColumn("next_text", F.lead("text").over(order))
    out = seen.join(firsts, F.col("b") == F.col("fb"), "left")
    return out.select(F.col("id").alias(id), F.col("text").alias(text), F.coalesce("next_text", "first_text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by as many of the following text's first ones."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))
