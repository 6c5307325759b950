"""Sharding by Karmarkar-Karp differencing.

Rows of equal text form one indivisible group. Groups are dealt over buckets of about `BUCKET_GROUPS` by the hash of their text. In each
bucket the differencing method runs: every group starts as a partial partition of k sums, one of them its bytes; the two
partial partitions of largest spread are combined again and again, the largest sum of one with the smallest of the other,
until one is left. The buckets' partial partitions, k numbers each, are combined in the same way on the driver (one bucket per
50,000 groups: 10 billion groups are 200,000 x k longs), which says to which shard each bucket's j-th subset goes. Groups are
counted before any shuffle, so a text that makes up a third of all rows is one entry.

The text itself is never shuffled. Numbering inside shards is done per (shard, slice of rows) with the slices' totals in front.

Nulls: a null text counts as empty: 16 bytes, one group with the empty texts. Null ids are rows like others. Repeated rows are
of one group and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sheetgraph.llm.native import text_of
from sheetgraph.llm.tables import stored

SHARDS, ROW_BYTES = 40, 16
BUCKET_GROUPS = 50_000
SLICES = 64  # numbering slices per shard


def differenced(parts: list[tuple[list[int], object]], k: int) -> tuple[list[int], object]:
    """Combine partial partitions (k sums, ascending) by largest spread. The second entry is a tree: an item, or (left, right, order),
    where slot i of the result is slot order[i] of left and slot k-1-order[i] of right."""
    serial = itertools.count()  # ties are combined in the order they came
    heap = [(s[0] - s[-1], next(serial), s, t) for s, t in parts]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        both = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(k), key=both.__getitem__)
        both = [both[i] for i in order]
        heapq.heappush(heap, (both[0] - both[-1], next(serial), both, (ta, tb, order)))
    return heap[0][2], heap[0][3]


def placed(tree, k: int):
    """(item, slots) of every leaf: slots[j] is the final slot of the leaf's slot j."""
    stack = [(tree, list(range(k)))]
    while stack:
        t, at = stack.pop()
        if isinstance(t, tuple):
            left, right, order = t
            down = [0] * k
            for i, o in enumerate(order):
                down[o] = at[i]
            stack.append((left, down))
            stack.append((right, down[::-1]))  # right was reversed before it was added
        else:
            yield t, at


def _bucket_shards(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True], ignore_index=True)
        sums, tree = differenced([([0] * (k - 1) + [int(b)], i) for i, b in enumerate(pdf["bytes"])], k)
        local = np.zeros(len(pdf), np.int32)
        for i, at in placed(tree, k):
            local[i] = at[-1]
        return pd.DataFrame({"bucket": pdf["bucket"], "g": pdf["g"], "local": local, "sums": [sums if i == 0 else None for i in range(len(pdf))]})
    return run


def sharded(rows: DataFrame, k: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """`rows` has `size` and a group key `g` (equal for equal texts); adds shard (0 to k-1)."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    n = -(-groups.count() // bucket_groups) or 1
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(n)).cast("int"))
    local = stored(dealt.groupBy("bucket").applyInPandas(_bucket_shards(k), "bucket int, g string, local int, sums array<bigint>"))
    partial = local.filter("sums is not null").select("bucket", "sums").orderBy("bucket").collect()
    if not partial:
        return rows.withColumn("shard", F.lit(None).cast("int"))
    _, tree = differenced([(list(r["sums"]), r["bucket"]) for r in partial], k)
    spark = rows.sparkSession
    final = spark.createDataFrame([(b, j, s) for b, at in placed(tree, k) for j, s in enumerate(at)], "bucket int, local int, shard int")
    where = local.select("bucket", "g", "local").join(F.broadcast(final) if len(partial) <= 10_000 else final, ["bucket", "local"]).select("g", "shard")
    return rows.join(where, "g")


def numbered(rows: DataFrame, order: list[str], slices: int = SLICES) -> DataFrame:
    """Adds slot: gapless from 0 within each shard."""
    d = rows.withColumn("__s", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = d.groupBy("shard", "__s").agg(F.count(F.lit(1)).alias("__c"))
    front = Window.partitionBy("shard").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__s", F.coalesce(F.sum("__c").over(front), F.lit(0)).alias("__front"))
    inside = Window.partitionBy("shard", "__s").orderBy(*order)
    return d.withColumn("slot", F.row_number().over(inside) - 1).join(starts, ["shard", "__s"]).withColumn("slot", (F.col("slot") + F.col("__front")).cast("bigint")).drop("__s", "__front")


def by_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHARDS) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row."""
    t = text_of(text)
    rows = stored(docs.select(F.col(id).alias("id"), (F.octet_length(t) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(t).alias("crc"), F.md5(t).alias("g")))
    out = numbered(sharded(rows, k), ["id", "crc", "g"])
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
