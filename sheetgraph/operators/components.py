"""Connected components over edge tables, many graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheetgraph.operators.stage import has_rows, staged
from sheetgraph.operators.suppress import SHEET


def components(vertices: DataFrame, edges: DataFrame, keys=SHEET, id="node_id", u="u", v="v") -> DataFrame:
    """`vertices` ids with `comp`, the smallest id of their component.

    Each round gives every vertex of the remaining edges a fresh pseudo-random rank and hooks it to its lowest-ranked neighbour if
    that ranks below itself; two jumps follow the hooks, then the edges are rewritten between the vertices reached and
    duplicates go. Ranks do not follow the ids, so a chain numbered in order shrinks as fast as any other: at least by a constant
    factor a round in expectation, O(log n) rounds in all. Neighbours are reduced with min, never listed. The hooks of each
    round are kept and composed backwards at the end, over tables that grow by that factor.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(u).alias("a"), F.col(v).alias("b")).filter("a <> b")
    live, hooks = staged(e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), []
    while has_rows(live):
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("r"), F.col(c).alias("p"))
        low = live.groupBy(*keys, "a").agg(F.min(rank("b")).alias("m"))
        up = staged(low.select(*keys, "a", F.least("m", rank("a"))["p"].alias("p")))
        for _ in range(2):
            nxt = up.select(*keys, F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(nxt, [*keys, "p"]).select(*keys, "a", F.col("pp").alias("p"))
        up = staged(up)
        hooks.append(up)
        at_a = live.join(up, [*keys, "a"]).select(*keys, F.col("p").alias("a"), "b")
        at_b = at_a.join(up.select(*keys, F.col("a").alias("b"), F.col("p").alias("q")), [*keys, "b"]).select(*keys, "a", F.col("q").alias("b"))
        live = staged(at_b.filter("a <> b").distinct())
    out = vertices.select(*keys, F.col(id).alias("a"))
    if not hooks:
        return out.select(*keys, F.col("a").alias(id), F.col("a").alias("comp"))
    root = hooks.pop()
    while hooks:
        later = root.select(*keys, F.col("a").alias("p"), F.col("p").alias("q"))
        root = hooks.pop().join(later, [*keys, "p"], "left").select(*keys, "a", F.coalesce("q", "p").alias("p"))
    root = staged(root)
    # a root is hooked to itself, so its own id is among those it stands for
    least = root.groupBy(*keys, "p").agg(F.min("a").alias("comp"))
    label = root.join(least, [*keys, "p"]).select(*keys, "a", "comp")
    return out.join(label, [*keys, "a"], "left").select(*keys, F.col("a").alias(id), F.coalesce("comp", "a").alias("comp"))


def summary(comp: DataFrame, keys=SHEET, id="node_id") -> DataFrame:
    """Per sheet: number of components, largest, isolated vertices and the five largest sizes."""
    sizes = comp.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("size"))
    per = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("times"))
    # one entry per distinct size; five of the largest are enough to spell the top five
    top = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("size", F.least("times", F.lit(5)).alias("times"))))), 1, 5)
    spelled = F.slice(F.flatten(F.transform(F.col("top"), lambda s: F.array_repeat(s["size"], s["times"].cast("int")))), 1, 5)
    return per.groupBy(*keys).agg(
        F.sum("times").alias("n_components"), F.max("size").alias("largest"),
        F.sum(F.when(F.col("size") == 1, F.col("times")).otherwise(0)).alias("isolated"), top.alias("top"),
    ).withColumn("sizes_top5", spelled).drop("top")
