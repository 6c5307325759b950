"""Order-dependent results (numbering, running sums, exact quantiles) without sorting a whole key in one task.

Every function works on two levels: rows fall into buckets whose order agrees with the sort order, bucket totals are summed
over the few buckets of a key, and rows are only ordered inside their bucket. A key that holds a third of the data is so
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sheetgraph.operators.stage import staged

B = "__bucket"


def running(df: DataFrame, keys, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in the given order. `bucket` must be non-decreasing along that order."""
    d = df.withColumn(B, bucket)
    before = Window.partitionBy(*keys).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    offs = d.groupBy(*keys, B).agg(*[F.sum(v).alias("__t_" + n) for n, v in sums.items()])
    offs = offs.select(*keys, B, *[F.coalesce(F.sum("__t_" + n).over(before), F.lit(0)).alias("__o_" + n) for n in sums])
    inside = Window.partitionBy(*keys, B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"__i_" + n: F.sum(v).over(inside) for n, v in sums.items()})
    d = d.join(offs, [*keys, B])
    out = d.withColumns({n: F.col("__i_" + n) + F.col("__o_" + n) for n in sums})
    return out.drop(B, *["__i_" + n for n in sums], *["__o_" + n for n in sums])


def numbered(df: DataFrame, keys, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row within its keys."""
    out = running(df, keys, bucket, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def best_from_here(df: DataFrame, keys, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Largest value from each row to the end of the given order.

    The order is walked from its end: a frame that ends at the last row would be added up anew for every row.
    """
    d = df.withColumn(B, bucket).withColumn("__v", value)
    after = Window.partitionBy(*keys).orderBy(F.desc(B)).rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy(*keys, B).agg(F.max("__v").alias("__m"))
    tops = tops.select(*keys, B, F.max("__m").over(after).alias("__later"))
    d = d.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, B).orderBy(*order)))
    inside = Window.partitionBy(*keys, B).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__here", F.max("__v").over(inside)).join(tops, [*keys, B])
    return d.withColumn(name, F.greatest("__here", "__later")).drop(B, "__n", "__v", "__here", "__later")


def sliced(df: DataFrame, by, order: list[Column]) -> DataFrame:
    """The rows as a table with `slice`, a bucket for the functions above for any order, text included: sampled ranges of the whole order.

    A key or a tie with many rows spans several slices as long as its rows differ in `order`.
    """
    d = df.repartitionByRange(*[F.col(k) for k in by], *order).withColumn("slice", F.spark_partition_id())
    return staged(d)


def value_bucket(v: Column) -> Column:
    """A coarse non-decreasing function of any double, fine around the sizes found on drawings."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 256).cast("bigint")


def quantiles(df: DataFrame, keys, value: Column, probs: dict[str, float], rule: str = "linear",
              extra: list[Column] = ()) -> DataFrame:
    """Exact quantiles per key. `rule` is linear (between ranks), nearest (half-even rank) or upper (rank n*p floored).

    Equal values are counted together first, with partial aggregation before the shuffle. `extra` are aggregates over the
    distinct values, where column `n` is the number of rows with value `v`.
    """
    counts = df.select(*keys, value.cast("double").alias("v")).filter("v is not null").groupBy(*keys, "v")\
        .agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, keys, value_bucket(F.col("v")), [F.col("v")], {"hi": F.col("n")})
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    d = ranked.join(total, list(keys)) if keys else ranked.crossJoin(F.broadcast(total))  # one row: the grand total
    held = lambda r: (F.col("hi") - F.col("n") <= r) & (r < F.col("hi"))
    at = lambda r: F.max(F.when(held(r), F.col("v")))
    cols = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total") - 1)
        if rule == "nearest":
            cols.append(at(F.bround(pos)).alias(name))
        elif rule == "upper":
            cols.append(at(F.least(F.floor(F.lit(float(p)) * F.col("total")), F.col("total") - 1)).alias(name))
        else:
            lo, hi = at(F.floor(pos)), at(F.ceil(pos))
            part = F.max(pos - F.floor(pos))
            cols.append((lo + (hi - lo) * part).alias(name))
    return d.groupBy(*keys).agg(F.max("total").alias("n"), *cols, *extra)
