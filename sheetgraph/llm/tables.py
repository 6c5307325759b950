"""Tables of the given folder, intermediate tables in the cluster's shared folder, and look-ups under hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheetgraph.operators.stage import shared_folder, staged

SPREAD = 256  # parts into which the rows of one key are dealt


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """The same rows written once as a table of the shared folder and read back: lineage ends here, whatever executor is lost.
    `group_bytes` bounds row groups where rows are so large that a reader should hold few at a time."""
    if group_bytes is None:
        return staged(df)
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 8).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def part_of(*by: str | Column) -> Column:
    """The part of its key's rows that a row belongs to."""
    return F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")


def looked_up(rows: DataFrame, key: str, by: list[str], table: DataFrame) -> DataFrame:
    """Left join of `rows` with `table`, whose `key` is unique, where one key may hold a third of the rows.

    Rows are dealt to parts by the columns `by`. Only the distinct (key, part) pairs meet the table on the key, at most SPREAD for
    each; the rows then meet those pairs on both. A null key finds nothing.
    """
    dealt = rows.withColumn("__part", part_of(*by))
    pairs = dealt.filter(F.col(key).isNotNull()).select(key, "__part").distinct()
    return dealt.join(pairs.join(table, key), [key, "__part"], "left").drop("__part")
