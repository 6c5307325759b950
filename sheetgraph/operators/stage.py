"""Cutting lineage between the rounds of an iterative operator.

Rounds are written as tables into the folder of the cluster (`spark.checkpoint.dir`), which executors share, so a lost executor
costs a re-read and not the whole chain. A table read back is a plain scan: nothing the optimizer derived about earlier rounds
is carried along, and planning costs the same in every round. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; where it names none and runs locally, a fresh one that the session then names."""
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sheetgraph-")
        spark.conf.set(KEY, folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder from here on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
