"""The corpus pipeline: documents in, encoded training text out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the last
one returns the encoded rows. Stages are written as tables in between, so a lost executor never costs more than a stage.

1. quality rules: rejected documents go.
2. near duplicates (five-word shingles, Jaccard 0.8): one document of each group stays, the one of smallest id.
3. personal data: every span is replaced by its kind in brackets; n_chars follows the text.
4. mixing: sources are brought to their target weights; a document taken twice is two rows.
5. BPE: doc_id, source, n_tokens, ids and the digest of the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetgraph.llm import bpe, mixing, near, pii, quality
from sheetgraph.llm.native import text_of, word_count
from sheetgraph.llm.tables import documents, stored

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.found(docs).withColumn("text", F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), F.col("spans"))))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = docs.select("doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias("given"))
    return mixing.mixed(given, tie=F.col("tie")).select("given.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = bpe.encoded(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id", "source"], words=400_000, chars=1_000_000, across_tasks=False)
    return d.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing_sources", mixing_sources),
          ("bpe_encoding", bpe_encoding)]
ORACLE_SQL = None  # encoding has no SQL form; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
