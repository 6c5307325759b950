"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from sheetgraph.llm import bpe, chat, fingerprints, mixing, near, pii, prefixes, quality, shards, signatures, tokens, toxicity, warc
from sheetgraph.llm.native import text_of, word_count
from sheetgraph.llm.tables import documents, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_personal_data")
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.found(documents(spark, sf_dir), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op2_bpe_encoding")
def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.linked(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op5_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {WORD}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS ls FROM d),
h AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8), LATERAL (SELECT array_to_string(ws[i:i+7], ' ') AS w) GROUP BY doc_id, w HAVING count(*) > 1),
p AS (SELECT x.doc_id, i FROM (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8) x JOIN h ON h.doc_id = x.doc_id AND h.w = array_to_string(x.ws[i:i+7], ' ')),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.r, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM m""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails("base").alias("base_failed"), (~quality.fails("v1")).alias("kept"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 1))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= toxicity.OPERATING, 1).otherwise(0).alias("predicted"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", text_of("text").alias("text"))
    d = d.withColumn("n_tokens", tokens.n_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")))
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints.with_next_text(documents(spark, sf_dir)).withColumn("edit", fingerprints.edited(F.col("text"), F.col("next_text")))
    d = d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), fingerprints.sketch(F.col("text")).alias("a"),
                 fingerprints.sketch(F.col("edit")).alias("b"), fingerprints.sketch(F.col("next_text")).alias("c"))
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("a")).alias("fingerprint"), fingerprints.as_text(F.col("b")).alias("edited_fingerprint"),
                    fingerprints.likeness(F.col("a"), F.col("b")).alias("near_edited"), fingerprints.likeness(F.col("a"), F.col("c")).alias("near_next"))


@query("op9_source_mixing", rf"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size FROM documents),
b AS (SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS b FROM d),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM w),
t AS (SELECT k, source_size, least(cap, w * max((whole - capped) / open) OVER ()) AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {mixing.UNIT}) AS BIGINT) ELSE 0 END AS rate,
  CAST('0x' || substr(md5('{mixing.SEED}:' || k), 1, 7) AS BIGINT) AS u FROM t),
n AS (SELECT b.doc_id, b.size, r.*, row_number() OVER (PARTITION BY b.k ORDER BY b.b, b.size, b.doc_id NULLS FIRST) AS n FROM b JOIN r ON b.k = r.k)
SELECT doc_id, size, source_size, target, size * ((u + n * rate) // {mixing.UNIT} - (u + (n - 1) * rate) // {mixing.UNIT}) AS taken FROM n""")
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = stored(docs.select("doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64("text").alias("tie")))
    return mixing.with_copies(sized, tie=F.col("tie")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</', '\l') AS et, replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</', '\l'), chr(10), '\n') AS er,
  row_number() OVER o AS k, lag(role) OVER o AS prev FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + 8 + CASE WHEN k > 1 AND prev = role THEN 0 ELSE 5 + length(er) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    out = chat.formatted(given.unionByName(more)).select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


TERM, UPPER, LOWER = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


@query("op11_lexical_search", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {UPPER}, {LOWER}), {TERM}) AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
f AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, {UPPER}, {LOWER}), {TERM})) AS t FROM benchmark)),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
x AS (SELECT i, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN f USING (t) JOIN n USING (r), s GROUP BY i, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 50""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_prefix_trie", r"""
WITH t AS (SELECT conv_id, coalesce(role, '') || chr(10) || coalesce(text, '') AS tok, CAST(length(coalesce(text, '')) AS BIGINT) AS len,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(range(8 * length(id)), lambda a, i: xor((CASE WHEN i % 8 = 0 THEN xor(a, CAST(ascii(id[i // 8 + 1]) AS BIGINT)) ELSE a END) >> 1,
  3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(a, CAST(ascii(id[i // 8 + 1]) AS BIGINT)) ELSE a END) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM i),
r AS (SELECT h.conv_id, tok, len, 0 AS part, k FROM h JOIN t ON t.conv_id = h.base AND k <= h UNION ALL SELECT h.conv_id, tok, len, 1, k FROM h JOIN t ON t.conv_id = h.conv_id AND k > h),
s AS (SELECT conv_id, md5(tok) AS tok, len, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM r),
p AS (SELECT conv_id, d, len, string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM h),
e AS (SELECT conv_id, max(d) AS depth FROM p GROUP BY conv_id),
n AS (SELECT path, d, any_value(len) AS len, min(p.conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (d = depth) AS ends
  FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY path, d),
c AS (SELECT n.*, q.conv_id AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND left(x.path, length(n.path)) = n.path) AS n_children FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.path = left(n.path, 32 * (n.d - 1))),
u AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.len) AS saved FROM c a JOIN c b ON b.d >= a.d AND left(b.path, 32 * a.d) = a.path GROUP BY a.path)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM c JOIN u USING (path)""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefixes.trie(prefixes.grafted(prefixes.sequences(given)))


@query("op13_warc_captures", """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS m FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return c.select(warc.field("metadata", "page-id").cast("bigint").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                    F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", warc.field("first", "page-id").cast("bigint")).alias("refers_to"))
