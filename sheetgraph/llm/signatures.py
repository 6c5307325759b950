"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Documents of like size are dealt to blocks. A block is a bit matrix with a column per document; a (term, level) pair sets
`HASHES` of its rows, where level j > 0 stands for more than 2 ** (j - 1) occurrences. Blocks have a fixed number of bits, so few
columns where documents are long. Next to them the index holds document lengths and how many documents hold each term.

Search. The rows of a term, anded, overestimate which documents of a block hold it that often. Summing weights over a query's
terms and levels, times what each level can add at the document's exact length, gives an integer never below its true score.
1. A sweep over the blocks finds, for each query, the documents of highest bound; their exact scores give a score that the last
   ranked document reaches at least.
2. A second sweep lists the documents whose bound is not below that. All others are provably excluded; each listed one is scored exactly from
   its whole text, and the best are kept.

Queries are taken in chunks of bounded size, so what is broadcast is bounded: a chunk's terms and its `PROBES` documents a query.
Texts are shuffled once, to meet the listed documents. Documents meet by a 64-bit key over id and text; should two share a key,
both are scored. A document of more than `MOST_ROWS` / `ROOM` terms has a denser column, is excluded less often and scored anyway.

Defined results: null texts have no terms; a row is a document, so repeated rows are ranked each; null ids come last among equal
scores; a query without terms finds nothing; queries that share an id are ranked each. Empty tables give no rows. Further columns
are ignored.
"""

from __future__ import annotations

import collections
import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sheetgraph.llm.bpe import slices
from sheetgraph.llm.native import text_of
from sheetgraph.llm.tables import part_of, stored

HASHES, ROOM = 4, 16  # rows a pair sets; rows per pair of a document
BITS = 1 << 21        # bits in a block
MOST_COLUMNS = 4096   # documents in a block
MOST_ROWS = 1 << 20
TERMS_HELD = 100_000  # terms counted before they leave a task
QUERIES, QUERY_TERMS = 1000, 50_000  # of a chunk, but always one query
PROBES = 4            # documents probed per document wanted
GROUP = 16 << 20      # bytes of a row group of the index
PAIRS = 1 << 22       # cells of the matrix of bounds worked on at once
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
INDEX = "columns array<bigint>, lengths array<bigint>, n_rows int, bits binary, terms array<binary>, dfs array<bigint>"
ARROW = pa.schema([("columns", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_rows", pa.int32()), ("bits", pa.binary()), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int64()))])


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lowered."""
    return text.translate(TABLE).split()


def least(level: int) -> int:
    """Occurrences from which a term is in a level: 1, 2, 3, 5, 9, 17 and so on."""
    return 1 if level == 0 else (1 << (level - 1)) + 1


def rows_of(hashes: np.ndarray, level: np.ndarray | int, n_rows: int) -> np.ndarray:
    """The rows that pairs of term hash and level set, one line per pair."""
    x = (hashes.astype(np.uint64) << np.uint64(8)) + np.asarray(level, np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32)))[:, None] * ODD[:HASHES]
    return ((x >> np.uint64(32)) * np.uint64(n_rows) >> np.uint64(32)).astype(np.int64)


class Builder:
    """The open blocks of a task, one per size class, and its counts of documents per term."""

    def __init__(self):
        self.open: dict[int, tuple[list, list, list]] = {}
        self.dfs: collections.Counter = collections.Counter()

    def add(self, key: int, text: bytes) -> Iterator[dict]:
        found = collections.Counter(terms(text))
        if not found:
            return
        self.dfs.update(found.keys())
        hashes = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        pairs, level = [(hashes, np.zeros(len(hashes), np.uint64))], 1
        while (more := times >= least(level)).any():
            hashes, times = hashes[more], times[more]
            pairs.append((hashes, np.full(len(hashes), level, np.uint64)))
            level += 1
        h, lv = (np.concatenate(x) for x in zip(*pairs))
        size = math.ceil(2 * math.log2(len(h)))
        n_rows = min(math.ceil(ROOM * 2 ** (size / 2)), MOST_ROWS)
        keys, lengths, sets = self.open.setdefault(n_rows, ([], [], []))
        keys.append(key)
        lengths.append(int(sum(found.values())))
        sets.append((h, lv))
        if len(keys) >= max(8, min(MOST_COLUMNS, BITS // n_rows)):
            yield self.block(n_rows)
        if len(self.dfs) >= TERMS_HELD:
            yield self.counts()

    def block(self, n_rows: int) -> dict:
        keys, lengths, sets = self.open.pop(n_rows)
        bits = np.zeros((n_rows, -(-len(keys) // 8) * 8), bool)
        for i, (h, lv) in enumerate(sets):
            bits[rows_of(h, lv, n_rows).ravel(), i] = True
        return {"columns": keys, "lengths": lengths, "n_rows": n_rows, "bits": np.packbits(bits, axis=1).tobytes()}

    def counts(self) -> dict:
        got, self.dfs = self.dfs, collections.Counter()
        return {"terms": list(got), "dfs": list(got.values())}

    def rest(self) -> Iterator[dict]:
        for n in list(self.open):
            yield self.block(n)
        if self.dfs:
            yield self.counts()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def index(docs: DataFrame) -> DataFrame:
    """Block rows (columns, lengths, n_rows, bits) and count rows (terms, dfs); a term has a count row per task and more."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Builder()
        out = lambda row: pa.RecordBatch.from_pylist([row], schema=ARROW)
        for whole in batches:
            for batch in slices(whole, "text"):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from map(out, b.add(key, text.as_py()))
        yield from map(out, b.rest())

    return keyed(docs).select("key", F.col("text").cast("binary").alias("text")).mapInArrow(build, INDEX)


@dataclass
class Chunk:
    """A chunk of queries: ids, and per (query, term) pair with weight above 0 the query, the term's place and its weight."""

    ids: list
    vocabulary: list[bytes]
    query: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    scale: tuple[int, int]  # documents with terms, their terms
    wanted: int

    def by_query(self) -> list[list[tuple[bytes, int]]]:
        out: list = [[] for _ in self.ids]
        for q, t, w in zip(self.query.tolist(), self.place.tolist(), self.weight.tolist()):
            out[q].append((self.vocabulary[t], w))
        return out


def measure(length, scale: tuple[int, int]):
    """A document's m, of a number or an array."""
    return 50 + (50 * length * scale[0]) // scale[1]


def chunk_of(items: list[tuple[object, list[bytes]]], found: DataFrame, scale: tuple[int, int], wanted: int) -> Chunk:
    """Queries with the weights of their terms; `found` has the counts of the index."""
    spark = found.sparkSession
    asked = sorted({t for _, ts in items for t in ts})
    table = spark.createDataFrame([(bytearray(t),) for t in asked], "term binary")
    df = {bytes(r.term): r.df for r in found.join(F.broadcast(table), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()} if asked else {}
    weight = {t: math.floor(1000 * math.log((2 * scale[0] + 2) / (2 * n + 1))) for t, n in df.items()}
    vocabulary = sorted(t for t, w in weight.items() if w > 0)
    place = {t: i for i, t in enumerate(vocabulary)}
    triples = [(q, place[t], weight[t]) for q, (_, ts) in enumerate(items) for t in sorted(set(ts)) if t in place]
    q, p, w = (np.array(x, np.int64) for x in (zip(*triples) if triples else ((), (), ())))
    return Chunk([i for i, _ in items], vocabulary, q, p, w, scale, wanted)


def bounds(block: dict, c: Chunk, hashes: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, a line per query."""
    lengths, n = np.array(block["lengths"], np.int64), len(block["columns"])
    bits = np.frombuffer(block["bits"], np.uint8).reshape(block["n_rows"], -1)
    m, out = measure(lengths, c.scale), np.zeros((len(c.ids), n), np.int64)
    worth = lambda times: (1_000_000_000 * times) // (1000 * times + 20 * m)
    step = max(1, PAIRS // max(1, n))
    for a in range(0, len(c.query), step):
        query, place, weight = c.query[a:a + step], c.place[a:a + step], c.weight[a:a + step]
        used, at = np.unique(place, return_inverse=True)
        on, level, before = None, 0, np.zeros(n, np.int64)
        while len(query):
            here = np.bitwise_and.reduce(bits[rows_of(hashes[used], level, block["n_rows"])], axis=1)
            on = here if on is None else on & here
            alive = on.any(axis=1)
            if not alive.any():
                break
            # only terms that some document may hold so often go on
            keep = alive[at]
            query, weight, at = query[keep], weight[keep], (np.cumsum(alive) - 1)[at[keep]]
            on, used = on[alive], used[alive]
            # occurrences a document in this level may have, up to its whole length
            now = worth(np.minimum(least(level + 1) - 1, lengths))
            flags = np.unpackbits(on, axis=1, count=n)
            starts = np.flatnonzero(np.diff(query, prepend=-1))
            out[query[starts]] += np.add.reduceat(flags[at] * weight[:, None], starts, axis=0) * (now - before)
            before, level = now, level + 1
    return out


def _swept(blocks: DataFrame, c: Chunk, floor: np.ndarray | None) -> DataFrame:
    """Without `floor`: query, key and bound of the highest bounds per task. With it: key and `queries` of every document whose bound
    is not below the query's floor."""
    shared = blocks.sparkSession.sparkContext.broadcast((c, floor))  # bounded by the chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, low = shared.value
        hashes, most = np.array([zlib.crc32(t) for t in chunk.vocabulary], np.uint32), PROBES * chunk.wanted
        best = np.zeros((len(chunk.ids), 0), np.int64), np.zeros((len(chunk.ids), 0), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {k: batch.column(j)[i].as_py() for j, k in enumerate(("columns", "lengths", "n_rows", "bits"))}
                ub, keys = bounds(block, chunk, hashes), np.array(block["columns"], np.int64)
                if low is not None:
                    docs, queries = np.nonzero((ub >= low[:, None]).T)
                    starts = np.flatnonzero(np.diff(docs, prepend=-1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[docs[starts]]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)), pa.int32()), pa.array(queries, pa.int32()))], names=["key", "queries"])
                    continue
                best = np.hstack([best[0], ub]), np.hstack([best[1], np.broadcast_to(keys, ub.shape)])
                if best[0].shape[1] > 2 * most:
                    top = np.argpartition(best[0], -most, axis=1)[:, -most:]
                    best = np.take_along_axis(best[0], top, 1), np.take_along_axis(best[1], top, 1)
        if low is None:
            if best[0].shape[1] > most:
                top = np.argpartition(best[0], -most, axis=1)[:, -most:]
                best = np.take_along_axis(best[0], top, 1), np.take_along_axis(best[1], top, 1)
            q, j = np.nonzero(best[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[1][q, j]), pa.array(best[0][q, j])], names=["query", "key", "bound"])

    return blocks.select("columns", "lengths", "n_rows", "bits").mapInArrow(run, "query int, key bigint, bound bigint" if floor is None else "key bigint, queries array<int>")


def best_of(rows: DataFrame, most: int, score: str, tie: str) -> DataFrame:
    """The `most` rows of highest score per query with their rank; in parts first, so that no task orders all rows of a query."""
    order = [F.col(score).desc(), F.col(tie).asc_nulls_last()]
    rows = rows.withColumn("__part", part_of(tie))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query", "__part").orderBy(*order))).filter(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most).drop("__part")


def _scored(rows: DataFrame, c: Chunk, most: int) -> DataFrame:
    """Exact scores above 0 of documents (doc_id, text, queries); each task keeps the `most` best of a query."""
    shared = rows.sparkSession.sparkContext.broadcast((c.by_query(), c.scale))  # bounded by the chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, scale = shared.value
        heaps: dict[int, list] = collections.defaultdict(list)
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text, queries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    found = collections.Counter(terms(text.as_py()))
                    m = measure(sum(found.values()), scale)
                    part = {}
                    for q in queries:
                        score = 0
                        for t, w in asked[q]:
                            if n := found.get(t):
                                x = part.get(t)
                                if x is None:
                                    x = part[t] = w * ((1_000_000_000 * n) // (1000 * n + 20 * m))
                                score += x
                        if score:
                            heap, entry = heaps[q], (score, doc is not None, -(doc or 0))
                            heapq.heappush(heap, entry) if len(heap) < most else heapq.heappushpop(heap, entry)
        out = [(q, -d if known else None, s) for q, heap in heaps.items() for s, known, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "queries").mapInArrow(run, "query int, doc_id bigint, score bigint")


def ranked(docs: DataFrame, blocks: DataFrame, c: Chunk) -> DataFrame:
    """query (place in the chunk), rank, doc_id, score of the wanted documents per query."""
    docs = keyed(docs)
    probed = stored(best_of(_swept(blocks, c, None), PROBES * c.wanted, "bound", "key").groupBy("key").agg(F.collect_list("query").alias("queries")))
    probed = best_of(_scored(docs.join(F.broadcast(probed), "key"), c, c.wanted), c.wanted, "score", "doc_id")
    floor = np.ones(len(c.ids), np.int64)
    for r in probed.filter(F.col("rank") == c.wanted).collect():
        floor[r["query"]] = r["score"]
    # documents of one key and the same queries are one row; its texts meet it each
    open_ = _swept(blocks, c, floor).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("queries"))).alias("queries"))
    return best_of(_scored(docs.join(open_, "key"), c, c.wanted), c.wanted, "score", "doc_id")


def chunks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries (item_id, text) in chunks of bounded size."""
    held, size = [], 0
    for r in items.toLocalIterator():
        ts = sorted(set(terms((r.text or "").encode())))
        if held and (len(held) == QUERIES or size + len(ts) > QUERY_TERMS):
            yield held
            held, size = [], 0
        held.append((r.item_id, ts))
        size += len(ts)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, wanted: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the `wanted` best documents of each item (item_id, text)."""
    spark = docs.sparkSession
    table = stored(index(docs), GROUP)
    blocks = table.filter("bits IS NOT NULL")
    found = table.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    total = blocks.agg(F.sum(F.size("columns")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for part in chunks(items.select("item_id", F.col("text").cast("string").alias("text"))) if total[0] else ():
        c = chunk_of(part, found, (total[0], total[1]), wanted)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(c.ids)], "query int, item_id bigint")
        out = out.unionByName(ranked(docs, blocks, c).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out
