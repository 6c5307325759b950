"""N-gram Jaccard join by prefix trees.

Every document is the set of its distinct word shingles, as 64-bit hashes. Documents of equal sets are one class; one member
stands for it. Two classes link when 100 * common >= percent * united.

Which classes can link at all is decided by prefixes under one global order of shingles, rare ones first: a set of n shingles can
only link to a set that shares one of its first n - ceil(percent * n / 100) + 1 shingles. The order is (region, document frequency,
hash), where the first region is a lowest part of the hash range, a little larger than a prefix; only sets with too few shingles
there show the others too, so a fifth to a third of the shingles are ever shuffled. Frequencies are exact for that, over all classes.

Classes that share a prefix shingle held by few others are paired, and a pair stays only while its sizes, the places of the shared
shingle and what both hold in the first region leave room for enough common shingles. Without that, chance pairs would grow into one
cluster that takes in an ever larger part of a growing table. Classes that share a frequent one are chained by size, broken where sizes
alone rule a link out. What hangs together by pairs and chains is a candidate cluster: small even where a passage stands in thousands of
documents, since its shingles are frequent and come last.

Inside a cluster the join itself runs on a prefix tree: the sets, ordered by one local order, stored as a tree with compressed
paths. A set walks down the tree level by level, carrying the overlap of each path once for all sets below it; a subtree is
left as soon as its sets are all too small or too large, or the overlap so far plus what can still come (the shorter of the
longest remaining path and the set's own remaining shingles) is below what its smallest set would need. Links found are reduced to a spanning forest before they leave
the task. A cluster of more than `BLOCK` shingles is split by hash into g blocks and joined block by block against block, so memory is
bounded for any cluster and each pair of blocks meets in one task. Components of the links are the result.

Words are runs without blanks, A-Z lowered. Shorter texts than one shingle count as one, texts without words as none: these link
with nothing. Nulls: a null text is empty; a row without id has no component. Repeated rows fall in one class; rows that share
an id but not a text are linked each by its text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sheetgraph.llm.bpe import slices
from sheetgraph.llm.tables import stored
from sheetgraph.operators.components import components

REGION = 1.4  # size of the first region, as a multiple of the share of shingles two linked sets may lack
BLOCK = 1_500_000        # shingles of a block; a task joins two
PIECE = 48               # ranks in one piece of a path
FEW = 8                  # classes that share a shingle up to which they are paired; more are chained by size
BROADCAST_ROWS = 100_000  # rows of ids (up to four longs each), or words of a bitmap of ids, that may be broadcast
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
HELD_WORDS = 300_000


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: bytes, width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes. Bytes lower and split by ASCII only, as wanted."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    w = np.fromiter((hashes[x] for x in ws), np.uint64, len(ws))
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i:i + n]) * MIX[i % len(MIX)]
        h ^= h >> np.uint64(29)
    return np.unique(h * MIX[0])


def needed(n: int, percent: int) -> int:
    """Length of the prefix in which a set of n shingles must share one with any set it links to."""
    return n - -(-percent * n // 100) + 1


def region(percent: int) -> int:
    """End of the first region of the (unsigned) hash range."""
    return int(REGION * (100 - percent) / 100 * 2.0 ** 64)


def sets(docs: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """id, n (set size), digest of the set, m0 (shingles in the first region), seen (those that are ordered; bigints)."""
    limit = np.uint64(region(percent))
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                ns, digests, m0s, seen = [], [], [], []
                for t in batch.column("text").to_pylist():
                    s = shingles(t, width, hashes)
                    m0 = int(np.searchsorted(s, limit))
                    ns.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    m0s.append(m0)
                    seen.append(s[:m0] if m0 >= needed(len(s), percent) else s)
                ends = np.cumsum([0, *map(len, seen)], dtype=np.int32)
                flat = pa.array(np.concatenate([*seen, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(m0s, pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "n", "digest", "m0", "seen"])

    return source.mapInArrow(run, "id bigint, n bigint, digest binary, m0 bigint, seen array<bigint>")


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(t, rid, n, rank): the shared shingles of every class's prefix, rare first, with their place in the class from 1."""
    p = classes.select("rid", "n", "m0", F.size("seen").alias("m"), F.explode("seen").alias("t"))
    often = p.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    first = F.col("t").between(0, region(percent) - 1)  # it ends below the sign bit for any percent above 64
    shared = p.join(often, "t").withColumn("far", (~first).cast("int"))
    own = Window.partitionBy("rid", "far")
    place = F.row_number().over(own.orderBy("df", "t")) - F.count(F.lit(1)).over(own)
    # those that no other class has come first in their region
    rank = F.when(F.col("far") == 0, F.col("m0")).otherwise(F.col("m")) + place
    most = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    return shared.withColumn("rank", rank).filter(F.col("rank") <= most).select("t", "rid", "n", F.col("rank").cast("bigint").alias("rank"))


def candidates(prefix: DataFrame, every: DataFrame, percent: int, few: int = FEW) -> DataFrame:
    """(u, v) between classes, each once: no two classes that link are left unconnected. `every` has the sets of all rows.

    The first shingle common to two linked sets stands in both prefixes. Where few hold it, the two are paired, and common shingles can
    number no more than what comes from there on in either set, or than a set without those of its first region that the other lacks.
    Where many hold it, neighbours in size are paired: sizes between two that may link may link with both.
    """
    lists = prefix.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    held = prefix.join(lists, "t")
    side = lambda x: held.filter(F.col("k") <= few).select("t", F.col("rid").alias(x), F.col("n").alias("n" + x), F.col("rank").alias("r" + x))
    enough = lambda common: (100 + percent) * common >= percent * (F.col("nu") + F.col("nv"))
    room = F.least(F.col("nu") - F.col("ru"), F.col("nv") - F.col("rv")) + 1
    pairs = side("u").join(side("v"), "t").filter(F.col("u") < F.col("v")).filter(enough(room) & enough(F.least("nu", "nv")))
    pairs = stored(pairs.select("u", "v", "nu", "nv").distinct())
    ids = stored(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct())
    # the lowest part of the hash range comes first in `seen`; ids may repeat with other texts
    first = maybe_in(every, "id", ids, "id").filter("__maybe").select("id", "digest", "m0", F.slice("seen", F.lit(1), F.col("m0").cast("int")).alias("low"))
    first = stored(first.groupBy("id", "digest").agg(F.first("m0").alias("m"), F.first("low").alias("low")).drop("digest"))
    of = lambda x: first.withColumnsRenamed({"id": x, "m": "m" + x, "low": "low" + x})
    both = pairs.join(of("u"), "u").join(of("v"), "v").withColumn("both", F.size(F.array_intersect("lowu", "lowv")))
    close = both.filter(enough(F.least(F.col("nu") - F.col("mu"), F.col("nv") - F.col("mv")) + F.col("both"))).select("u", "v")
    by_size = Window.partitionBy("t").orderBy("n", "rid")
    row = held.filter(F.col("k") > few).select(F.col("rid").alias("u"), "n", F.lag("rid").over(by_size).alias("v"), F.lag("n").over(by_size).alias("before"))
    chained = row.filter((F.col("u") != F.col("v")) & (100 * F.col("before") >= percent * F.col("n"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return close.unionByName(chained).distinct()


class Tree:
    """Sets of ascending ranks as a prefix tree with compressed paths; nodes are kept level by level."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        nodes = [[-1, 0, 0, 0]]  # parent, one set below, start and end of the path's piece
        own = [0] * len(sets)    # node at which a set ends
        stack, last = [0], None
        for i in order:
            s = sets[i]
            common = 0
            if last is not None:
                k = min(len(last), len(s))
                diff = np.flatnonzero(last[:k] != s[:k])
                common = int(diff[0]) if len(diff) else k
            while nodes[stack[-1]][2 + 1] > common:
                top = stack.pop()
                if nodes[stack[-1]][3] < common:  # cut the piece in two
                    mid = len(nodes)
                    nodes.append([stack[-1], nodes[top][1], nodes[top][2], common])
                    nodes[top][0], nodes[top][2] = mid, common
                    stack.append(mid)
            if len(s) > common or len(s) > nodes[stack[-1]][3]:
                nodes.append([stack[-1], i, nodes[stack[-1]][3], len(s)])
                stack.append(len(nodes) - 1)
            own[i] = stack[-1]
            last = s
        # pieces are cut to PIECE ranks, so a path that stops fitting is left soon
        last_of, cut = [0] * len(nodes), []
        for v in sorted(range(len(nodes)), key=lambda v: nodes[v][3]):
            up, i, a, b = nodes[v]
            up = last_of[up] if v else -1
            for at in range(a, max(b, a + 1), PIECE):
                cut.append((up, i, at, min(b, at + PIECE)))
                up = len(cut) - 1
            last_of[v] = up
        own = [last_of[v] for v in own]
        parent, of, start, end = np.array(cut).T
        smallest, longest, largest = np.full(len(cut), np.iinfo(int).max), end.copy(), np.zeros(len(cut), int)
        np.minimum.at(smallest, own, sizes)
        np.maximum.at(largest, own, sizes)
        for v in range(len(cut) - 1, 0, -1):  # children come after their parents
            smallest[parent[v]] = min(smallest[parent[v]], smallest[v])
            largest[parent[v]] = max(largest[parent[v]], largest[v])
            longest[parent[v]] = max(longest[parent[v]], longest[v])
        n_nodes = len(cut)
        by_parent = np.argsort(parent, kind="stable")
        self.child = by_parent[1:]  # the root comes first: its parent is -1
        self.n_child = np.bincount(parent[1:], minlength=n_nodes)
        self.first_child = np.concatenate([[0], np.cumsum(self.n_child)[:-1]])
        self.rest, self.smallest, self.largest = longest - end, smallest, largest
        self.piece = np.concatenate([*(sets[o][a:b] for o, a, b in zip(of, start, end)), np.zeros(0, np.int32)])
        self.piece_at = np.concatenate([[0], np.cumsum(end - start)])
        ends = np.argsort(own, kind="stable")
        self.sets_of = ends
        self.n_sets = np.bincount(own, minlength=n_nodes)
        self.first_set = np.concatenate([[0], np.cumsum(self.n_sets)[:-1]])

    @staticmethod
    def _spread(first, count):
        """Indices first[i], first[i]+1, ... for every i, count[i] of them."""
        at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return at + np.arange(len(at))

    def linked(self, s: np.ndarray, size: int, sizes: np.ndarray, inside: np.ndarray, percent: int) -> np.ndarray:
        """Sets that link to the given one."""
        inside[s] = True
        found, level, overlap = [], np.zeros(1, int), np.zeros(1, int)
        while len(level):
            ends = level[self.n_sets[level] > 0]
            if len(ends):
                here = self.sets_of[self._spread(self.first_set[ends], self.n_sets[ends])]
                both = np.repeat(overlap[self.n_sets[level] > 0], self.n_sets[ends])
                found.append(here[100 * both >= percent * (size + sizes[here] - both)])
            n = self.n_child[level]
            overlap = np.repeat(overlap, n)
            level = self.child[self._spread(self.first_child[level], n)]
            # sizes alone rule out a subtree whose sets are all too small or too large
            go = (100 * self.largest[level] >= percent * size) & (100 * size >= percent * self.smallest[level])
            level, overlap = level[go], overlap[go]
            if not len(level):
                break
            a, length = self.piece_at[level], self.piece_at[level + 1] - self.piece_at[level]
            hits = np.concatenate([[0], np.cumsum(inside[self.piece[self._spread(a, length)]])])
            stop = np.cumsum(length)
            overlap = overlap + hits[stop] - hits[stop - length]
            own_rest = len(s) - np.searchsorted(s, self.piece[self.piece_at[level + 1] - 1], "right")
            bound = overlap + np.minimum(self.rest[level], own_rest)
            go = (100 + percent) * bound >= percent * (size + self.smallest[level])
            level, overlap = level[go], overlap[go]
        inside[s] = False
        return np.concatenate([*found, np.zeros(0, int)]).astype(int)


def forest(members: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (id, id) spanning the components among some sets."""
    sizes = np.array([len(s) for _, s in members])
    every, counts = np.unique(np.concatenate([s for _, s in members]), return_counts=True)
    shared = counts > 1
    rank = np.full(len(every), -1, np.int32)
    rank[np.flatnonzero(shared)[np.argsort(-counts[shared], kind="stable")]] = np.arange(shared.sum())  # frequent first: paths are shared
    ranked = []
    for _, s in members:
        r = rank[np.searchsorted(every, s)]
        ranked.append(np.sort(r[r >= 0]))
    tree, inside = Tree(ranked, sizes), np.zeros(int(shared.sum()) + 1, bool)
    root = list(range(len(members)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, s in enumerate(ranked):
        for j in tree.linked(s, int(sizes[i]), sizes, inside, percent).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((members[i][0], members[j][0]))
    return out


def _joined(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, members = Hashes(), None, {}

        def flush():
            links = forest(list(members.values()), percent) if len(members) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("c", "i", "j")))
            for k, rid, text in zip(keys, batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
                if k != key:
                    if members:
                        yield flush()
                    key, members = k, {}
                s = shingles(text, width, hashes)
                if len(s):
                    members[rid, s.tobytes() if (rid, 0) in members else 0] = (rid, s)
        if members:
            yield flush()
    return run


def maybe_in(rows: DataFrame, id: str, ids: DataFrame, key: str) -> DataFrame:
    """`rows` with `__maybe`, which is false only where the id is none of `ids`: by a bitmap of hashed ids, broadcast in at most
    BROADCAST_ROWS words. Of other ids one in eight is held for given, more where there are millions of ids a word."""
    words = max(1, min(BROADCAST_ROWS, ids.count() // 8))
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(64 * words))
    word = lambda c: F.floor(at(c) / 64).cast("bigint")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at(c), F.lit(64)).cast("int"))
    bits = ids.select(word(key).alias("__word"), bit(key).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit(id)) != 0, F.lit(False))
    return rows.withColumn("__word", word(id)).join(F.broadcast(bits), "__word", "left").withColumn("__maybe", hit).drop("__word", "__bits")


def links(docs: DataFrame, prefix: DataFrame, every: DataFrame, id: str, text: str, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v) between class members, spanning every component of linked classes."""
    edges = stored(candidates(prefix, every, percent))
    ends = edges.select(F.col("u").alias("rid")).unionByName(edges.select(F.col("v").alias("rid"))).distinct()
    cluster = components(ends, edges, [], "rid")
    member = stored(cluster.join(prefix.select("rid", "n").distinct(), "rid").select("rid", F.col("comp").alias("c"), "n"))
    size = member.groupBy("c").agg(F.ceil(F.sum("n") / block).cast("int").alias("g"))
    # each member goes to all pairs of blocks that hold its own block
    b = F.pmod(F.xxhash64("rid"), F.col("g")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    member = stored(member.join(size, "c").withColumn("b", b).select("rid", "c", pairs.alias("p")).select("rid", "c", "p.i", "p.j"))
    small = member.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id).cast("bigint").alias("rid"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    if not small:  # few texts are in a cluster, and only these move to meet their members
        texts = maybe_in(texts, "rid", member.select("rid").distinct(), "rid").filter("__maybe").drop("__maybe")
    work = texts.join(F.broadcast(member) if small else member, "rid").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return work.mapInArrow(_joined(width, percent), "u bigint, v bigint")


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id, class_id of every row: the smallest ids reachable by links and of the same set."""
    every = stored(sets(docs, id, text, width, percent))
    usable = every.filter("n > 0 and id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("id", "n", "m0", "seen")).alias("r")).select(F.col("r.id").alias("rid"), "r.n", "r.m0", "r.seen")
    found = stored(links(docs, stored(prefixes(classes, percent)), usable, id, text, width, percent, block))
    ends = found.select(F.col("u").alias("rid")).unionByName(found.select(F.col("v").alias("rid"))).distinct()
    label = components(ends, found, [], "rid")
    class_of = usable.groupBy("digest").agg(F.min("id").alias("rid")).join(label, "rid", "left").select("digest", "rid", F.coalesce("comp", "rid").alias("comp"))
    out = every.select("id", "n", "digest").join(class_of, "digest", "left")
    own = (F.col("n") > 0) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(own, F.col("comp")).otherwise(F.col("id")).alias("component_id"), F.when(own, F.col("rid")).otherwise(F.col("id")).alias("class_id"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay when one document of each component stays: the one of smallest id. Rows without id stay. Rows that
    share an id are documents of their own, each by its text; where the smallest id repeats in a component, one of its rows stays."""
    if docs.filter(F.col(id).isNotNull()).groupBy(id).count().filter("count > 1").isEmpty():
        label = stored(linked(docs, id, text, width, percent))
        return _without(docs, label.filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("__gone")), id)
    # ids do not tell rows apart: rows are numbered, and the smallest id is looked up afterwards
    d = stored(docs.withColumn("__row", F.when(F.col(id).isNotNull(), F.monotonically_increasing_id())))
    rows = d.filter("__row is not null").select("__row", id)
    label = stored(linked(d, "__row", text, width, percent).filter("n_shingles > 0").select("__row", "component_id"))
    first = label.join(rows, "__row").groupBy("component_id").agg(F.min(F.struct(id, "__row")).alias("m")).select(F.col("m.__row").alias("stays"))
    # texts without words have no component; only repeats of id and text are folded
    blank = d.filter("__row is not null").filter(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\t\n\x0B\f\r]"))
    first = first.unionByName(blank.groupBy(id, text).agg(F.min("__row").alias("stays")).select("stays"))
    gone = rows.join(first, F.col("__row") == F.col("stays"), "left_anti").select(F.col("__row").alias("__gone"))
    return _without(d, gone, "__row").drop("__row")


def _without(docs: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    gone = stored(gone.distinct())
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(gone), docs[id] == F.col("__gone"), "left_anti")
    # the other rows stay where they are
    d = maybe_in(docs, id, gone, "__gone")
    rest = d.filter("__maybe").join(gone, F.col(id) == F.col("__gone"), "left_anti")
    return d.filter("NOT __maybe").unionByName(rest).select(*docs.columns)
