"""The prefix trie of conversations: one row per distinct sequence of first turns.

A turn is a token of fixed width: digest of role and text, then the text's length, so a sequence is a string whose byte order keeps
all that share a prefix together and whose common prefix with its neighbour is counted in tokens. Exact copies are folded first.

1. Distinct sequences are range-partitioned and sorted; each task cuts its part into blocks.
2. In a block the neighbours' longest common prefixes are edges, taken in descending depth into a union-find: sequences ending at a
   depth and components merged there become one branching node, and a component that rises unmerged leaves a node per depth.
3. A node that contains neither the first nor the last sequence of its block is complete. The others, prefixes of those two, are the
   contracted forest of the block: at most their two lengths in rows.
4. Between neighbouring blocks one more edge, the common prefix of last and first, corrects what both counted: a shared child, a
   false leaf, and a turn that is now saved once more. The contracted rows and corrections of a node are summed under its key; no
   pass over the depths is needed.
5. Parents of nodes below contracted ones are looked up with the parent's rows spread.

What meets in one row is a conversation's tokens (40 bytes a turn, whatever its texts), in one task a block of sequences. Digests of
the conversations ending at a node are streamed in order, packed into runs of ids before they are shuffled.

Defined results: null role or text is empty; equal turn numbers are ordered by digest, null ones come first; rows without a conv_id
belong to no conversation; a repeated row is a turn of its own. An empty table has no nodes. Further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sheetgraph.llm.native import text_of
from sheetgraph.llm.tables import looked_up, stored

WIDTH = 40  # 32 hex digits of the digest, 8 of the length
BLOCK = 20_000  # sequences in one union-find
BLOCK_CHARS = 32_000_000  # or so many characters of them, but always one sequence
RUN = 4096  # neighbouring ids that are packed together
NO_ENDS = hashlib.sha256(b"").hexdigest()
SCHEMA = ("key string, parent_key string, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
          "ends_sha256 string, part int, first string, last string")
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[x.split()[1]]) for x in SCHEMA.split(", ")])


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and `seq`, the array of tokens in order, one row per conversation."""
    text, role = text_of("text"), text_of("role")
    token = F.concat(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)), F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn"), token.alias("token")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["token"].alias("seq"))


def grafted(seqs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The first h tokens of the conversation at the start of each group of ids, then the conversation's own after its first h;
    h is crc32 of the id modulo `most`."""
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = seqs.filter(c % group == 0).select(c.alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    own = seqs.withColumns({"base": c - c % group, "h": h}).join(heads, "base", "left")
    start = F.when(F.col("head").isNull(), F.array().cast("array<string>")).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return own.select("conv_id", F.concat(start, rest).alias("seq"))


def ends(members: DataFrame) -> DataFrame:
    """`seq` with ends_sha256, the digest of its conv_ids in ascending order, comma-joined."""
    run = F.expr(f"conv_id div {RUN}")
    packed = members.groupBy("seq", run.alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq != at:
                    if at is not None:
                        done.append((at, h.hexdigest()))
                    at, h = seq, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["seq", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], names=["seq", "ends_sha256"])

    return packed.repartition("seq").sortWithinPartitions("seq", "run").select("seq", "ids").mapInArrow(stream, "seq string, ends_sha256 string")


def shared(a: str, b: str) -> int:
    """Number of tokens that two sequences begin with in common."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[(lo * WIDTH):(mid * WIDTH)] == b[(lo * WIDTH):(mid * WIDTH)] else (lo, mid - 1)
    return lo


def length_at(seq: str, depth: int) -> int:
    """Length of the text of the turn at a depth from 1."""
    return int(seq[depth * WIDTH - 8:depth * WIDTH], 16)


def keys(seq: str, upto: int) -> list[str]:
    """The keys of the prefixes of 0 to `upto` tokens."""
    h = hashlib.md5()
    out = [h.hexdigest()]
    for d in range(upto):
        h.update(seq[d * WIDTH:(d + 1) * WIDTH].encode())
        out.append(h.hexdigest())
    return out


class Node:
    """A node of a block: the sequences lo to hi, its depth and what is known of the subtree."""

    __slots__ = ("lo", "hi", "depth", "conv", "n", "children", "leaves", "saved", "ends", "parent")

    def __init__(self, lo: int, hi: int, depth: int, conv: int, n: int):
        self.lo, self.hi, self.depth, self.conv, self.n = lo, hi, depth, conv, n
        self.children, self.leaves, self.saved, self.ends, self.parent = 0, 0, 0, None, None


def forest(seqs: list[str], convs: list[int], counts: list[int], sha: list[str]) -> list[Node]:
    """All nodes of the trie of sorted distinct sequences, by union-find over the neighbours' common prefixes, deepest first."""
    nodes, m = [], len(seqs)
    top: list[Node] = []  # of each component, at its root in `up`
    up = list(range(m))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def close(x: Node) -> None:
        """Own share of what the subtree saves, once all members are known."""
        x.leaves = x.leaves or 1
        x.saved += (x.n - 1) * (length_at(seqs[x.lo], x.depth) if x.depth else 0)
        nodes.append(x)

    def risen(x: Node, to: int) -> Node:
        """The component's node at depth `to`, with one node per depth on the way; each has one child."""
        while x.depth > to:
            y = Node(x.lo, x.hi, x.depth - 1, x.conv, x.n)
            y.children, y.leaves, y.saved, x.parent = 1, x.leaves, x.saved, y
            if y.depth > to:
                close(y)
            x = y
        return x

    for i, s in enumerate(seqs):
        x = Node(i, i, len(s) // WIDTH, convs[i], counts[i])
        x.ends = sha[i]
        top.append(x)
    edges: dict[int, list[int]] = {}
    for i in range(1, m):
        edges.setdefault(shared(seqs[i - 1], seqs[i]), []).append(i)
    edges.setdefault(0, [])
    fresh = set(range(m))  # components whose node is not closed yet: single sequences
    for depth in sorted(edges, reverse=True):
        merged = set()
        for i in edges[depth]:
            a, b = find(i - 1), find(i)
            x, y = top[a], top[b]
            for r, node in ((a, x), (b, y)):
                if node.depth > depth and r in fresh:
                    close(node)
                    fresh.discard(r)
            x, y = risen(x, depth), risen(y, depth)
            # both stand at this depth now and become one node, in the place of the left one
            x.hi, x.conv, x.n = y.hi, min(x.conv, y.conv), x.n + y.n
            x.children, x.leaves, x.saved, x.ends = x.children + y.children, x.leaves + y.leaves, x.saved + y.saved, x.ends or y.ends
            y.parent = x  # stands for x from here on
            up[b] = a
            top[a] = x
            fresh.discard(b)
            merged.discard(b)
            merged.add(a)
            fresh.add(a)
        for r in merged:
            close(top[r])
            fresh.discard(r)
    x = top[find(0)]
    if x.depth:
        if find(0) in fresh:
            close(x)
        close(risen(x, 0))
    elif find(0) in fresh:
        close(x)
    return nodes


def final(x: Node) -> Node | None:
    """The parent, past nodes that were merged into another of their depth."""
    p = x.parent
    while p is not None and p.parent is not None and p.parent.depth == p.depth:
        p = p.parent
    return p


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Complete nodes, contracted rows, the corrections between blocks, and the first and last sequence of the part."""
    from pyspark import TaskContext
    part, held, size, first, last = TaskContext.get().partitionId(), [], 0, None, None
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(NAMES, ARROW)], schema=ARROW)
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            held.append(row)
            size += len(row[0])
            if len(held) >= most or size >= BLOCK_CHARS:
                first = held[0][0] if first is None else first
                yield pack(of_block(held) + (correction(last, held[0][0]) if last is not None else []))
                last, held, size = held[-1][0], [], 0
    if held:
        first = held[0][0] if first is None else first
        yield pack(of_block(held) + (correction(last, held[0][0]) if last is not None else []))
        last = held[-1][0]
    if first is not None:
        yield pack([{"part": part, "first": first, "last": last}])


def of_block(rows: list[tuple]) -> list[dict]:
    seqs, convs, counts, sha = map(list, zip(*rows))
    left, right = keys(seqs[0], len(seqs[0]) // WIDTH), keys(seqs[-1], len(seqs[-1]) // WIDTH)
    key = lambda x: left[x.depth] if x.lo == 0 else right[x.depth] if x.hi == len(seqs) - 1 else None
    out = []
    for x in forest(seqs, convs, counts, sha):
        k, p = key(x), final(x)
        pk = key(p) if p is not None else None
        out.append({"key": k, "parent_key": pk, "depth": x.depth, "conv_id": x.conv, "parent_conv_id": p.conv if p is not None and pk is None else None, "n_convs": x.n,
                    "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "ends_sha256": x.ends})
    return out


def correction(last: str, first: str) -> list[dict]:
    """What two neighbouring blocks counted twice or not at all, under each prefix that their border sequences share."""
    n = shared(last, first)
    ks, saved, out = keys(last, n), 0, []
    for d in range(n, -1, -1):
        saved += length_at(last, d) if d else 0
        out.append({"key": ks[d], "parent_key": ks[d - 1] if d else None, "depth": d, "n_convs": 0, "n_children": -1 if d < n else 0,
                    "n_leaves": -1 if n == len(last) // WIDTH else 0, "saved_tokens": saved})
    return out


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in correction(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], f.type) for n, f in zip(NAMES, ARROW)], schema=ARROW)


def trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. `block` bounds the sequences of one union-find."""
    members = stored(seqs.select("conv_id", F.array_join("seq", "").alias("seq")))
    distinct = members.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct.join(ends(members), "seq").select("seq", "conv_id", "n", "ends_sha256"))
    rows = stored(distinct.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(functools.partial(blocks, most=block), SCHEMA))
    # one row per task: its last sequence meets the first of the next task that has any
    parts = rows.filter("part IS NOT NULL").select("part", "first", "last")
    follows = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).filter("next IS NOT NULL")
    borders = follows.join(parts.select("part", "last"), "part").join(parts.select(F.col("part").alias("next"), "first"), "next").select("last", "first")
    open_ = rows.filter("part IS NULL AND key IS NOT NULL").unionByName(borders.mapInArrow(corrections, SCHEMA))
    merged = stored(open_.groupBy("key", "depth", "parent_key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256")))
    inner = rows.filter("part IS NULL AND key IS NULL").drop("key", "part", "first", "last")
    every = inner.unionByName(merged.drop("key"), allowMissingColumns=True)
    out = looked_up(every, "parent_key", ["conv_id"], merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("p")))
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.coalesce("parent_conv_id", "p").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
