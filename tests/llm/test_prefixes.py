"""The prefix trie against plain code, with blocks of a few sequences so that most nodes cross a border."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sheetgraph.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq string, depth int, key string, part int"


def plain(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = said.get(base, [])[:h] + own[h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            for d, v in ((kids, 1), (leaves, leaves[p]), (saved, saved[p])):
                d[p[:-1]] = d.get(p[:-1], 0) + v
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items()), built


def conversations(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(-130, 420), 700, 70_000, 10**15]:
        if r.random() < 0.15 and c % 100:
            continue
        for turn in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            out.append((c, turn if turn or r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(["", "a", "a", "bé", None, "\n" * 5])))
    return out + [(c, t, "user", f"turn {t % 7}") for c in (500, 501, 502, 599) for t in range(300)] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("block", [1, 7, 20_000])
def test_trie(spark, block):
    rows = conversations(block)
    want, _ = plain(rows)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(*x, "s", 1, "k", 2) for x in rows], SCHEMA).repartition(3)
        got = prefixes.trie(prefixes.grafted(prefixes.sequences(df)), block=block).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(prefixes.grafted(prefixes.sequences(none))).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    df = spark.createDataFrame([(c, 0, "user", "x", "s", 1, "k", 2)], SCHEMA)
    assert [tuple(r) for r in prefixes.trie(prefixes.grafted(prefixes.sequences(df))).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_many_ids_at_one_node(spark):
    """Ids of one node are packed in runs and hashed in numeric order."""
    got = prefixes.ends(spark.range(-9000, 30_000, 3).select(F.col("id").alias("conv_id"), F.lit("s").alias("seq")).repartition(7)).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(-9000, 30_000, 3))).encode()).hexdigest()]


def test_union_find_alone():
    seqs = sorted("".join(t * 32 + "00000002" for t in x) for x in ["", "a", "ab", "abc", "abd", "b", "bcd", "bce"])
    got = sorted((n.lo, n.hi, n.depth, n.n, n.children, n.leaves, n.saved) for n in prefixes.forest(seqs, list(range(8)), [1] * 8, ["e"] * 8))
    assert got == [(0, 7, 0, 8, 2, 4, 16), (1, 4, 1, 4, 1, 2, 10), (2, 4, 2, 3, 2, 2, 4), (3, 3, 3, 1, 0, 1, 0), (4, 4, 3, 1, 0, 1, 0), (5, 7, 1, 3, 1, 2, 6), (6, 6, 3, 1, 0, 1, 0), (6, 7, 2, 2, 2, 2, 2), (7, 7, 3, 1, 0, 1, 0)]
