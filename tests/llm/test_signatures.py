"""Ranked search against plain scoring of every document, and the bounds that exclude documents."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from sheetgraph.llm import signatures

DOCS = "doc_id bigint, text string, key string, score double, query int, rank int"
ITEMS = "item_id bigint, text string, query int, key string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
found = lambda t: TERM.findall((t or "").translate(lower))


def plain(docs, items, wanted):
    held = [(d, collections.Counter(found(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(found(text)) if c[t])
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:wanted])]
    return out


def data(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "éa", "naïve", "日本", "x1y2"]
    say = lambda n: r.choice([" ", "-", "_ ", "\x00", "\n"]).join(r.choice(vocabulary[:r.choice([20, 400, 405])]).capitalize() if r.random() < 0.2 else r.choice(vocabulary) for _ in range(n))
    docs = [(i, say(r.choice([1, 5, 40, 200, 900]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [docs[9], docs[9], (None, docs[11][1]), (None, None), (2000, ""), (2001, "  ,;"), (2002, "w1 " * 50_000), (2003, " ".join(f"u{i}" for i in range(60_000))), (2004, "z" * 1_000_000)]
    items = [(i, say(r.choice([1, 8, 40]))) for i in range(20)] + [(3, docs[7][1]), (None, docs[9][1]), (50, None), (51, "absent"), (52, ""), (53, "w1 w1 W1"), (54, "z" * 1_000_000), (55, "U5 u59999")]
    return docs, items


@pytest.mark.parametrize("wanted", [1, 50])
def test_search(spark, wanted):
    docs, items = data(wanted)
    got = signatures.search(spark.createDataFrame([(*d, "k", 1.0, 2, 3) for d in docs], DOCS).repartition(5), spark.createDataFrame([(*i, 1, "k") for i in items], ITEMS), wanted)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, items, wanted), key=key)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1, "k")], ITEMS)
    assert signatures.search(none, items).count() == 0
    assert signatures.search(spark.createDataFrame([(1, "a", "k", 1.0, 2, 3)], DOCS), items.filter("false")).count() == 0
    assert signatures.search(spark.createDataFrame([(1, None, "k", 1.0, 2, 3)], DOCS), items).count() == 0


def test_queries_are_taken_in_chunks(spark):
    items = spark.createDataFrame([(i, f"a{i} b", 1, "k") for i in range(2500)], ITEMS)
    sizes = [len(c) for c in signatures.chunks(items)]
    assert sum(sizes) == 2500 and max(sizes) <= signatures.QUERIES and len(sizes) == 3


def test_bounds_are_never_below_scores_and_exclude_most():
    docs, items = data(5)
    held = [(i, t.encode()) for i, (_, t) in enumerate(docs) if found(t)]
    b, rows = signatures.Builder(), []
    for i, t in held:
        rows += b.add(i, t)
    rows += b.rest()
    df = collections.Counter(t for r in rows if "terms" in r for t, n in zip(r["terms"], r["dfs"]) for _ in range(n))
    scale = (len(held), sum(n for r in rows if "bits" in r for n in r["lengths"]))
    asked = [sorted(set(signatures.terms((t or "").encode()))) for _, t in items]
    vocabulary = sorted({t for ts in asked for t in ts if df[t]})
    triples = [(q, vocabulary.index(t), math.floor(1000 * math.log((2 * scale[0] + 2) / (2 * df[t] + 1)))) for q, ts in enumerate(asked) for t in ts if df[t]]
    c = signatures.Chunk([i for i, _ in items], vocabulary, *(np.array(x, np.int64) for x in zip(*triples)), scale, 10)
    asked, seen, equal = c.by_query(), 0, 0
    for r in (r for r in rows if "bits" in r):
        ub = signatures.bounds(r, c, np.array([zlib.crc32(t) for t in vocabulary], np.uint32))
        for j, i in enumerate(r["columns"]):
            n = collections.Counter(signatures.terms(docs[i][1].encode()))
            m = signatures.measure(sum(n.values()), scale)
            for q, ts in enumerate(asked):
                score = sum(w * (10**9 * n[t] // (1000 * n[t] + 20 * m)) for t, w in ts if n[t])
                assert ub[q, j] >= score
                seen, equal = seen + 1, equal + (ub[q, j] <= 1.5 * score)
    assert equal > 0.8 * seen
