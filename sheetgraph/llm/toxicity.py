"""Toxicity by multiple-instance learning.

Labels belong to documents, causes to sentences. A sentence's probability is a logistic function of its distinct words and their
beginnings; a document's is the noisy-or of its sentences, so it can be trained from document labels, and the sentences that carry it are the offending
ones. The model is fitted on the driver to a bounded sample: at most `SAMPLE` labelled documents of each class, chosen by a hash
of the id, of at most `SAMPLE_CHARS` characters each. A feature must occur in `MIN_DOCS` of them and differ between the classes by a
likelihood ratio of `MIN_RATIO`, so the table of weights that goes to the executors is small and bounded by the sample. The last fifth of the sample is left out of the fit and sets the
operating point: the noisy-or value with the best F1 there becomes the score 0.7.

Scores depend on the text only. Nulls: a null or empty text has no sentences and score 0; labels that are null or belong to no
document are unused; a document with several labels is toxic if one says so. Without labels of both classes every score is
0. Repeated rows are scored each; an empty table gives an empty result. Extra columns are kept, `score` and `offending` replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE, SAMPLE_CHARS, MIN_DOCS, MIN_RATIO = 3000, 20_000, 5, 14.0
BEGINNINGS = (4, 5, 6)
HELD_WORDS = 500_000  # words whose weight a task remembers
EPOCHS, STEP, DECAY = 60, 0.15, 1e-4
OPERATING = 0.7
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0
    shift: float = 0.0
    memo: dict[str, float] = field(default_factory=dict)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", n: int = SAMPLE) -> list[tuple[str, int]]:
    """At most n texts of each class."""
    marked = labels.filter(usable & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("y"))
    # twice the number, since some labels have no document or a long one; two bounded lists of ids
    pick = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * n) for y in (0, 1)]
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(F.length("text").between(1, SAMPLE_CHARS))
    got = d.join(F.broadcast(pick[0].unionByName(pick[1])), "id").orderBy("y", F.xxhash64("id"), "id", "text")
    each = [got.filter(F.col("y") == y).limit(n) for y in (0, 1)]
    return [(r["text"], int(r["y"])) for r in each[0].unionByName(each[1]).collect()]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    return [(m.start(), m.end(), set(WORD.findall(m.group().lower()))) for m in SENTENCE.finditer(text)]


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a caret."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def telling(seen: list[dict[str, int]], n: list[int]) -> list[str]:
    """Features whose document counts in the two classes are unlikely under one common rate."""
    def ratio(a, b):
        both, out = (a + b) / (n[0] + n[1]), 0.0
        for k, m in ((a, n[0]), (b, n[1])):
            out += sum(x * math.log(x / e) for x, e in ((k, m * both), (m - k, m * (1 - both))) if x and e)
        return 2 * out
    out = []
    for w in sorted(set(seen[0]) | set(seen[1])):
        a, b = seen[0].get(w, 0), seen[1].get(w, 0)
        if a + b >= MIN_DOCS and ratio(a, b) >= MIN_RATIO:
            out.append(w)
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """Gradient descent on the class-balanced log loss of the noisy-or."""
    if len({y for _, y in rows}) < 2:
        return Model()
    rows = [rows[i] for i in np.random.default_rng(7).permutation(len(rows))]
    bags = [[w for _, _, w in sentences(t)] for t, _ in rows]
    fitted = np.arange(len(rows)) < 0.8 * len(rows)
    seen: list[dict[str, int]] = [{}, {}]
    for bag, (_, label), use in zip(bags, rows, fitted):
        for w in {f for s in bag for x in s for f in features(x)} if use else ():
            seen[label][w] = seen[label].get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(telling(seen, [sum(v == k for (_, v), use in zip(rows, fitted) if use) for k in (0, 1)]))}
    y = np.array([v for _, v in rows], float)
    words = [[vocabulary[f] for w in s for f in features(w) if f in vocabulary] for bag in bags for s in bag]
    s_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    w_sent = np.repeat(np.arange(len(words)), [len(w) for w in words])
    w_id = np.array([i for w in words for i in w], np.int64)
    cost = np.where(y == 1, 0.5 / max(1, y[fitted].sum()), 0.5 / max(1, (1 - y)[fitted].sum())) * fitted * len(rows)
    theta, bias = np.zeros(len(vocabulary)), -4.0
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0

    def forward():
        z = np.bincount(w_sent, theta[w_id], len(words)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(s_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(rows))  # log probability that no sentence is toxic
        return p, none

    for epoch in range(1, EPOCHS + 1):
        p, none = forward()
        q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p for clean documents, -(1 - q) / q * p for toxic ones
        g = cost[s_doc] * p * np.where(y[s_doc] == 1, -(1 - q[s_doc]) / q[s_doc], 1.0) / len(rows)
        gt, gb = np.bincount(w_id, g[w_sent], len(theta)) + DECAY * theta / 10, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gt, 0.999 * v + 0.001 * gt * gt, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** epoch, 1 - 0.999 ** epoch
        theta -= STEP * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= STEP * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    q = np.clip(-np.expm1(forward()[1]), 1e-9, 1 - 1e-9)
    held = ~fitted if len(set(y[~fitted])) == 2 else fitted
    order = np.argsort(-q[held], kind="stable")
    hits = np.cumsum(y[held][order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + y[held].sum())
    k = int(np.argmax(f1))
    here = q[held][order]
    low = here[k + 1] if k + 1 < len(here) else here[k] / 2
    logit = lambda x: math.log(x / (1 - x))
    cut = (logit(here[k]) + logit(max(low, 1e-9))) / 2
    return Model({w: float(theta[i]) for w, i in vocabulary.items() if theta[i]}, bias, logit(OPERATING) - cut)


def judged(text: str, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text and its offending sentences (start, end, probability): those that would reach the operating point alone."""
    known, log_none, out = model.memo, 0.0, []
    if len(known) > HELD_WORDS:
        known.clear()
    odds = lambda p: math.log(p / (1 - p)) + model.shift
    for a, b, ws in sentences(text):
        z = model.bias
        for w in ws:
            x = known.get(w)
            if x is None:
                x = known[w] = sum(model.weights.get(f, 0.0) for f in features(w))
            z += x
        p = min(1 / (1 + math.exp(-min(z, 30.0))) if z > -30 else math.exp(z), 1 - 1e-9)
        log_none += math.log1p(-p)
        if p > 1e-9 and 1 / (1 + math.exp(-odds(p))) >= OPERATING:
            out.append((a, b, p))
    q = min(max(-math.expm1(log_none), 1e-12), 1 - 1e-9)
    return (0.0 if not log_none else 1 / (1 + math.exp(-odds(q)))), out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows with score and offending (array of s, e, p; code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("struct<score:double, offending:array<struct<s:int,e:int,p:double>>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [judged(t or "", shared.value) for t in texts]
            yield pd.DataFrame({"score": [g[0] for g in got], "offending": [[{"s": a, "e": b, "p": p} for a, b, p in g[1]] for g in got]})

    return docs.withColumn("__j", judge(F.coalesce(F.col(text), F.lit("")))).withColumns({"score": F.col("__j.score"), "offending": F.col("__j.offending")}).drop("__j")
