"""Near duplicates at size: chance pairs do not grow into one cluster, and nothing that is broadcast grows with the table."""

import random

from pyspark.sql import functions as F

from sheetgraph.llm import near


def prepared(d, width=4, percent=85):
    every = near.stored(near.sets(d, "doc_id", "text", width, percent))
    usable = every.filter("n > 0 and id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("id", "n", "m0", "seen")).alias("r")).select(F.col("r.id").alias("rid"), "r.n", "r.m0", "r.seen")
    return near.stored(near.prefixes(classes, percent)), usable


def test_chance_pairs_stay_apart(spark):
    # each text quotes sixty words of the next; two others differ in one word
    words = [[f"w{i}_{j}" for j in range(150)] for i in range(60)]
    texts = [(i, " ".join(w + (words[i + 1][40:100] if i < 59 else []))) for i, w in enumerate(words)]
    twin = [f"t{j}" for j in range(150)]
    texts += [(100, " ".join(twin)), (101, " ".join([*twin[:-1], "other"]))]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    prefix, usable = prepared(d)
    # some quotes are shared shingles of prefixes, so sharing alone would chain the texts
    assert prefix.filter("rid < 100").groupBy("t").count().filter("count > 1").count() > 20
    assert [tuple(x) for x in near.candidates(prefix, usable, 85).collect()] == [(100, 101)]


def families(r):
    texts = []
    for k in range(25):
        w = [f"w{k}_{i}" for i in range(r.randrange(30, 120))] + [f"quote{i}" for i in range(9)]
        for _ in range(r.randrange(1, 12)):
            v = list(w)
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = f"x{r.random()}"
            texts.append(" ".join(v[:len(v) - r.randrange(0, 8)]))
    return [*enumerate(texts)]


def components(texts, width, percent):
    of = {i: {tuple(t.split()[k:k + width]) for k in range(len(t.split()) - width + 1)} for i, t in texts}
    root = {i: i for i in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in of:
        for b in range(a):
            if 100 * len(of[a] & of[b]) >= percent * len(of[a] | of[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in of}


def test_links_are_whole_however_lists_and_broadcasts_are_bounded(spark, monkeypatch):
    texts = families(random.Random(4))
    d = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    want = components(texts, 4, 85)
    assert 20 < len(set(want.values())) < len(texts)
    for few, rows in ((1, 100_000), (3, 3), (10**6, 3)):
        monkeypatch.setattr(near.candidates, "__defaults__", (few,))
        monkeypatch.setattr(near, "BROADCAST_ROWS", rows)
        assert {x.doc_id: x.component_id for x in near.linked(d, width=4, percent=85, block=400).collect()} == want
    assert sorted(x.doc_id for x in near.one_of_each(d, width=4, percent=85).collect()) == sorted(set(want.values()))


def test_bitmap_of_ids_is_bounded_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_ROWS", 50)
    rows = spark.range(10_000).withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    got = near.maybe_in(rows, "id", spark.range(0, 2000, 2).withColumnRenamed("id", "key"), "key")
    assert got.columns == ["id", "__maybe"] and got.count() == 10_000
    assert got.filter("id % 2 = 0 AND id < 2000 AND NOT __maybe").isEmpty()
    assert got.filter("id >= 2000 AND __maybe").count() < 3000 and not got.filter("id IS NULL").first()["__maybe"]
