"""Training-text operators against plain sequential code on small tables with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetgraph.llm import bpe, chat, fingerprints, mixing, near, pii, quality, shards, tokens, toxicity
from sheetgraph.llm.native import text_of, word_count

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, ids string, score string, spans string"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta Epsilon zeta eta theta iota kappa".split()) + r.choice(["", "", ".", "\n"]) for _ in range(n))
    base = [say(r.choice([3, 30, 120])) for _ in range(30)]
    texts = base + [base[5], base[5], base[7].upper(), base[9] + " one more", None, "", "  \n ", "x" * 3000, "1 " * 4000, say(6000),
                    "mail a.b@c.de, a@b.c_d@e.f 10.0.0.255 1.2.3.400 call +1 (826) 555-4081 4111 1111 1111 1111 | 12 4111 1111 1111 1111 <|endoftext|>"]
    return [(i, t, "en", [None, "a", "b"][i % 3], 0, "s", "i", "c", "p") for i, t in enumerate(texts)] + [(3, base[3], None, None, None, None, None, None, None), (None, base[4], None, "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def base_spans(t):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    out = []
    for k, p in pats.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) < 256 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), pii.KINDS.index(k), m.end(), k))
    return sorted(out)


def test_personal_data(docs, rows, none):
    got = pii.found(docs, keep=["doc_id", "text"]).withColumn("m", pii.masked(text_of("text"), F.col("spans"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(r.text)
        assert [tuple(s) for s in r.base] == want and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
        at, out = 0, ""
        for s, _, e, kind in sorted(map(tuple, r.spans)):
            if s >= at:
                out += (r.text or "")[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        assert r.m == out + (r.text or "")[at:]
    assert any("@" in (r.text or "") and "@" not in r.m for r in got)
    assert pii.found(none).count() == 0


def test_bpe_and_counts(docs, rows, none):
    t = Tokenizer.from_file(PATH)
    for r in bpe.encoded(docs, PATH).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    other = public_tokenizers.path("byte_bpe_50k.json")
    u = Tokenizer.from_file(other)
    for r in docs.select("text", tokens.n_tokens(F.col("text"), other).alias("n")).collect():
        assert r.n == len(u.encode(r.text or "", add_special_tokens=False).ids)
    assert bpe.encoded(none, PATH).count() == 0
    long = "word and " * 40_000
    assert len(tokens.cut_safely(long)) > 3 and tokens.lengths([long], other)[0] == len(u.encode(long, add_special_tokens=False).ids)


def test_chunks_repair_odd_text():
    r, reuse = random.Random(5), bpe.Reuse(PATH)
    parts = ["a", "Bé", "é", "́", " ", "  ", "\n", "\t", " ", "<|endoftext|>", "<|endo", "ftext|>", "12", "'s", "Σ", "日本", "!!", "x" * 50, "\U0001F600", "the ", "of ", " (word), ", " End.) ", " don't. ", " *a<|endoftext|>. ", " x% "]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 50, 400, 2000])))
        assert reuse.ids([t])[0].tolist() == reuse.tokenizer.encode(t, add_special_tokens=False).ids


def test_sharding(docs, rows, none):
    got = shards.by_bytes(docs).collect()
    assert len(got) == len(rows)
    by, of, byte_sum = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in got:
        by[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
        byte_sum[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(len(s) == 1 for s in of.values())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    sums, tree = shards.differenced([([0, 0, x], i) for i, x in enumerate([8, 7, 6, 5, 4, 3])], 3)
    assert sums == [11, 11, 11] and {i for i, _ in shards.placed(tree, 3)} == set(range(6))
    assert shards.by_bytes(none).count() == 0


@pytest.mark.parametrize("width,percent,block", [(4, 85, 10**9), (5, 80, 300)])
def test_jaccard_join(spark, rows, docs, none, width, percent, block):
    r = random.Random(9)
    more = []
    for k in range(12):
        w = [f"w{k}_{i}" for i in range(120)]
        for c in range(8):
            v = list(w)
            for _ in range(r.randrange(0, 5)):
                v[r.randrange(120)] = f"x{r.random()}"
            more.append((1000 + 10 * k + c, " ".join(v)))
    d = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id bigint, text string").withColumn("source", F.lit("z")))
    every = [(x[0], x[1]) for x in rows] + more
    of = lambda t: (lambda w: frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))((t or "").encode().lower().split())
    ids = [(i, of(t)) for i, t in every if i is not None]
    root = {i: i for i, _ in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, s in ids:
        for b, t in ids:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near.linked(d, width=width, percent=percent, block=block).collect()
    assert len(got) == len(every)
    assert all(g.component_id == (None if g.doc_id is None else find(g.doc_id)) for g in got)
    assert sorted(g.n_shingles for g in got) == sorted(len(of(t)) for _, t in every)
    if percent == 80:
        left = [x.doc_id for x in near.one_of_each(d).collect()]
        assert sorted(i for i in left if i is not None) == sorted({find(i) for i, _ in ids}) and left.count(None) == 1
        assert near.linked(none).count() == 0


def test_quality(docs, rows, none):
    book = quality.ledger(docs)
    for r in book.collect():
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = collections.Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
        hit = {j for i in range(len(ws) - 7) if runs[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == book.filter("failure_bits = 0").count()
    cost = {r.rule: r for r in quality.ablations(book).collect()}
    assert cost["few_words"].n_failed == book.filter("n_words < 20").count() and quality.ledger(none).count() == 0


def test_toxicity(spark, docs, none):
    r = random.Random(2)
    rows = []
    for i in range(400):
        s = [" ".join(r.choice("one two three four five six".split()) for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            s[r.randrange(5)] += " dreadfulness"
        rows.append((i, ". ".join(s) + ".", int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(toxicity.sample(d.select("doc_id", "text"), d.select("doc_id", "toxic"), F.col("doc_id") % 3 != 1))
    got = toxicity.scored(d, model).collect()
    assert sum((g.score >= 0.7) != bool(g.toxic) for g in got) < 8
    assert all("dreadful" in g.text[o.s:o.e] for g in got for o in g.offending)
    flat = toxicity.scored(docs, toxicity.Model()).collect()
    assert all(0 <= g.score < 0.01 for g in flat) and toxicity.scored(none, model).count() == 0


def test_fingerprints(docs, rows, none):
    d = fingerprints.with_next_text(docs, bucket=4).withColumn("e", fingerprints.edited(F.col("text"), F.col("next_text")))
    got = d.select("doc_id", "text", "next_text", "e", fingerprints.sketch(F.col("text")).alias("a"), fingerprints.sketch(F.col("e")).alias("b"))
    got = got.select("*", fingerprints.likeness(F.col("a"), F.col("b")).alias("j"), fingerprints.likeness(F.col("a"), F.col("a")).alias("own"), fingerprints.as_text(F.col("a")).alias("s")).collect()
    order = sorted((r[0] if r[0] is not None else -1 for r in rows))
    assert len(got) == len(rows) and all(g.own == 1 for g in got)
    assert len({(g.text, g.s) for g in got}) == len({g.text for g in got})
    text = {r[0]: r[1] or "" for r in rows}
    assert next(g.next_text for g in got if g.doc_id == order[-1]) == text[None]
    for g in got:
        cut = len(g.text) // 4
        assert g.e == g.text[:len(g.text) - cut] + g.next_text[:cut]
        if g.doc_id not in (None, 3) and g.doc_id != order[-1] and g.doc_id != 2:
            assert g.next_text == text[g.doc_id + 1]
        of = lambda t: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(t.split())
        a, b = of(g.text), of(g.e)
        assert abs(g.j - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
    assert fingerprints.with_next_text(none).count() == 0


def test_mixing(docs, rows, none):
    sized = lambda d: d.withColumn("size", word_count(text_of("text"))).withColumn("tie", F.xxhash64("text"))
    got = mixing.with_copies(sized(docs), tie=F.col("tie")).collect()
    again = mixing.with_copies(sized(docs).repartition(7), tie=F.col("tie")).collect()
    assert len(got) == len(rows) and collections.Counter((g.doc_id, g.size, g.copies) for g in got) == collections.Counter((g.doc_id, g.size, g.copies) for g in again)
    size = collections.Counter()
    for g in got:
        size[g.source] += g.size
    order = sorted(size, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(size.values())
    while free:
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * size[s]]
        if not over:
            target.update({s: rest * w[s] / sum(w[x] for x in free) for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
        rest -= sum(target[s] for s in over)
        free -= set(over)
    big = max(g.size for g in got)
    for s in order:
        taken = sum(g.size * g.copies for g in got if g.source == s)
        assert abs(taken - target[s]) <= 2 * big and all(abs(g.target - target[s]) < 1e-6 and 0 <= g.copies <= 2 for g in got if g.source == s)
    assert mixing.mixed(sized(docs), tie=F.col("tie")).count() == sum(g.copies for g in got) and mixing.with_copies(sized(none)).count() == 0


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", None, "", "<</turn>\n", "###\n### user\n", "\\s\\h\\l\\n", "plain \U0001F600", "##", "a" * 5000]
    roles = ["user", "assistant", "assistant", None, "### x\n", "user\\n", "system"]
    r = random.Random(1)
    rows = [(c if c else None, r.choice([i, None]), r.choice(roles), r.choice(hard), "x") for c in range(12) for i in range(r.randrange(1, 40))]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string"))
    got = {g.conv_id: g for g in out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in {x[0] for x in rows}:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode()))]
        assert [tuple(t) for t in got[c].t] == want and got[c].loss == "".join(t for role, t in want if role == "assistant")
    assert chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_pipeline_against_plain_code(spark, docs, rows, none):
    import corpus_pipeline
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = d.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    t = Tokenizer.from_file(PATH)
    key = lambda i, text: (i, hashlib.sha256(t.decode(t.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest())
    assert collections.Counter(key(x.doc_id, x.text) for x in mixed) == collections.Counter((x.doc_id, x.decoded_sha256) for x in out)
    e = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        e = stage(spark, e, "")
    assert e.count() == 0


def test_frequent_forms_are_selected(spark):
    r = random.Random(4)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(80):
        texts += [f"mail u{i}.x@host{i}.com now", f"call +1 (826) 555-{num(4)} now", f"see x{num(3)}-555-{num(4)}z and 4111 1111 1111 1112 there"]
        texts += [f"mail u{i} [at] host{i} [dot] com now", f"call (826) 555-{num(4)} now", f"code 978-826-555-{num(4)}-3-1 here"]
    got = {x.text: x for x in pii.found(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()}
    for t in texts:
        kinds = [(x.kind, t[x.s:x.e]) for x in got[t].spans if x.kind != "card"]  # some codes happen to be card numbers
        if t.startswith("mail"):
            assert kinds == [("email", t[5:-4])], (t, kinds)
        elif t.startswith("call"):
            assert kinds == [("phone", t[5:-4])], (t, kinds)
        else:
            assert kinds == [], (t, kinds)


@pytest.mark.parametrize("twice", [False, True])
def test_one_of_each_with_repeated_ids(spark, twice):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, say(1)), (3, say(1) + " more"), (None, say(2)), (None, say(2)), (5, ""), (6, " ")]
    want = [(1, say(1)), (None, say(2)), (None, say(2)), (5, ""), (6, " ")]
    if twice:  # 3 stands for a near copy and for a text of its own, 4 for one text twice, 7 for two near copies
        rows += [(3, say(3)), (4, say(4)), (4, say(4)), (5, ""), (7, say(7)), (7, say(7) + " more")]
        want += [(3, say(3)), (4, say(4))]
    got = [tuple(x) for x in near.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted([x for x in got if x[0] != 7], key=key) == sorted(want, key=key) and sum(x[0] == 7 for x in got) == twice


@pytest.mark.parametrize("failing", [3, 300])
def test_failing_matches_are_never_spans(spark, failing):
    """Base matches that fail their check stay out, whether they are one in a hundred or half of all."""
    good = [f"write to a{i}@b.org or 10.0.{i % 256}.7, card 4111 1111 1111 1111, call +1 (826) 555-{4000 + i}" for i in range(300)]
    bad = [f"see 1.2.3.{400 + i} and 4111 1111 1111 1112 and +12 34" for i in range(failing)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    for r in pii.found(d).collect():
        assert [tuple(x) for x in r.base] == base_spans(r.text)
        assert len(r.spans) == (4 if r.doc_id < 300 else 0), r.text
