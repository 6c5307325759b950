"""Lookups by index against plain scans of the nodes."""

import random

import pytest
from pyspark.sql import functions as F

from sheetgraph.operators import lookup

NODES = "sheet_id long, id string, node_type string, cls_name string, tag_function string, loop_number string, raw_text string, parse_status string"
REQ = "sheet_id long, req_id string, want_node_type string, want_cls_name string, want_function string, want_contains string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    pick = lambda *xs: r.choice([None, *xs])
    nodes = [(s, f"sym_{i}", r.choice(["valve", "instrument"]), pick("gate", "ball"), pick("PT", "FT", ""), pick("1", "22"), pick("PT 1401", "ft-9", "", "é 14", "aaaa"), "ok") for s in (1, 2) for i in range(40)]
    asked = [(s, f"r{k}", pick("valve", "pump"), pick("gate", "none"), pick("PT", "ZZ", ""), pick("14", "FT-9", "", "aaa", "aaaaa", "é", "x", "t 14", "401"), ) for s in (1, 2, 3) for k in range(60)]
    return nodes, asked


def fits(n, q):
    return n[0] == q[0] and all(q[i] is None or n[j] == q[i] for i, j in ((2, 2), (3, 3), (4, 4))) and (q[5] is None or q[5].lower() in (n[6] or "").lower())


def test_find_and_count(spark, rows):
    nodes, asked = rows
    n, q = spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, REQ)
    assert {(r.sheet_id, r.req_id, r.id) for r in lookup.find_nodes(n, q).collect()} == {(*x[:2], y[1]) for x in asked for y in nodes if fits(y, x)}
    got = {(r.sheet_id, r.req_id, r.node_type): r.n for r in lookup.count_nodes(n, q).collect()}
    want = {}
    for x in asked:
        hit = [y for y in nodes if fits(y, (*x[:5], None))]
        want[(*x[:2], None)] = len(hit)
        if x[2:5] == (None, None, None):
            want |= {(*x[:2], t): sum(y[2] == t for y in hit) for t in {y[2] for y in hit}}
    assert got == want


def test_texts_under_their_rarest_piece(spark):
    texts, terms = ["", "a", "ab", "abab", "xabcabcx", "ünder", "ü", None], ["", "a", "ab", "abc", "bca", "cab", "abcabc", "zzz", "ün", "und", None]
    t = spark.createDataFrame([(1, x) for x in texts], "sheet_id long, raw string")
    q = spark.createDataFrame([(s, x) for s in (1, 2) for x in terms], "sheet_id long, t string")
    got = {(r.sheet_id, r.t, r.raw) for r in lookup.holding(t, q).collect()}
    assert got == {(1, x, y) for x in terms if x is not None for y in texts if y is not None and x in y}


def test_terms(spark, rows):
    nodes, _ = rows
    terms = [(s, f"t{i}", x) for s in (1, 2) for i, x in enumerate(["14", "PT", "gate", "valve", "no such text", "é"])]
    n, t = spark.createDataFrame(nodes, NODES), spark.createDataFrame(terms, "sheet_id long, term_id string, term string")
    got = {(r.sheet_id, r.term_id): r.n_contains for r in lookup.resolve_term(n, t).collect()}
    assert got == {(s, i): sum(y[0] == s and x.lower() in (y[6] or "").lower() for y in nodes) for s, i, x in terms}
    held = {(r.sheet_id, r.term_id, r.id) for r in lookup.term_matches(n, t).collect()}
    assert held == {(s, i, y[1]) for s, i, x in terms for y in nodes if y[0] == s and y[6] is not None and x.lower() in y[6].lower()}
