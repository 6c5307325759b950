"""Grounded lookups over exported graphs: nodes(sheet_id, id, node_type, cls_name, tag_function, loop_number, raw_text,
parse_status, ...) and edges(sheet_id, u, v, branch_type, ...). Every lookup answers a whole table of requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.functions.geometry import n_rows
from sheetgraph import params as P
from sheetgraph.functions import geometry as g, text
from sheetgraph.operators.suppress import SHEET

FILTERS = ["want_node_type", "want_cls_name", "want_function", "want_contains"]


def read_ok() -> Column:
    return (F.col("node_type") == "instrument") & F.col("parse_status").isin(P.READ_OK)


def _fits(n="") -> Column:
    """Whether a node meets every filter a request sets."""
    free = lambda w: F.col(w).isNull()
    return (
        (free("want_node_type") | (F.col("node_type") == F.col("want_node_type"))) & (free("want_cls_name") | (F.col("cls_name") == F.col("want_cls_name")))
        & (free("want_function") | F.coalesce(F.col("tag_function") == F.col("want_function"), F.lit(False)))
    )


def _holds() -> Column:
    return F.col("want_contains").isNull() | F.contains(F.lower(F.coalesce("raw_text", F.lit(""))), F.lower("want_contains"))


GRAM = 3  # length of the pieces by which texts are found


def _pieces(c: Column, sizes) -> Column:
    """Distinct pieces of a text of the given lengths; null for a null text."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def holding(texts: DataFrame, terms: DataFrame, keys=SHEET) -> DataFrame:
    """(t, raw) for every text `raw` of the same keys that contains the term `t`; both lower-cased.

    Texts are listed under their pieces of one to three characters. A term meets only the texts under the rarest of its own pieces, or
    under itself if it is that short, and none if one of its pieces occurs nowhere. The empty term is in every text.
    """
    keys = list(keys)
    under = texts.select(*keys, "raw").filter("raw IS NOT NULL").distinct()
    under = under.select(*keys, "raw", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), _pieces(F.col("raw"), range(1, GRAM + 1))))).alias("piece"))
    asked = terms.select(*keys, "t").filter("t IS NOT NULL").distinct()
    asked = asked.select(*keys, "t", F.explode(F.when(F.length("t") >= GRAM, _pieces(F.col("t"), [GRAM])).otherwise(F.array("t"))).alias("piece"))
    under = under.join(asked.select(*keys, "piece").distinct(), [*keys, "piece"], "left_semi")
    n = asked.join(under.groupBy(*keys, "piece").agg(n_rows().alias("n")), [*keys, "piece"], "left")
    rare = n.groupBy(*keys, "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "piece")).alias("p")).filter("p.n > 0").select(*keys, "t", F.col("p.piece").alias("piece"))
    return rare.join(under, [*keys, "piece"]).filter(F.contains("raw", "t")).select(*keys, "t", "raw")


def find_nodes(nodes: DataFrame, requests: DataFrame, keys=SHEET) -> DataFrame:
    """Light rows of all nodes meeting each request; sort by req_id and text.id_order(id) to list them.

    Nodes are listed under their type, class, function and the texts asked for. A request looks under the rarest of its filters and
    checks the others there; only one without any filter meets all nodes of its sheet, which is its answer.
    """
    keys = list(keys)
    raw, asked_text = F.lower(F.coalesce("raw_text", F.lit(""))), F.lower("want_contains")
    held = holding(nodes.select(*keys, raw.alias("raw")), requests.select(*keys, asked_text.alias("t")), keys)
    by_text = nodes.select(*keys, "id", raw.alias("raw")).join(held, [*keys, "raw"]).select(*keys, F.lit("contains").alias("axis"), F.col("t").alias("value"), "id")
    axes = lambda *cs: F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), v.alias("value")) for a, v in cs])).alias("x")
    three = ("node_type", "cls_name", "tag_function")
    listed = nodes.select(*keys, "id", axes(("all", F.lit("")), *[(c, F.col(c)) for c in three])).select(*keys, "x.axis", "x.value", "id").unionByName(by_text).filter("value IS NOT NULL")
    r = requests.select(*keys, "req_id", *FILTERS)
    wants = [("all", F.lit("")), *zip(three, map(F.col, FILTERS[:3])), ("contains", asked_text)]
    asked = r.select(*keys, "req_id", *FILTERS, axes(*wants)).select(*keys, "req_id", *FILTERS, "x.axis", "x.value").filter("value IS NOT NULL")
    listed = listed.join(asked.select(*keys, "axis", "value").distinct(), [*keys, "axis", "value"], "left_semi")
    n = asked.join(listed.groupBy(*keys, "axis", "value").agg(n_rows().alias("n")), [*keys, "axis", "value"], "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "axis", "value")).alias("p")
    best = n.groupBy(*keys, "req_id", *FILTERS).agg(least).filter("p.n > 0").select(*keys, "req_id", *FILTERS, "p.axis", "p.value")
    d = best.join(listed, [*keys, "axis", "value"]).join(nodes, [*keys, "id"]).filter(_fits() & _holds())
    return d.select(*keys, "req_id", "id", "node_type", "cls_name", text.tag_summary(F.col("tag_function"), F.col("loop_number")).alias("tag_summary"))


def find_alternatives(nodes: DataFrame, requests: DataFrame, keys=SHEET) -> DataFrame:
    """For tag requests without a match, what does exist on the sheet: function codes, or texts for substring requests."""
    hit = find_nodes(nodes, requests, keys).select(*keys, "req_id").distinct()
    miss = requests.join(hit, [*keys, "req_id"], "left_anti").filter("want_function is not null or want_contains is not null")
    kind = F.when(F.col("want_function").isNotNull(), "function").otherwise("text")
    known = nodes.filter(read_ok()).select(*keys, F.explode(F.array(F.struct(F.lit("function").alias("kind"), F.col("tag_function").alias("existing")),
                                                                  F.struct(F.lit("text").alias("kind"), F.col("raw_text").alias("existing")))).alias("k"))
    known = known.select(*keys, "k.*").filter("length(existing) > 0").distinct()
    return miss.select(*keys, "req_id", kind.alias("kind")).join(known, [*keys, "kind"])


def get_node(nodes: DataFrame, ids: DataFrame, keys=SHEET) -> DataFrame:
    """The full row of each requested id, or error not_found."""
    return ids.join(nodes.withColumn("__hit", F.lit(1)), [*keys, "id"], "left").withColumn("error", F.when(F.col("__hit").isNull(), "not_found")).drop("__hit")


def neighbours(nodes: DataFrame, edges: DataFrame, keys=SHEET) -> DataFrame:
    """Adjacency rows in both directions with the neighbour's type, class and tag and the edge's provenance."""
    keys = list(keys)
    extra = [c for c in ("branch_type", "flow_direction", "length_px") if c in edges.columns]
    e = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("neighbor_id"), *extra)
    e = e.unionByName(edges.select(*keys, F.col("v").alias("id"), F.col("u").alias("neighbor_id"), *extra))
    n = nodes.select(*keys, F.col("id").alias("neighbor_id"), F.col("node_type").alias("neighbor_node_type"), F.col("cls_name").alias("neighbor_cls_name"),
                     text.tag_summary(F.col("tag_function"), F.col("loop_number")).alias("neighbor_tag_summary"))
    prov = g.provenance(F.coalesce("branch_type", F.lit("")))
    return e.join(n, [*keys, "neighbor_id"], "left").withColumn("provenance", prov)


def get_neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, keys=SHEET) -> DataFrame:
    """One-hop neighbours of each requested id; one row with error not_found for ids the sheet does not have."""
    keys = list(keys)
    known = nodes.select(*keys, "id")
    found = ids.join(known, [*keys, "id"], "left_semi").join(neighbours(nodes, edges, keys), [*keys, "id"]).withColumn("error", F.lit(None).cast("string"))
    lost = ids.join(known, [*keys, "id"], "left_anti").withColumn("error", F.lit("not_found"))
    return found.unionByName(lost, allowMissingColumns=True)


def count_nodes(nodes: DataFrame, requests: DataFrame, keys=SHEET) -> DataFrame:
    """Count per request (node_type NULL), and one row per node type for requests without any filter.

    Nodes are counted for each choice of filter columns, so a request finds its count under the columns it sets.
    """
    keys, three = list(keys), ["node_type", "cls_name", "tag_function"]
    mask = lambda cs: sum((F.col(c).isNotNull().cast("int") * 2 ** i for i, c in enumerate(cs)), F.lit(0))
    c = nodes.groupBy(*keys, *three).agg(n_rows().alias("n"))
    c = c.select(*keys, *three, "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("mask")).filter(F.col("mask").bitwiseAND(mask(three)) == F.col("mask"))
    pick = [F.when(F.col("mask").bitwiseAND(2 ** i) > 0, F.col(x)).otherwise("").alias(w) for i, (x, w) in enumerate(zip(three, FILTERS))]
    c = c.select(*keys, "mask", *pick, "n").groupBy(*keys, "mask", *FILTERS[:3]).agg(F.sum("n").alias("n"))
    r = requests.select(*keys, "req_id", mask(FILTERS[:3]).alias("mask"), *[F.coalesce(w, F.lit("")).alias(w) for w in FILTERS[:3]])
    total = r.join(c, [*keys, "mask", *FILTERS[:3]], "left").select(*keys, "req_id", F.lit(None).cast("string").alias("node_type"), F.coalesce("n", F.lit(0)).alias("n"))
    types = c.filter("mask = 1").select(*keys, F.col(FILTERS[0]).alias("node_type"), "n")
    return total.unionByName(r.filter("mask = 0").select(*keys, "req_id").join(types, keys))


def list_tags(nodes: DataFrame, keys=SHEET) -> DataFrame:
    """Instruments whose tag was read, and the distinct classes of off-page connectors (id NULL)."""
    t = nodes.filter(read_ok()).select(*keys, F.lit("instrument_tag").alias("kind"), "id", "tag_function", "loop_number", "raw_text")
    o = nodes.filter("node_type = 'off_page'").select(*keys, F.lit("off_page").alias("kind"), F.lit(None).cast("string").alias("id"),
                                                      F.lit(None).cast("string").alias("tag_function"), F.lit(None).cast("string").alias("loop_number"), F.col("cls_name").alias("raw_text")).distinct()
    return t.unionByName(o)


def resolve_term(nodes: DataFrame, terms: DataFrame, keys=SHEET) -> DataFrame:
    """Which axis a term (term_id, term) belongs to: node_type, cls_name, tag_function, tag_contains or unknown.

    The ids behind tag_contains come from term_matches.
    """
    keys = list(keys)
    cls = nodes.groupBy(*keys, F.col("cls_name").alias("term")).agg(F.min("node_type").alias("cls_node_type"))
    fn = nodes.filter("length(tag_function) > 0").select(*keys, F.col("tag_function").alias("term")).distinct().withColumn("is_function", F.lit(1))
    texts = nodes.filter("raw_text is not null").groupBy(*keys, F.lower("raw_text").alias("raw")).agg(n_rows().alias("k"))
    t = terms.select(*keys, "term_id", F.lower("term").alias("t"))
    sub = t.join(holding(texts, t, keys), [*keys, "t"]).join(texts, [*keys, "raw"]).groupBy(*keys, "term_id").agg(F.sum("k").alias("n_contains"))
    d = terms.join(cls, [*keys, "term"], "left").join(fn, [*keys, "term"], "left").join(sub, [*keys, "term_id"], "left")
    axis = F.when(F.col("term").isin(text.NODE_TYPES), "node_type").when(F.col("cls_node_type").isNotNull(), "cls_name")\
        .when(F.col("is_function") == 1, "tag_function").when(F.col("n_contains") > 0, "tag_contains").otherwise("unknown")
    advice = F.when(axis == "unknown", F.lit("no node_type, cls_name or tag_function of this sheet")).otherwise(F.concat(F.lit("find_nodes("), axis, F.lit("="), "term", F.lit(")")))
    return d.select(*keys, "term_id", "term", axis.alias("axis"), "cls_node_type", F.coalesce("is_function", F.lit(0)).alias("is_function"),
                    F.coalesce("n_contains", F.lit(0).cast("bigint")).alias("n_contains"), advice.alias("recommendation"))


def term_matches(nodes: DataFrame, terms: DataFrame, keys=SHEET) -> DataFrame:
    """One row per term and node whose tag text holds the term; sort by text.id_order(id) to list them.

    Distinct terms meet distinct texts under their rarest piece, and ids are attached afterwards.
    """
    keys = list(keys)
    texts = nodes.filter("raw_text is not null").select(*keys, F.lower("raw_text").alias("raw"), "id")
    t = terms.select(*keys, F.lower("term").alias("t"), "term_id").distinct()
    return t.join(holding(texts, t, keys), [*keys, "t"]).join(texts, [*keys, "raw"]).select(*keys, "term_id", "id").distinct()


def expected(nodes: DataFrame, edges: DataFrame, cls_name: str, function: str, focus: str, keys=SHEET) -> DataFrame:
    """Expected answers per sheet as (question, item, value) rows: counts by type, ids by class and by function with their
    loop numbers, and the neighbours of a focus node with provenance."""
    keys = list(keys)
    row = lambda d, q, i, v: d.select(*keys, F.lit(q).alias("question"), i.alias("item"), v.cast("string").alias("value"))
    counts = row(nodes.groupBy(*keys, "node_type").agg(n_rows().alias("n")), "count_by_type", F.col("node_type"), F.col("n"))
    ids = row(nodes.filter(F.col("cls_name") == cls_name), "ids_of_class", F.col("id"), F.lit(cls_name))
    loops = row(nodes.filter((F.col("node_type") == "instrument") & (F.col("tag_function") == function)), "loops_of_function", F.col("id"), F.col("loop_number"))
    at = neighbours(nodes, edges, keys).filter(F.col("id") == focus)
    near = row(at, "neighbours", F.col("neighbor_id"), F.col("provenance"))
    return counts.unionByName(ids).unionByName(loops).unionByName(near)


LOOKUPS = {"find_nodes": find_nodes, "get_node": get_node, "get_neighbors": get_neighbors, "count_nodes": count_nodes,
           "list_systems_or_lines": list_tags, "resolve_term": resolve_term}
