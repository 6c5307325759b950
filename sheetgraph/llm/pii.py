r"""Personal data: generators propose spans, boosted trees select them.

Four base patterns (fixed, with a check each) give certain spans. Two further generators propose overlapping spans that the base
patterns miss because they do not retry inside a failing match: a number block next to other digits, a phone number without
the international prefix, an address with "[at]" and "[dot]". Every proposal, base matches that fail their check included, gets a small
vector of format and context features. Boosted trees learn which vectors belong to certain spans. Positive are proposals that lie on a
certain span of their kind and pass; negative are others that fail their format check or are contradicted by their context: letters or
digits touch them, or a dot or dash joins a phone number to more digits. What passes beside the certain spans has no label and is not
counted, so how often a form is written never decides whether it is taken. Per kind the threshold lies halfway between the lowest score
down to which labelled proposals are positive in at least `PRECISION` of the cases (with a Laplace prior) and the next lower score of a
labelled one. Selected proposals that do not overlap a certain span are added.

Training needs counts per feature vector only. Features have few values each, so there are at most `MAX_CELLS` vectors however
large the corpus; these counts, over all documents, are what the driver sees.

Patterns are written without backtracking (possessive, anchored at the start of a run), which leaves the matches unchanged and
keeps long runs of one character linear. Positions are code points, ends exclusive.

Nulls: a null text is empty and has no spans. Repeated rows are searched each. An empty table trains no tree and gives an empty
result. Extra columns are kept; `spans` and `base` of the input are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.llm.native import before, let, pieces, text_of
from sheetgraph.llm.tables import stored

KINDS = ["email", "ip", "card", "phone"]
# the fixed base patterns, rewritten without backtracking
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# further proposals: (kind, pattern); alternatives of one generator are tried in order
GENERATORS = {
    "number": r"(?<![0-9])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{2,4}|(?:\+?[0-9]{1,3}[\x20.-]?|\+)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
              r"|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,8}",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT = 24
CUES = {"phone": "call|phone|tel|fax|mobil", "email": "mail|contact|write", "card": "card|visa|account|pay", "ip": "host|server|addr|ip"}
# feature -> number of values; together the bound on feature vectors
FEATURES = {"kind": 4, "digits": 6, "check": 2, "left": 3, "right": 3, "parts": 4, "cue": 2, "spelled": 2}
MAX_CELLS = math.prod(FEATURES.values())
ROUNDS, RATE, PRECISION = 24, 0.5, 0.98


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def value(c, i):
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)", -1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, m: Column) -> Column:
    """The base check of a match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return let(digits, lambda d: F.when(kind == "email", F.lit(True)).when(kind == "ip", m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
               .when(kind == "card", F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)).otherwise(F.length(d).between(10, 15)))


def matches(text: Column, pattern: str) -> Column:
    """All matches: s, e, m, and up to CONTEXT characters on both sides."""
    def of(found):
        gaps = F.split(text, pattern, -1)
        return let(gaps, lambda g: let(before(F.transform(found, lambda m, i: (F.length(F.get(g, i)) + F.length(m)).cast("bigint"))), lambda at: F.transform(
            found, lambda m, i: let(F.get(at, i) + F.length(F.get(g, i)), lambda s: F.struct(
                s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(F.get(g, i), F.lit(CONTEXT)).alias("l"), F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("r"))))))
    kind = "array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>"
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(of(found).cast(kind)))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike("^[A-Za-z0-9]$"), 2).otherwise(1)


def _described(kind: Column, x: Column, spelled: int, base: bool = True) -> Column:
    """A proposal with its features. A check that only spelled addresses lack counts as passed. Without a prefix, a phone number that goes
    on over a dot or dash is part of a longer number and fails; base matches have their fixed check only."""
    digits = F.length(F.regexp_replace(x["m"], "[^0-9]", ""))
    cue = reduce(lambda a, k: a.when(kind == k, x["l"].rlike("(?i)" + CUES[k])), KINDS[1:], F.when(kind == KINDS[0], x["l"].rlike("(?i)" + CUES["email"])))
    seps = F.length(F.regexp_replace(x["m"], "[A-Za-z0-9]", ""))
    ok = F.coalesce(passes(kind, x["m"]), F.lit(False))
    if not base:
        ok = ok & ~((kind == "phone") & (x["l"].rlike("[0-9][.-]$") | x["r"].rlike("^[.-][0-9]")))
    f = {"kind": reduce(lambda a, k: a.when(kind == k, KINDS.index(k)), KINDS[1:], F.when(kind == KINDS[0], 0)),
         "digits": F.when(digits < 7, 0).when(digits < 10, 1).when(digits < 13, 2).when(digits < 16, 3).when(digits == 16, 4).otherwise(5),
         "check": ok.cast("int"), "left": _side(F.right(x["l"], F.lit(1))), "right": _side(F.left(x["r"], F.lit(1))),
         "parts": F.least(seps, F.lit(3)), "cue": F.coalesce(cue, F.lit(False)).cast("int"), "spelled": F.lit(spelled)}
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), ok.alias("ok"), F.struct(*[f[n].cast("int").alias(n) for n in FEATURES]).alias("f"))


def _kind_of_number(m: Column) -> Column:
    return F.when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(m.rlike(r"^[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{2,4}$"), "card").otherwise("phone")


def proposed(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with `base` (spans that pass, by start and kind) and `more` (all proposals with features, and whether they
    overlap a base span of their kind)."""
    t = text_of(text)
    of_kind = lambda k: F.transform(matches(t, BASE[k]), lambda x: _described(F.lit(k), x, 0))
    tried = F.concat(*[of_kind(k) for k in KINDS])
    extra = F.concat(F.transform(matches(t, GENERATORS["number"]), lambda x: let(_kind_of_number(x["m"]), lambda k: _described(k, x, 0, False))),
                     F.transform(matches(t, GENERATORS["spelled"]), lambda x: _described(F.lit("email"), x, 1, False)))
    # texts without a digit, an @ or a spelled address have no proposals
    any_ = t.rlike(r"[0-9@]|[\[(]at[\])]")
    d = docs.select(*[c for c in (keep if keep is not None else docs.columns) if c not in ("tried", "extra")], F.when(any_, tried).alias("tried"), F.when(any_, extra).alias("extra"))
    none = lambda c: F.coalesce(F.col(c), F.slice(F.col(c), 1, 0), F.array().cast(d.schema[c].dataType))
    order = lambda x: F.struct(x["s"].alias("s"), x["f"]["kind"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))
    d = d.withColumns({"tried": none("tried"), "extra": none("extra")})
    d = d.withColumn("base", F.array_sort(F.transform(F.filter("tried", lambda x: x["ok"]), order)))
    # spans of one kind do not overlap, so a proposal is looked up only when there are base spans at all
    certain = lambda x: F.exists("base", lambda b: (b["k"] == x["f"]["kind"]) & (b["s"] < x["e"]) & (x["s"] < b["e"]))
    more = F.transform(F.concat("tried", "extra"), lambda x: F.struct(x["s"].alias("s"), x["f"]["kind"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["f"].alias("f"), certain(x).alias("y")))
    return d.withColumn("more", more).drop("tried", "extra")


def cells(proposals: DataFrame) -> list[tuple[tuple[int, ...], int, int]]:
    """(feature vector, positives, positives and negatives) over all labelled proposals; at most MAX_CELLS entries."""
    x = proposals.select(F.explode("more").alias("x")).select("x.f", "x.y")
    clean = (F.col("f.check") == 1) & (F.col("f.left") < 2) & (F.col("f.right") < 2)
    # format and context speak for both positives and unlabelled ones, so no vector has positives and negatives
    x = x.filter(clean == F.col("y")).select("f", F.col("y").cast("bigint").alias("y"))
    return sorted((tuple(r["f"]), r["p"], r["n"]) for r in x.groupBy("f").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect())


def boosted(table) -> tuple[float, list]:
    """Trees of depth two over weighted feature vectors, fitted to the logistic loss: (start, [(feature, value, feature, value, four leaves)])."""
    pos, n = sum(p for _, p, _ in table), sum(c for _, _, c in table)
    start = math.log((pos + 1) / (n - pos + 1))
    score = [start] * len(table)
    tests = [(j, v) for j, size in enumerate(FEATURES.values()) for v in range(size)]
    trees = []
    for _ in range(ROUNDS if table else 0):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        grad = [p - c * q for (_, p, c), q in zip(table, prob)]
        hess = [c * q * (1 - q) for (_, _, c), q in zip(table, prob)]

        def best(rows):
            g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
            top = (0.0, tests[0])
            for j, v in tests:
                gl = sum(grad[i] for i in rows if table[i][0][j] == v)
                hl = sum(hess[i] for i in rows if table[i][0][j] == v)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                # a test that parts nothing seen would tell apart what was not: its gain is 0 but for rounding
                top = max(top, (gain, (j, v))) if gain > 1e-9 * (1 + g * g) else top
            return top[1]

        root = best(range(len(table)))
        sides = [[i for i in range(len(table)) if (table[i][0][root[0]] == root[1]) == s] for s in (True, False)]
        tree = [root]
        for rows in sides:
            test, leaves = best(rows), []
            for s in (True, False):
                part = [i for i in rows if (table[i][0][test[0]] == test[1]) == s]
                leaf = RATE * sum(grad[i] for i in part) / (sum(hess[i] for i in part) + 1)
                leaves.append(leaf)
                for i in part:
                    score[i] += leaf
            tree.append((test, *leaves))
        trees.append(tree)
    return start, trees


def scored(f: Column, start: float, trees: list) -> Column:
    """The trees as one expression over a feature struct."""
    names = list(FEATURES)
    at = lambda t: f[names[t[0]]] == t[1]
    side = lambda s: F.when(at(s[0]), F.lit(s[1])).otherwise(F.lit(s[2]))
    return reduce(lambda a, t: a + F.when(at(t[0]), side(t[1])).otherwise(side(t[2])), trees, F.lit(start))


def value(vector, start: float, trees: list) -> float:
    out = start
    for root, a, b in trees:
        test, yes, no = a if vector[root[0]] == root[1] else b
        out += yes if vector[test[0]] == test[1] else no
    return out


def thresholds(table, start: float, trees: list) -> list[float]:
    """Per kind a score between the lowest at which labelled proposals reach PRECISION and the next lower of a labelled one, or that
    lowest itself if none is lower; infinite if PRECISION is not reached."""
    out = []
    for k in range(len(KINDS)):
        rows = sorted(((value(v, start, trees), p, n) for v, p, n in table if v[0] == k), reverse=True)
        cut, hits, seen = math.inf, 0, 0
        for i, (s, p, n) in enumerate(rows):
            hits, seen = hits + p, seen + n
            if (i + 1 == len(rows) or rows[i + 1][0] < s) and (hits + 1) / (seen + 2) >= PRECISION:
                cut = (s + rows[i + 1][0]) / 2 if i + 1 < len(rows) else s
        out.append(cut)
    return out


def found(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with `base` and `spans`: arrays of s, k, e, kind, sorted by start and kind; spans holds base. A proposal that
    fails the check of its kind is never a span, however rare such proposals are."""
    p = stored(proposed(docs, text, keep))
    table = cells(p)
    start, trees = boosted(table)
    cuts = thresholds(table, start, trees)
    cut = lambda k: F.element_at(F.array(*[F.lit(float(c)) for c in cuts]), k + 1)
    new = F.filter("more", lambda x: (~x["y"]) & (x["f"]["check"] == 1) & (scored(x["f"], start, trees) >= cut(x["k"])) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    plain = F.transform(new, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    return p.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", plain)))).drop("more")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    def of(t, sp):
        reach = before(F.transform(sp, lambda x: x["e"]), lambda a, x: F.greatest(a, x))  # furthest end of the earlier spans
        cuts = let(reach, lambda r: F.transform(sp, lambda x, i: F.struct(F.get(r, i).alias("s"), F.greatest(x["s"], F.get(r, i)).alias("e"), (x["s"] >= F.get(r, i)).alias("new"), x["kind"].alias("kind"))))
        end = F.aggregate(sp, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x["e"]))
        return let(cuts, lambda c: let(pieces(t, c), lambda gaps: F.concat(F.array_join(F.transform(gaps, lambda g, i: F.concat(
            g, F.when(F.get(c, i)["new"], F.concat(F.lit("["), F.upper(F.get(c, i)["kind"]), F.lit("]"))).otherwise(""))), ""), F.substring(t, (end + 1).cast("int"), F.length(t)))))
    return F.when(F.size(spans) == 0, text).otherwise(let(text, lambda t: let(spans, lambda sp: of(t, sp))))
