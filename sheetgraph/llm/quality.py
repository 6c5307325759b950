"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its measurement and, if it fails, its bit are stored. Policies are sets of rules under
a version: applying one is a bitwise test on the ledger, and what each rule costs (rejected by it alone, kept if it were left
out) is read from counts per bit pattern, without touching a text again.

Words are runs without blanks. Windows of eight words are compared by 64-bit hashes within one document. Nulls: a null text
has no words and fails `few_words`; other columns are kept as they are. Repeated rows are judged alike. An empty table gives an
empty ledger. Measurements that clash with given columns replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheetgraph.llm.native import SPACE_CHARS, let, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# rule name -> condition of failure over the measurements; the position is the bit
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
POLICIES = {"base": ["few_words", "repeated_words"], "v1": list(RULES)}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def repeated_words(ws: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text, each counted once."""
    def of_hashes(h):
        # equal hashes are neighbours after sorting; their positions, sorted, cover min(8, distance to the next) words each
        hits = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.filter(
            s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        return let(F.array_sort(F.transform(hits, lambda x: x["i"])), lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return let(ws, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(of_hashes(h)))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    t = text_of(text)
    all_but = lambda chars: F.length(F.translate(t, chars, ""))
    found = let(words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).cast("bigint").alias("r")))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
                lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d")))
    return docs.withColumns({"__w": found, "__l": lines, "word_chars": all_but(SPACE_CHARS).cast("bigint"), "n_symbols": (F.length(t) - all_but(SYMBOLS)).cast("bigint")})\
        .withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r"), "n_lines": F.col("__l.n"), "n_dup_lines": F.col("__l.d")}).drop("__w", "__l")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with the measurements and failure_bits (long)."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(0).cast("bigint") for k, rule in enumerate(RULES.values())), F.lit(0).cast("bigint"))
    return measured(docs, text).withColumn("failure_bits", bits)


def fails(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def kept(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Rows the policy keeps, with the columns they came with."""
    return ledger(docs.withColumn("__given", F.struct(*docs.columns)), text).filter(~fails(policy)).select("__given.*")


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, rows kept without it. Rows are counted per bit pattern first."""
    m = F.lit(mask(policy)).cast("bigint")
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(m).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    p = patterns.select("bits", "n", each.alias("x")).select("bits", "n", "x.*")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return p.groupBy("rule").agg(count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"),
                                 count(rest == 0).alias("n_kept_without"))
