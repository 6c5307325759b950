"""Column helpers for whole texts and arrays, built from Spark functions only.

Arrays may be long (one per document), so nothing here is quadratic in their length: running values and cuts work on blocks
of about sqrt(n) entries. A value used several times inside a higher-order function is bound once with `let`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE_CHARS = " \t\n\x0b\f\r"  # \x20 and \x09-\x0D
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(c: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, tab and line breaks."""
    return let(F.btrim(text, F.lit(SPACE_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+", -1)))


def word_count(text: Column) -> Column:
    """Number of words without keeping them: runs of blanks between words, plus one."""
    return let(F.btrim(text, F.lit(SPACE_CHARS)),
               lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE + "+", -1)))).cast("bigint")


def blocks_of(values: Column) -> Column:
    """The array cut into blocks of about sqrt(n) entries; empty for an empty array."""
    def cut(v):
        n = F.size(v)
        return let(F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int")), lambda b: F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda k: F.slice(v, k * b + 1, b)))
    return let(values, lambda v: F.when(F.size(v) <= 0, F.slice(F.array(v), 1, 0)).otherwise(cut(v)))


def before(values: Column, step: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each bigint entry, the fold of all earlier ones, starting from 0."""
    zero = F.lit(0).cast("bigint")
    fold = lambda v, start: F.aggregate(v, start, step)
    def spread(blocks):
        return let(F.transform(blocks, lambda x: fold(x, zero)), lambda totals: F.flatten(F.transform(blocks, lambda x, k: let(
            fold(F.slice(totals, 1, k), zero), lambda base: F.transform(x, lambda _, i: fold(F.slice(x, 1, i), base))))))
    return let(blocks_of(values), spread)


def pieces(text: Column, spans: Column) -> Column:
    """Texts under sorted spans (struct fields s, e: code points, end exclusive)."""
    def of_block(t, x):
        first, last = F.element_at(x, 1)["s"], F.element_at(x, -1)["e"]
        return let(F.substring(t, (first + 1).cast("int"), (last - first).cast("int")), lambda part: F.transform(
            x, lambda p: F.substring(part, (p["s"] - first + 1).cast("int"), (p["e"] - p["s"]).cast("int"))))
    return let(text, lambda t: F.flatten(F.transform(blocks_of(spans), lambda x: of_block(t, x))))


def shingle_hashes(ws: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words; a shorter sequence counts as one run, an empty one as none."""
    return let(ws, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, F.array(F.xxhash64(w)))
               .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))))
