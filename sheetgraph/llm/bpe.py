"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts every text into chunks of about a kilobyte; the places depend on the content only, so a
passage that many documents share is cut alike everywhere. A worker encodes each distinct chunk once and keeps the ids in a
bounded table (two generations of `HELD_CHARS` characters); nothing is shuffled. A chunk that is not held is put together from its
words, whose ids are held in a bounded table too.

A chunk's ids can be wrong near its ends, where a word or a special token was cut. Each join is repaired: the text from the
second last word of the left chunk to the second word of the right one is encoded again, and the ids of the outer word on
either side must agree with the ids the chunks have there. If they do not, or a chunk has too few words, the repair widens,
in the end to the whole text. The pre-tokeniser never joins across a blank and special tokens hold none, so agreement on a
whole word on both sides makes the joined ids those of the whole text.

Nulls: a null text is empty, has no ids and decodes to the empty text. Repeated rows are encoded each; an empty table gives an empty
result. Columns named `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, types as T

from sheetgraph.llm.tokens import tokenizer

TAPS = 8              # bytes the rolling hash looks back
MASK = (1 << 10) - 1  # one cut in about 1,024 bytes
BLANKS = 6            # a chunk with fewer blanks is joined to the next one
HELD_CHARS, HELD_WORDS = 4_000_000, 800_000  # a generation of chunks, words: about 300 MB a worker
SLICE_BYTES = 1 << 21
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunks(text: str) -> list[str]:
    """The text in content-defined chunks of at least BLANKS blanks each (but for a short text)."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= TAPS:
        return [text]
    b = np.frombuffer(raw, np.uint8)
    g = GEAR[b]
    h = g.copy()
    for k in range(1, TAPS):
        h[k:] += g[:-k] << np.uint32(k)
    cut = np.flatnonzero(((h[TAPS - 1:-1] >> np.uint32(7)) & np.uint32(MASK)) == 0) + TAPS
    cut = cut[(b[cut] & 0xC0) != 0x80]  # between characters
    out, held, last = [], "", 0
    for c in [*cut.tolist(), len(raw)]:
        held += raw[last:c].decode("utf-8", "surrogatepass")
        last = c
        if held.count(" ") + held.count("\n") >= BLANKS:
            out.append(held)
            held = ""
    if held or not out:
        out[-1:] = [(out[-1] if out else "") + held]
    return out


class Chunk:
    """Ids of a chunk; if it has four words, also its outer two on either side with the places of their ids."""

    __slots__ = ("ids", "head", "tail", "open", "closed")

    def __init__(self, text: str, words: list[str], ids: np.ndarray, ends: list[int]):
        """`ends`: the number of ids before the second, third, second last and last word."""
        many = len(words) > 3
        self.ids = ids
        self.head = (words[0], words[1], ends[0], ends[1]) if many else None
        self.tail = (words[-2], words[-1], ends[2], ends[3]) if many else None
        self.open, self.closed = text[:1] in BLANK, text[-1:] in BLANK  # a blank stands at the start, at the end


BLANK = (" ", "\n")
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
PLAIN = re.compile(LETTERS).fullmatch
# letters between marks are pre-tokens of their own; an apostrophe may start a suffix and <, |, > a special token
MARKED = re.compile(rf'([(["*#]*)({LETTERS})([.,;:!?%#$&*)\]"]*)').fullmatch
TOGETHER = 2000  # plain words encoded in one call


def words_of(text: str) -> list[str]:
    """What stands between spaces and line feeds; other blanks stay inside."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def window(left: Chunk, right: Chunk) -> str:
    """The text around a join, from the second last word on the left to the second on the right."""
    gap = " " if left.closed or right.open else ""
    return f"{left.tail[0]} {left.tail[1]}{gap}{right.head[0]} {right.head[1]}"


class Reuse:
    """Ids of chunks, encoded once while they are held."""

    def __init__(self, path: str, words: int = HELD_WORDS, chars: int = HELD_CHARS):
        self.tokenizer, self.most_words, self.most_chars = tokenizer(path), words, chars
        self.new, self.old, self.held = {}, {}, 0
        self.words: dict[str, tuple[int, ...]] = {}  # tuples of numbers cost the garbage collector nothing
        self.encoded = self.reused = 0
        end = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ending = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ending[[i for t, i in self.tokenizer.get_vocab().items() if end and t.endswith(end)]] = True

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def together(self, words: list[str]) -> None:
        """Encode words of Latin letters in one call. Each is one pre-token, so its ids end where a token ends a word."""
        ids = self.batch([" ".join(words)])[0]
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            cuts = [0, *ends.tolist()]
            self.words.update((w, tuple(ids[a:b])) for w, a, b in zip(words, cuts, cuts[1:]))
        else:
            self.words.update(zip(words, map(tuple, self.batch(words))))

    def all(self, texts: list[str]) -> dict[str, Chunk]:
        """Ids of some chunks. Those not held are put together from their words, each of which is encoded once while it is held."""
        got, missing = {}, []
        for t in dict.fromkeys(texts):
            e = self.new.get(t) or self.old.get(t)
            if e is None:
                missing.append(t)
            else:
                got[t] = e
                self.reused += 1
        self.encoded += len(missing)
        if len(self.words) > self.most_words:  # the older half goes
            self.words = dict(itertools.islice(self.words.items(), self.most_words // 2, None))
        if missing:
            for t, chunk in zip(missing, self.built(missing)):
                got[t] = self.new[t] = chunk
                self.held += len(t)
        if self.held > self.most_chars:
            self.old, self.new, self.held = self.new, {}, 0
        return got

    def of_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words; those not held are encoded first, letters apart from the marks around them."""
        known = self.words
        unknown = [w for w in words if w not in known]
        marked = {w: m.groups() for w in unknown if (m := MARKED(w))}
        parts = {p for m in marked.values() for p in m if p}.difference(known)
        plain = [p for p in parts if PLAIN(p)]
        for a in range(0, len(plain), TOGETHER):
            self.together(plain[a:a + TOGETHER])
        rest = [*parts.difference(plain), *(w for w in unknown if w not in marked)]
        known.update(zip(rest, map(tuple, self.batch(rest))))
        known.update((w, tuple(itertools.chain.from_iterable(known[p] for p in m if p))) for w, m in marked.items() if w not in known)
        return list(map(known.__getitem__, words))

    def built(self, texts: list[str]) -> list[Chunk]:
        """Chunks put together from the ids of their distinct words."""
        cut = [words_of(t) for t in texts]
        coded = pa.array(list(itertools.chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        per_word = self.of_words(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, per_word), np.int64, len(per_word))
        ids = np.fromiter(itertools.chain.from_iterable(per_word), np.int32, int(size.sum()))
        end = np.concatenate([[0], np.cumsum(size[code])])  # where the ids of each word in a row end
        shift = (np.cumsum(size) - size)[code] - end[:-1]
        flat = ids[np.arange(end[-1]) + np.repeat(shift, size[code])]
        out, at = [], 0
        for t, ws in zip(texts, cut):
            first, last = at, at + len(ws)
            a, b = end[first], end[last]
            out.append(Chunk(t, ws, flat[a:b].copy(), (end[[first + 1, first + 2, last - 2, last - 1]] - a).tolist() if len(ws) > 3 else []))
            at = last
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [chunks(t) for t in texts]
        known = self.all([c for cs in cut for c in cs])
        joins = [(known[a], known[b]) for cs in cut for a, b in zip(cs, cs[1:])]
        fit = [a.tail is not None and b.head is not None for a, b in joins]
        again = iter(self.batch([window(a, b) for (a, b), ok in zip(joins, fit) if ok]))
        repaired = iter([self.agreed(a, b, np.array(next(again), np.int32)) if ok else None for (a, b), ok in zip(joins, fit)])
        out = []
        for cs in cut:
            mine = [next(repaired) for _ in cs[1:]]
            out.append(self.widened(cs) if any(x is None for x in mine) else self.joined([known[c] for c in cs], mine))
        return out

    @staticmethod
    def joined(parts: list[Chunk], windows: list[np.ndarray]) -> np.ndarray:
        """Ids of chunks with repaired joins."""
        out, start = [], 0
        for left, right, w in zip(parts, parts[1:], windows):
            out += [left.ids[start:left.tail[2]], w]
            start = right.head[3]
        return np.concatenate([*out, parts[-1].ids[start:]])

    @staticmethod
    def agreed(left: Chunk, right: Chunk, ids: np.ndarray):
        """The window's ids if they agree with both chunks on a word each, else None."""
        outer_l, outer_r = left.ids[left.tail[2]:left.tail[3]], right.ids[right.head[2]:right.head[3]]
        ok = len(ids) >= len(outer_l) + len(outer_r) and np.array_equal(ids[:len(outer_l)], outer_l) and np.array_equal(ids[len(ids) - len(outer_r):], outer_r)
        return ids if ok else None

    def widened(self, cs: list[str]) -> np.ndarray:
        """Chunks whose join does not agree become one chunk, until all joins agree; in the end the text is one chunk."""
        while len(cs) > 1:
            known, merged, windows = self.all(cs), [cs[0]], []
            for a, b in zip(cs, cs[1:]):
                left, right = known[a], known[b]
                w = self.agreed(left, right, np.array(self.batch([window(left, right)])[0], np.int32)) if left.tail and right.head else None
                if w is None:
                    merged[-1] += b
                else:
                    merged.append(b)
                    windows.append(w)
            if len(merged) == len(cs):
                return self.joined([known[c] for c in cs], windows)
            cs = merged
        return np.array(self.batch(cs)[0], np.int32)


@functools.cache
def of_worker(path: str, words: int, chars: int) -> Reuse:
    """What a worker process holds over all its tasks."""
    return Reuse(path, words, chars)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `most` bytes of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, words: int = HELD_WORDS, chars: int = HELD_CHARS,
            across_tasks: bool = True) -> DataFrame:
    """The kept columns with `ids` (array of int) and `decoded` (string). `words` and `chars` bound what is held; where workers go on to
    other work, across_tasks=False lets them drop it after each task."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    source = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse = of_worker(path, words, chars) if across_tasks else Reuse(path, words, chars)
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids = reuse.ids([t or "" for t in batch.column("__text").to_pylist()])
                said = reuse.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns = [batch.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"])

    return source.mapInArrow(run, schema)
