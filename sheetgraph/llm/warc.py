"""WARC archives: writing the captures of web pages, reading records back, and assembling transactions.

Writing. A page becomes three records, one after the other in the same archive: the response (or a revisit of an earlier equal
payload), its request and a metadata record, the latter two concurrent to the first. Archives are gzip files of Spark's text
writer, whose line end is the record end of the format, so nothing but Spark touches the store. Equal payloads are found on
(digest, part) rows: smallest page per part, then per digest, so a payload that a third of the pages share is spread. The page
itself is shuffled once, with its digest, and a digest that occurs once needs no answer.

Reading. The text reader streams an archive cut at the version mark; a payload that contains the mark is put together again by
its Content-Length. A task holds one record and a batch.

Assembling. Requests and metadata records meet their response or revisit through WARC-Concurrent-To, whichever of them names the
other, or over a request in between. Each capture is one row with its requests and metadata nested; a revisit takes the measures
of the response that it refers to.

Defined results: null html is an empty payload; null page_id sorts after all others, null url after all others of a page, and
neither is written; the first row of the smallest (page_id, url) is the response, rows that repeat it revisit it; payloads under
`least` bytes are all responses. Blanks and line breaks in a url are written as %20, %0D and %0A. Further columns are ignored.
An empty table gives empty archives and no captures. An archive that ends inside a record is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sheetgraph.llm.native import text_of
from sheetgraph.llm.tables import looked_up, part_of, stored
from sheetgraph.operators.stage import shared_folder

LEAST = 100  # bytes from which an equal payload is a revisit
DATE = "1970-01-01T00:00:00Z"  # where the pages have no time of capture
MARK, END = "WARC/1.", "\r\n\r\n"
ROOTS = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, date string, declared string, "
          "n_bytes bigint, digest string, fields map<string,string>, payload binary")


def _id(role: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(role), *[p.cast("string") for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str | Column, record_id: Column, block: Column, content: str, *more: Column) -> Column:
    """A record without its end; `more` are whole header lines, null ones are left out."""
    said = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    lines = [said("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), said("WARC-Record-ID", record_id), *[F.coalesce(m, F.lit("")) for m in more],
             said("Content-Type", F.lit(content)), said("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit(MARK + "1\r\n"), *lines, F.lit("\r\n"), block)


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Columns page_id, url, payload, n_bytes, digest, part, nth (within digest and part) and first_part: that of the response
    which a revisit refers to, null for responses."""
    d = pages.select("page_id", F.col("url").cast("string").alias("url"), text_of("html").alias("payload")).withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256), "part": part_of("page_id", "url")})
    order = [F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.xxhash64("url")]
    narrow = d.filter(F.col("n_bytes") >= least).select("digest", "part", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "part").alias("o"))
    per_part = narrow.groupBy("digest", "part").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
    # a payload that occurs once has no row here
    first = per_part.groupBy("digest").agg(F.min("o")["part"].alias("first_part"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    answers = per_part.select("digest", "part").join(first, "digest")
    w = Window.partitionBy("digest", "part").orderBy(*order)
    d = d.withColumn("nth", F.row_number().over(w)).join(answers, ["digest", "part"], "left")
    return d.withColumn("first_part", F.when((F.col("first_part") != F.col("part")) | (F.col("nth") > 1), F.col("first_part")))


def written(pages: DataFrame, least: int = LEAST, date: str = DATE, path: str | None = None) -> str:
    """Writes the archives of all pages; returns their folder, a new one in the shared folder unless given."""
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    d, line = typed(pages, least), lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    key, uri = [F.col("digest"), F.col("part"), F.col("nth")], F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    again, own = F.col("first_part").isNotNull(), _id("capture", *key)
    common = [line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri)]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    capture = _record(F.when(again, "revisit").otherwise("response"), own, F.when(again, head).otherwise(F.concat(head, "payload")), "application/http; msgtype=response",
                      *common, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.when(again, line("WARC-Profile", F.lit(PROFILE))),
                      F.when(again, line("WARC-Refers-To", _id("capture", F.col("digest"), F.col("first_part"), F.lit(1)))))
    request = _record("request", _id("request", *key), F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)), "application/http; msgtype=request", *common, line("WARC-Concurrent-To", own))
    metadata = _record("metadata", _id("metadata", *key), F.coalesce(line("page-id", F.col("page_id").cast("string")), F.lit("")), "application/warc-fields", *common, line("WARC-Concurrent-To", own))
    d.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


def _named(head: bytes) -> dict[str, list[str]]:
    """Header lines by lower-case name."""
    named: dict[str, list[str]] = {}
    for x in head.split(b"\r\n")[1:]:
        name, _, v = x.decode("utf-8", "replace").partition(":")
        named.setdefault(name.strip().lower(), []).append(v.strip())
    return named


def _length(start: bytes) -> int | None:
    """Bytes of the record that starts so, without its end; None while its header is not complete."""
    head, end, _ = start.partition(b"\r\n\r\n")
    return len(head) + len(end) + int(_named(head).get("content-length", ["0"])[0]) if end else None


def _parsed(whole: bytes, keep: bool) -> dict:
    head, _, block = whole.partition(b"\r\n\r\n")
    named = _named(head)
    first = lambda name: named.get(name, [None])[0]
    size = int(first("content-length") or 0)
    block, kind = block[:size], first("warc-type")
    http = (first("content-type") or "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    fields = {}
    if (first("content-type") or "").startswith("application/warc-fields"):
        for x in block.decode("utf-8", "replace").split("\r\n"):
            if ":" in x:
                fields[x.partition(":")[0].strip()] = x.partition(":")[2].strip()
    has = kind in ("response", "resource")
    return {"record_id": first("warc-record-id"), "kind": kind, "concurrent_to": named.get("warc-concurrent-to", []), "refers_to": first("warc-refers-to"), "uri": first("warc-target-uri"),
            "date": first("warc-date"), "declared": (first("warc-payload-digest") or "").rpartition(":")[2] or None, "n_bytes": len(payload) if has else None,
            "digest": hashlib.sha256(payload).hexdigest() if has else None, "fields": list(fields.items()), "payload": payload if has and keep else None}


def records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record of the gzip archives under `path`, with length and SHA-256 of the payload that was read."""
    lines = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    names, types = zip(*[x.strip().split(" ", 1) for x in SCHEMA.split(", ")])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    arrow = pa.schema([(n, kinds[t]) for n, t in zip(names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, need, at = [], 0, None, None
        for batch in batches:
            out = []
            for piece, file in zip(batch.column(0), batch.column(1).to_pylist()):
                piece = piece.as_py() or b""
                if file != at:
                    if held:
                        raise ValueError(f"{at} ends inside a record")
                    at = file
                if not held and not piece.strip():
                    continue  # before the first mark
                size += len(piece) + (len(MARK) if held else 0)
                held.append(piece)
                if need is None:
                    need = _length(MARK.encode().join(held))
                # a record ends where a piece ends, since the next one starts with the mark
                if need is not None and size >= need:
                    out.append(_parsed(MARK.encode().join(held), keep_payload))
                    held, size, need = [], 0, None
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            raise ValueError(f"{at} ends inside a record")

    return lines.mapInArrow(run, SCHEMA)


def assembled(recs: DataFrame) -> DataFrame:
    """One row per capture: record_id, kind, uri, date, declared, n_bytes, digest, refers_to, and arrays `requests` and `metadata` of the
    records that are concurrent to it (structs record_id, uri, fields; by record_id)."""
    roots = recs.filter(F.col("kind").isin(*ROOTS))
    others = recs.filter(F.col("kind").isin("request", "metadata"))
    named = lambda d: d.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = named(recs).unionByName(named(recs).select(F.col("b").alias("a"), F.col("a").alias("b")))
    at_root = links.join(roots.select(F.col("record_id").alias("b")), "b").select("a", F.col("b").alias("capture"))
    over = links.join(at_root.select(F.col("a").alias("b"), "capture"), "b").select("a", "capture")
    direct = others.select(F.col("record_id").alias("a"), "kind", F.struct("record_id", "uri", "fields").alias("r"))
    mine = direct.join(at_root.unionByName(over).distinct(), "a")
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("r.record_id"), F.col("r.uri"), F.map_entries("r.fields").alias("fields")))))
    nested = mine.groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    return roots.join(nested, F.col("record_id") == F.col("capture"), "left").drop("capture", "concurrent_to", "fields")


def captures(recs: DataFrame) -> DataFrame:
    """Assembled captures where a revisit has length and digest of the response it refers to; `first` is that response's metadata."""
    c = assembled(recs)
    known = c.filter("kind <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("n_bytes").alias("first_bytes"), F.col("digest").alias("first_digest"), F.col("metadata").alias("first"))
    c = looked_up(c, "refers_to", ["record_id"], known)
    return c.withColumns({"n_bytes": F.coalesce("n_bytes", "first_bytes"), "digest": F.coalesce("digest", "first_digest", "declared")}).drop("first_bytes", "first_digest")


def field(metadata: str | Column, name: str) -> Column:
    """The first value of a field in nested metadata records, null if none has it."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.get(F.filter(F.flatten(F.transform(m, lambda r: r["fields"])), lambda x: x["key"] == name), F.lit(0))["value"]


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The captures of the pages, read back from archives written for them."""
    path = written(pages, least)
    return captures(stored(records(pages.sparkSession, path).drop("payload")))
