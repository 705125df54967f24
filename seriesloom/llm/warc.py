"""WARC archives and a two-level capture index (operator 2).

Archives: one gzip member per record, as the format asks, many records to a file. A page whose payload equals that of a
page with a smaller identifier becomes a ``revisit`` record that refers to it; its HTTP header keeps the payload's length.

Capture index, two levels: a line per record, keyed by the reversed host and path (``org,example,www)/path``), sorted and
cut into compressed blocks. Each index file ends in its own sparse directory (a block's first and last key, place and size),
and a table has a row per file (first and last key). A lookup binary-searches the files and a file's directory, reads the
block by range, binary-searches it, and reads the record by range. :func:`lookup` does this for a table of urls.

Plan: digests are computed in the JVM. Those that repeat are joined to the pages by broadcast if they are few, so no payload
moves; else by a hashed join that shuffles payloads but does not sort them, and of which AQE splits a hot digest. Each
partition writes its own archive; keys (not pages) are dealt by range for the index. In a bulk lookup a key is turned into
blocks, and (block, key) pairs are dealt, so captures of a hot key are read by as many tasks as they have blocks. Records
are dealt by (file, offset) to a number of tasks that follows from the archives' bytes, and each task reads forward.

Reading back checks what it reads: the length and SHA-1 of every payload are taken from the payload itself and must agree
with the record's headers, and a revisit must agree with the response that it refers to; anything else is an error.

Defined results: null html is an empty payload; a null or repeated identifier is kept (rows with the smallest identifier of
their payload are all responses; a payload of which all identifiers are null has responses only); a null url is empty;
control characters in urls are percent-encoded; a payload of any length is one record, held whole by one task at a time;
ties of keys are in order of file and offset, and records of equal keys are all found; an empty table gives no archives;
further columns of any name are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Store, cut, fresh, hinted, release, small_batches, unique_name

PLACES = "key string, page_id long, file string, offset long, length long"
FILES = "first_key string, last_key string, file string, blocks long, n long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_CRLF = b"\r\n"
_TAIL, _MAGIC = struct.Struct("<QQ8s"), b"SLCDX002"
#: Rows of digests or responses (some 60 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of archives that a task of the read-back takes on.
READ_BYTES = 8 << 20


def capture_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, port and path after ``)``; scheme, user, ``www.`` and fragment dropped."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return re.sub(r"\s", "", (url or "").lower())
    host = re.sub(r"^www\d*\.", "", host)
    path = parts.path or "/"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path + query
    return quote(key.lower(), safe="!#$%&'()*+,/:;=?@[]~-._")


def _target(url: str | None) -> str:
    return quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._{}|\\^`<>\"")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: bytes) -> int | None:
    text = name.decode()[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    digest = base64.b32encode(sha1)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _name(page_id).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + _target(url).encode(), b"WARC-Payload-Digest: sha1:" + digest]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers_to).encode()]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return _CRLF.join(lines) + _CRLF * 2 + body + _CRLF * 2


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse_record(raw: bytes) -> tuple:
    """Values of ``RECORDS`` from one uncompressed record; a revisit's payload is null.

    A response's length and digest are those of the payload that was read, and it is an error if the headers give others.
    """
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in lines[1:])}
    body = rest[: int(fields[b"content-length"])]
    http, _, payload = body.partition(_CRLF * 2)
    revisit = fields[b"warc-type"] == b"revisit"
    size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
    refers, said = fields.get(b"warc-refers-to"), fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    if not revisit and (len(payload), digest_of(payload)) != (size, said):
        raise ValueError(f"record {fields[b'warc-record-id'].decode()}: its payload is not what its headers say")
    return (_page(fields[b"warc-record-id"]), fields[b"warc-target-uri"].decode(), fields[b"warc-type"].decode(), size, said, _page(refers) if refers else None, None if revisit else payload)


def _payload(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.lit(b"").cast("binary"))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives below ``root``; returns a place per record (``PLACES``), stored below ``root``.

    Payloads of fewer than ``min_bytes`` bytes are always written in full.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), _payload(F.col(html_col)).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload").cast("long"))
    again = rows.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(again, "digests")
    few = hinted(again, BROADCAST_ROWS)
    known = rows.join(few if few is not again else again.hint("shuffle_hash"), ["sha", "size"], "left").select("page_id", "url", "payload", "sha", "first_id")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, at = Store(root), None, 0
        for part in parts:
            places = []
            for page_id, url, payload, sha, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is not None and at >= file_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, at = unique_name("archives/part", ".warc.gz"), 0
                    out = store.create(name)
                revisit = first is not None and page_id != first
                zip_ = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = zip_.compress(record_bytes(page_id, url, payload, sha, first, revisit, date)) + zip_.flush()
                out.write(member)
                places.append((capture_key(url), page_id, name, at, len(member)))
                at += len(member)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()
        release()

    with small_batches(pages.sparkSession):
        known.mapInArrow(write, PLACES).write.parquet(f"{root}/places")
    return pages.sparkSession.read.schema(PLACES).parquet(f"{root}/places")


def build_index(places: DataFrame, root: str, lines: int = 3000) -> DataFrame:
    """Sort places by key into blocks of so many lines; returns the table of index files (``FILES``), stored below ``root``."""
    order = ["key", "file", "offset"]
    dealt = places.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, held, made = unique_name("index/part", ".cdx"), None, 0, [], []

        def flush(block: list[tuple]) -> None:
            nonlocal out, at
            if out is None:
                out = Store(root).create(name)
            raw = zlib.compress("".join(f"{k} {'-' if p is None else p} {f} {o} {n}\n" for k, p, f, o, n in block).encode())
            out.write(raw)
            made.append((block[0][0], block[-1][0], at, len(raw), len(block)))
            at += len(raw)

        for part in parts:
            held += zip(*(c.to_pylist() for c in part.columns), strict=True)
            while len(held) >= lines:
                flush(held[:lines])
                del held[:lines]
        if held:
            flush(held)
        if out is not None:
            directory = zlib.compress("".join(f"{first} {last} {o} {size}\n" for first, last, o, size, _ in made).encode())
            out.write(directory)
            out.write(_tail(at, len(directory)))
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [made[0][0]], "last_key": [made[-1][1]], "file": [name], "blocks": [len(made)], "n": [sum(m[4] for m in made)]})

    dealt.select("key", "page_id", "file", "offset", "length").mapInArrow(write, FILES).write.parquet(f"{root}/index-files")
    return places.sparkSession.read.schema(FILES).parquet(f"{root}/index-files")


def _tail(at: int, size: int) -> bytes:
    return _TAIL.pack(at, size, _MAGIC)


def read_block(store: Store, file: str, offset: int, size: int) -> list[tuple]:
    """The lines of one index block: key, page_id, file, offset, length."""
    out = []
    for line in zlib.decompress(store.open(file).read_at(size, offset)).decode().splitlines():
        key, page, name, at, n = line.rsplit(" ", 4)
        out.append((key, None if page == "-" else int(page), name, int(at), int(n)))
    return out


def read_directory(store: Store, name: str) -> list[tuple[str, str, int, int]]:
    """The sparse directory at an index file's end: first key, last key, offset and size of each block, in order."""
    file = store.open(name)
    at, size, magic = _TAIL.unpack(file.read_at(_TAIL.size, file.size() - _TAIL.size))
    if magic != _MAGIC:
        raise ValueError("not a capture index file")
    out = []
    for line in zlib.decompress(file.read_at(size, at)).decode().splitlines():
        first, last, offset, n = line.split(" ")
        out.append((first, last, int(offset), int(n)))
    return out


def _overlapping(rows: list[tuple], key: str, low: int = 0, high: int = 1) -> range:
    """Positions of the rows, sorted by key range, whose range [row[low], row[high]] holds ``key``: two binary searches."""
    return range(bisect.bisect_left(rows, key, key=lambda r: r[high]), bisect.bisect_right(rows, key, key=lambda r: r[low]))


def _index_files(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """First key, last key and name of each index file, sorted: as many as tasks have written, never captures or blocks."""
    rows = spark.read.schema(FILES).parquet(f"{root}/index-files").select("first_key", "last_key", "file").collect()
    return sorted(tuple(r) for r in rows)


class CaptureIndex:
    """Lookups in a capture index by binary search; :func:`lookup` uses it inside tasks."""

    def __init__(self, files: list[tuple[str, str, str]], root: str):
        self.files, self.store, self.name, self.directory = files, Store(root), None, []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "CaptureIndex":
        return cls(_index_files(spark, root), root)

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and size of the blocks that may hold a key; the directory last used stays open."""
        for i in _overlapping(self.files, key):
            name = self.files[i][2]
            if name != self.name:
                self.name, self.directory = name, read_directory(self.store, name)
            for j in _overlapping(self.directory, key):
                yield name, *self.directory[j][2:]

    def places(self, url: str | None) -> list[tuple]:
        """Captures of a url."""
        key = capture_key(url)
        return [x for block in self.blocks(key) for x in matching(read_block(self.store, *block), key)]

    def fetch(self, url: str | None) -> list[tuple]:
        """Records (``RECORDS``) of a url."""
        return [parse_record(zlib.decompress(self.store.open(f).read_at(n, at), 31)) for _, _, f, at, n in self.places(url)]


def matching(block: list[tuple], key: str) -> list[tuple]:
    """A block's lines of one key, by binary search."""
    return block[bisect.bisect_left(block, key, key=lambda x: x[0]) : bisect.bisect_right(block, key, key=lambda x: x[0])]


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def lookup(urls: DataFrame, root: str, url_col: str = "url") -> DataFrame:
    """Places (``PLACES``) of all captures of a table of urls, each once however often its url is asked for."""
    spark = urls.sparkSession
    files = _index_files(spark, root)

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_pydict({"key": sorted({capture_key(u) for u in part.column(0).to_pylist()})})

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(files, root)
        for part in parts:
            found = [(*block, key) for key in part.column(0).to_pylist() for block in index.blocks(key)]
            for i in range(0, len(found), 10_000):
                yield _arrow(found[i : i + 10_000], pairs)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at, block = Store(root), None, []
        for part in parts:
            out = []
            for *place, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if place != at:
                    at, block = place, read_block(store, *place)
                out += matching(block, key)
                if len(out) >= 10_000:
                    yield _arrow(out, PLACES)
                    out = []
            if out:
                yield _arrow(out, PLACES)

    pairs = "file string, offset long, size long, key string"
    wanted = urls.select(url_col).distinct().mapInArrow(keys, "key string").distinct()
    blocks = wanted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, pairs)
    return blocks.repartitionByRange("file", "offset", "key").sortWithinPartitions("file", "offset", "key").mapInArrow(read, PLACES)


def read_records(places: DataFrame, root: str) -> DataFrame:
    """Records (``RECORDS``) at ``places`` (file, offset, length), dealt and ordered so that reads run through each archive."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, file, rows, held = Store(root), None, None, [], 0
        for part in parts:
            for f, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if f != name:
                    name, file = f, store.open(f)
                raw = zlib.decompress(file.read_at(length, offset), 31)
                rows.append(parse_record(raw))
                held += len(raw)
                if held > 4 << 20:
                    yield _arrow(rows, RECORDS)
                    rows, held = [], 0
        if rows:
            yield _arrow(rows, RECORDS)

    places = cut(places.select("file", "offset", "length"), "places")
    size = places.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(1, -(-size // READ_BYTES))  # places are a few bytes each: left to themselves they would meet in one task
    return places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without payloads (materialised) whose revisits have been held against the response they refer to: a
    revisit's length and digest are then those that were measured there. A revisit without such a response is an error."""
    given = records.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"))
    asked = records.where("record_type = 'revisit'")
    wanted = asked.select(F.col("refers_to").alias("__id"), F.col("payload_digest").alias("__digest")).distinct()
    given = cut(given.join(wanted, ["__id", "__digest"], "left_semi").distinct(), "responses")
    met = asked.join(hinted(given, BROADCAST_ROWS), (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    wrong = F.raise_error(F.concat(F.lit("a revisit disagrees with the response it refers to: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    measured = F.when(F.col("__bytes") == F.col("payload_bytes"), F.col("__bytes")).otherwise(wrong.cast("long"))
    return records.where("record_type = 'response'").unionByName(met.withColumn("payload_bytes", measured).select(*records.columns))


def digest(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and index, look every page's url up again, read the records, and describe each by the payload that was
    read: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    root = fresh(pages.sparkSession, "warc")
    build_index(write_archives(pages, root, min_bytes), root)
    records = read_records(lookup(pages, root), root)
    return resolved(cut(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records"))


#: DuckDB: what the archives must hold, from the pages themselves.
SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
g as (select *, list_transform(range(0, 8), lambda g: ('0x' || x[g * 5 + 1 : g * 5 + 5])::bigint) as v, min(page_id) over (partition by h) as first from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest,
  case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to
from g
"""
