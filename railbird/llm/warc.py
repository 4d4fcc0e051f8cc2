"""WARC archives of pages, and a two-level index of their captures.

Writing.  Every page is one record, a gzip member of its own, the payload behind a short HTTP head.
Of records with equal payloads of a least length, the one with the largest id is a response
and the others revisit it, without payload.  Payloads are matched by SHA-1 over the table of
those that occur more than once, so a hot payload costs rows of ids only.  Spark's text
writer puts the members into files: it writes bytes as they are, and a member's last byte,
always zero below 16 MiB, is what it puts behind each row (an empty member follows longer
ones).  So the archives may lie in any store that Spark writes.  A file has at most ``FILE_RECORDS``
records and about ``FILE_BYTES``: records are written in classes of size, larger ones fewer to a file.

Index.  The archives are scanned once, record by record; each capture becomes a line under its
key, the URL with the host's labels turned round.  Lines are sorted by range, cut into
blocks of ``BLOCK_LINES`` and compressed: the first level.  The directory, one entry per
block with its first and last key, is the second.  ``lookups`` takes a table of keys: each finds its ranges (as
many as Spark has partitions), in a range its blocks by halving the directory, in a block its lines by
halving again; keys and blocks meet in one shuffle each, a task holds one range's directory and one
block.  ``read_records`` reads the bytes of captures at their places, in tasks.

Defined results.  A missing page is empty; a missing URL is empty and sorts first.  Rows that
repeat id and payload are all responses if the id is the largest.  A missing id is
smaller than any other.  Blanks and control characters in a URL are percent-encoded.
An empty table gives no archive and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import batches
from railbird.session import new_folder, written

DATE = "2020-01-01T00:00:00Z"
#: Records of an archive file at most, and bytes of them before compression unless a single one has more; a reader holds one file.
FILE_RECORDS = 4_000
FILE_BYTES = 128 << 20
#: From one class of record sizes to the next.
CLASS = 16
BLOCK_LINES = 1_000
LEVEL = 3

_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str) -> str:
    """The host's labels turned round, then the rest: ``com,example,www)/path?query``."""
    _, found, rest = url.partition("://")
    if not found:
        return f"){url}"
    m = re.match(r"([^/?#]*)(.*)", rest, re.DOTALL)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2]}"


def _id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_url(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = _HTTP if revisit else _HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _row_bytes(raw: bytes) -> bytes:
    """The gzip member without the zero byte that the writer adds."""
    member = _member(raw)
    if member[-1]:
        member += _member(b"")
    return member[:-1]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(body):] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, body.partition(b"\r\n\r\n")[2]


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive; empty ones count with the one before.

    A member is fed in pieces that grow with it, so what is left of the last piece is no longer than the member.
    """
    at, view, held = 0, memoryview(data), None
    while at < len(data):
        d, out, stop, piece = zlib.decompressobj(31), [], at, 1 << 10
        while not d.eof:
            if stop >= len(data):
                raise ValueError("the archive ends inside a record")
            out.append(d.decompress(view[stop : stop + piece]))
            stop, piece = min(len(data), stop + piece), min(2 * piece, 1 << 20)
        content, after = b"".join(out), stop - len(d.unused_data)
        if content:
            if held:
                yield held
            held = (at, after - at, content)
        else:
            held = (held[0], after - held[0], held[2])
        at = after
    if held:
        yield held


def size_classes(most: int, file_bytes: int = FILE_BYTES) -> list[tuple[int, int, int]]:
    """(sizes above, sizes up to, records of a file) for record sizes up to ``most``."""
    low, high, out = -1, max(1, file_bytes // FILE_RECORDS), []
    while True:
        out.append((low, high, min(FILE_RECORDS, max(1, file_bytes // high))))
        if high >= most:
            return out
        # Beyond the bytes of a file each record has its own.
        low, high = high, max(most, high) if high >= file_bytes else min(high * CLASS, file_bytes)


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """A record for every row (page_id, url, html) of ``pages``, in files in ``folder``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("n"))
    # With the head: an escaped URL has at most three times its bytes.
    size = F.col("n").cast("long") + 3 * F.octet_length(F.coalesce("url", F.lit(""))) + 1024
    most, total = rows.agg(F.max(size), F.sum(size)).first()
    classes = size_classes(most, file_bytes) if (total or 0) > file_bytes else [(-1, most or 0, FILE_RECORDS)]
    again = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("met"), F.max("page_id").alias("keep"))
    again = written(again.where("met > 1").select("digest", "keep"))
    revisit = (F.col("n") >= min_bytes) & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    dealt = rows.withColumn("size", size).join(again, "digest", "left").select("size", "page_id", "url", "html", "keep", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                out = [_row_bytes(record(i, u, h.encode(), k, r)) for i, u, h, k, r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    for low, high, n in classes:
        at_once = min(256, n)
        part = dealt.where((F.col("size") > low) & (F.col("size") <= high)).drop("size")
        lines = part.mapInArrow(make, "member binary").select(F.col("member").cast("string").alias("value"))
        lines.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", n).text(folder)


_BLOCK = "first_key string, last_key string, n_lines int, block binary"
_LINES = "key string, page_id {id}, file string, offset bigint, length bigint, type string, digest string, payload_bytes bigint, refers_to {id}"


def captures(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """One line per record of the archives in ``folder``, read from their bytes; a response's payload is hashed again."""
    def number(urn: str):
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "" else int(text)

    schema = _arrow(spark, _LINES.format(id=id_type))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for batch in source:
                for path, data in zip(batch.column(0), batch.column(1), strict=True):
                    path = path.as_py()
                    for offset, length, raw in members(data.as_buffer()):
                        fields, payload = parse(raw)
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(fields["X-Payload-Length"])
                        if kind == "response" and (payload_digest(payload) != digest or len(payload) != n):
                            raise ValueError(f"damaged record at {offset} of {path}")
                        yield (url_key(fields["WARC-Target-URI"]), number(fields["WARC-Record-ID"]), path, offset, length, kind, digest, n,
                               number(fields["WARC-Refers-To"]) if kind == "revisit" else None)

        yield from batches(lines(), schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select("path", "content").mapInArrow(make, _LINES.format(id=id_type))


def build_index(lines: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The index as a written table: part, block_no, first_key, last_key, n_lines, block (compressed lines, sorted by key).

    Blocks are numbered within the ranges (parts) in which they were sorted.  All columns but the last are the
    directory.  A line holds its key and a JSON list of the rest.
    """
    names = lines.columns
    ordered = lines.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    ordered = ordered.select("key", F.to_json(F.struct(*names[1:]), {"ignoreNullFields": "false"}).alias("rest"))
    ddl = f"part int, block_no int, {_BLOCK}"
    schema = _arrow(lines.sparkSession, ddl)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), itertools.count()

        def block(held: list[tuple[str, str]]) -> tuple:
            text = "\n".join(f"{json.dumps(k)} {r}" for k, r in held)
            return part, next(number), held[0][0], held[-1][0], len(held), zlib.compress(text.encode(), 6)

        def blocks() -> Iterator[tuple]:
            held: list[tuple[str, str]] = []
            for batch in source:
                for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.append(pair)
                    if len(held) == block_lines:
                        yield block(held)
                        held = []
            if held:
                yield block(held)

        yield from batches(blocks(), schema, 64)

    return written(ordered.mapInArrow(make, ddl))


def block_lines_of(block: bytes) -> list[tuple[str, dict]]:
    """The (key, capture) lines of a block."""
    out, reader = [], json.JSONDecoder()
    for line in zlib.decompress(block).decode().split("\n"):
        key, at = reader.raw_decode(line)
        out.append((key, json.loads(line[at + 1:])))
    return out


def entries(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """All captures of an index, out of its blocks."""
    ddl = _LINES.format(id=id_type)
    schema = _arrow(index.sparkSession, ddl)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, *c.values()) for b in source for data in b.column(0).to_pylist() for k, c in block_lines_of(data))
        yield from batches(rows, schema)

    return index.select("block").mapInArrow(make, ddl)


def lookups(index: DataFrame, wanted: DataFrame, *, id_type: str = "bigint") -> DataFrame:
    """The captures of all keys in column ``key`` of ``wanted`` (each key once, whether it repeats there or not)."""
    # One row for each range that the index was sorted in.
    ranges = sorted(tuple(r) for r in index.groupBy("part").agg(F.min("first_key"), F.max("last_key")).collect())
    lows, highs, parts = [r[1] for r in ranges], [r[2] for r in ranges], [r[0] for r in ranges]

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, found = batch.column(0).to_pylist(), []
            for key in keys:
                # A key that repeats may lie across ranges.
                found.append(parts[bisect_left(highs, key):bisect_right(lows, key)])
            yield pa.RecordBatch.from_arrays([
                pa.array([p for ps in found for p in ps], pa.int32()), pa.array([k for k, ps in zip(keys, found, strict=True) for _ in ps], pa.string())], ["part", "key"])

    spark, keys = index.sparkSession, wanted.select("key").where("key is not null").distinct()
    asked = keys.mapInArrow(place, "part int, key string")
    known = index.select("part", "block_no", "first_key", "last_key")
    both = known.select("*", F.lit(None).cast("string").alias("key")).unionByName(asked.select(
        "part", F.lit(None).cast("int").alias("block_no"), F.lit(None).cast("string").alias("first_key"), F.lit(None).cast("string").alias("last_key"), "key"))
    both = both.repartition("part").sortWithinPartitions("part", F.col("block_no").asc_nulls_last())

    def narrow(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, numbers, first, last = None, [], [], []
            for batch in source:
                for part, number, low, high, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part != now:
                        now, numbers, first, last = part, [], [], []
                    if key is None:
                        numbers.append(number)
                        first.append(low)
                        last.append(high)
                        continue
                    for number in numbers[bisect_left(last, key):bisect_right(first, key)]:
                        yield part, number, key

        yield from batches(rows(), schema)

    schema = _arrow(spark, "part int, block_no int, key string")
    asked = both.mapInArrow(narrow, "part int, block_no int, key string")
    full = index.select("part", "block_no", "block", F.lit(None).cast("string").alias("key")).unionByName(
        asked.select("part", "block_no", F.lit(None).cast("binary").alias("block"), "key"))
    full = full.repartition("part", "block_no").sortWithinPartitions("part", "block_no", F.col("key").asc_nulls_first()).select("block", "key")
    ddl = _LINES.format(id=id_type)
    out_schema = _arrow(spark, ddl)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            lines: list[tuple[str, dict]] = []
            for batch in source:
                for block, key in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    if key is None:
                        lines = block_lines_of(block.as_py())
                        continue
                    at = bisect_left(lines, key, key=lambda line: line[0])
                    while at < len(lines) and lines[at][0] == key:
                        yield key, *lines[at][1].values()
                        at += 1

        yield from batches(rows(), out_schema)

    return full.mapInArrow(read, ddl)


def keys_of(pages: DataFrame) -> DataFrame:
    """The keys of the URLs in column ``url``, as column ``key``."""
    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(safe_url(u)) for u in batch.column(0).to_pylist()], pa.string())], ["key"])

    return pages.select("url").mapInArrow(make, "key string")


def read_records(found: DataFrame) -> DataFrame:
    """page_id, key and payload of captures: a task opens each archive once and reads only its records' bytes.

    The archives' file system has to be one that pyarrow reads.
    """
    ddl = f"page_id {found.schema['page_id'].dataType.simpleString()}, key string, payload binary"
    schema = _arrow(found.sparkSession, ddl)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            name, file = None, None
            for batch in source:
                for page_id, key, path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != name:
                        system, inner = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                        name, file = path, system.open_input_file(inner)
                    yield page_id, key, parse(next(members(file.read_at(length, offset)))[2])[1]

        yield from batches(rows(), schema, 256)

    ordered = found.repartition("file").sortWithinPartitions("file", "offset")
    return ordered.select("page_id", "key", "file", "offset", "length").mapInArrow(make, ddl)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def archive(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and gives their index."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, min_bytes=min_bytes)
    # Written before sorting: the range partitioner samples its input, and would unpack the archives once more.
    return build_index(written(captures(spark, folder)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record says: the captures of all URLs, looked up in the index of the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = lookups(archive(pages), keys_of(pages))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op8_warc_index": op8}
ORACLE: dict[str, str] = {}
