"""Removal of repeated byte strings across a corpus, by suffix sorting of shards.

A suffix array of the whole corpus would have to be in one place.  Instead the corpus is dealt
into shards so that equal strings of ``LENGTH`` bytes always meet in one: the smallest
hash among the ``GRAM``-byte strings inside it is a string's key, equal strings have equal
keys, and neighbouring strings mostly share theirs, so a shard gets segments of text, not
single strings.  A key that stands in one place of the corpus holds nothing that repeats and goes no
further.  Each shard is sorted by ``suffix.repeated`` (external induced sorting with common
prefixes); a string that agrees over ``LENGTH`` bytes with a neighbour in suffix order repeats.

Copies and hot keys.  Texts that are equal as a whole are one text: they are removed if long
enough, and meet others once.  Equal segments are one before they reach a shard.  A key with more than
``HOT`` different segments is cut further: its strings are blocked by their distance to
the key's place, ``STEP`` to a block, and a block is keyed by what all its strings have in
common; equal strings still meet.  Blocks that lie across the edge of a passage with many contexts share
that key and still differ; a finer key with more than ``HOT`` different segments is cut again at half
the step, down to 1, where the key is the string itself and has one segment.

Bound.  A key so has at most ``HOT`` different segments of at most ``MOST_STRINGS + LENGTH - 1`` bytes
(5.8 MB).  A shard is sorted in parts that end at the border of a key once they hold twice
``SHARD_BYTES``, so one sort gets less than 14.3 MB, whatever the corpus.

Defined results.  A missing text is empty.  Matches never cross texts.  Texts below ``LENGTH`` bytes stay
whole.  Rows that repeat id and text are copies of each other.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm import suffix
from railbird.llm.common import batches, mixed64, text_of
from railbird.session import written

LENGTH = 400
GRAM = 64
#: Strings whose key stands in one segment at most; longer runs (of one symbol, say) are cut, and the cuts overlap.
MOST_STRINGS = 1024
HOT = 4096
STEP = 16
#: Bytes of segments that a shard gets on average.
SHARD_BYTES = 4 << 20
_A = 0x9E3779B97F4A7C15


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes; ``gram`` is a power of two."""
    with np.errstate(over="ignore"):
        h, width, factor = mixed64(raw.astype(np.uint64) + np.uint64(1)), 1, np.uint64(_A)
        while width < gram:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, 2 * width
    return mixed64(h)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    width = 1
    while 2 * width <= n:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return np.minimum(h[:len(h) - (n - width)], h[n - width:]) if width < n else h


def segments_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first string, number of strings, whether the key stands in it more than once) of the runs of strings with one key."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    n = length - gram + 1
    h = _gram_hashes(np.frombuffer(text, np.uint8), gram)
    least = _least(h, n)
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    size = np.diff(np.append(start, len(least)))
    if size.max() > MOST_STRINGS:
        start = np.concatenate([np.arange(s, s + m, MOST_STRINGS) for s, m in zip(start.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(start, len(least)))
    # The key's places in a segment: where a string starts with it, and those in the last string.
    key, last = least[start], start + size - 1
    leads = np.concatenate(([0], np.cumsum(h[:len(least)] == least)))
    places = leads[last] - leads[start]
    windows = np.lib.stride_tricks.sliding_window_view(h, n)
    for i in range(0, len(last), 1024):
        places[i:i + 1024] += (windows[last[i:i + 1024]] == key[i:i + 1024, None]).sum(axis=1)
    return key, start, size, places > 1


def finer_segments(segment: bytes, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> Iterator[tuple[bytes, int, int]]:
    """(finer key, first string, number of strings) of a hot key's segment, all of whose strings share the key.

    The place of a string's key is the first at which the least hash stands in it; equal strings have it
    at the same distance.  Strings with one place and one block of distances have the bytes
    in common by which they are keyed.
    """
    h = _gram_hashes(np.frombuffer(segment, np.uint8), gram)
    at = np.flatnonzero(h == h.min())
    strings = np.arange(len(segment) - length + 1)
    place = at[np.searchsorted(at, strings)]
    block = (place - strings) // step
    cut = np.flatnonzero((place[1:] != place[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(strings)], strict=True):
        p, k = int(place[a]), int(block[a])
        common = segment[p - k * step:p - (k + 1) * step + 1 + length]
        yield xxhash.xxh128_digest(common, k), a, b - a


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _mapped(df: DataFrame, ddl: str, make, size: int = 4096) -> DataFrame:
    schema = _arrow(df.sparkSession, ddl)
    return df.mapInArrow(lambda source: batches(make(_rows(source)), schema, size), ddl)


def _described(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """text_id, key, start, size, again (the key stands in it more than once) of the segments of (text_id, text) rows."""
    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, found = batch.column(0), []
            where = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                part = segments_of(text.encode(), length, gram)
                found.append(part)
                where.append(np.full(len(part[0]), i))
            key, start, size, again = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.concatenate(where))), pa.array(key.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again),
            ], ["text_id", "key", "start", "size", "again"])

    return rows.mapInArrow(make, "text_id binary, key bigint, start int, size int, again boolean")


def _cut_again(one: DataFrame, length: int, gram: int, hot: int, step: int) -> tuple[DataFrame, list[DataFrame]]:
    """The segments, those of finer keys with more than ``hot`` cut at half the step until none is left, and for
    each round the places of the parts: whole_id, at, segment_id."""
    def halves(step_: int):
        def cut(rows_: Iterator[tuple]) -> Iterator[tuple]:
            for whole_id, segment, met in rows_:
                for finer, a, n in finer_segments(segment, length, gram, step_):
                    part = segment[a:a + n + length - 1]
                    yield whole_id, a, xxhash.xxh128_digest(part), finer, part, met

        return cut

    ddl, rounds = "whole_id binary, at bigint, segment_id binary, shard_key binary, segment binary, met bigint", []
    while step > 1:
        # Finer keys have 16 bytes, others 8.
        met = one.where(F.octet_length("shard_key") > 8).groupBy("shard_key").agg(F.count(F.lit(1)).alias("n"))
        crowded = written(met.where(F.col("n") > hot).select("shard_key"))
        if crowded.isEmpty():
            break
        step //= 2
        parts = _mapped(one.join(crowded, "shard_key").select("segment_id", "segment", "met"), ddl, halves(step), 1024)
        rounds.append(written(parts.select("whole_id", "at", "segment_id")))
        parts = parts.groupBy("shard_key", "segment_id").agg(F.first("segment").alias("segment"), F.sum("met").alias("met"))
        one = written(one.join(crowded, "shard_key", "left_anti").unionByName(parts))
    return one, rounds


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   hot: int = HOT, step: int = STEP, shard_bytes: int = SHARD_BYTES, memory: int = suffix.MEMORY) -> tuple[DataFrame, DataFrame]:
    """What is removed: the rows (doc_id, text_id, n_bytes, copies) and the texts with repeats (text_id, text, runs).

    ``runs`` are (first, number) of neighbouring strings that repeat; several may overlap.  A text of several
    equal rows has no runs: it repeats as a whole.
    """
    text = text_of(docs, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_id"))
    rows = written(source.select("doc_id", "text_id", F.octet_length("text").cast("long").alias("n_bytes")))
    texts = written(rows.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))

    long_ones = source.where(F.octet_length("text") >= length).select("text_id", "text")
    found = _described(long_ones, length, gram).groupBy("text_id", "start").agg(F.first("key").alias("key"), F.first("size").alias("size"), F.first("again").alias("again"))
    found = written(found)
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.max("again").alias("again")).where("met > 1 or again").drop("again")
    spans = found.join(shared, "key").groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "size", "key", (F.col("met") > hot).alias("hot")))).alias("spans"))

    # One row of each text that has a shared key; its bytes travel once, by id and text.
    chosen = spans.join(texts, "text_id").withColumn("known", F.coalesce(F.col("first_id").cast("string"), F.lit("")))
    held = source.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("known"), "text_id", "text")
    held = held.join(chosen.select("known", "text_id", "spans", "copies"), ["known", "text_id"]).dropDuplicates(["known", "text_id"])
    held = written(held.select("text_id", "text", "spans", "copies"))

    def cut(rows_: Iterator[tuple]) -> Iterator[tuple]:
        """(text_id, start, segment id, shard key, segment)"""
        for text_id, words, parts in rows_:
            raw = words.encode()
            for p in parts:
                a, n, key = p["start"], p["size"], p["key"].to_bytes(8, "little", signed=True)
                if not p["hot"]:
                    segment = raw[a:a + n + length - 1]
                    yield text_id, a, xxhash.xxh128_digest(segment), key, segment
                    continue
                for finer, b, m in finer_segments(raw[a:a + n + length - 1], length, gram, step):
                    segment = raw[a + b:a + b + m + length - 1]
                    yield text_id, a + b, xxhash.xxh128_digest(segment), finer, segment

    ddl = "text_id binary, start bigint, segment_id binary, shard_key binary, segment binary"
    cuts = _mapped(held.select("text_id", "text", "spans"), ddl, cut, 1024)
    where = written(cuts.select("text_id", "start", "segment_id", "shard_key"))
    # Equal segments are one.
    one = cuts.groupBy("shard_key", "segment_id").agg(F.first("segment").alias("segment"), F.count(F.lit(1)).alias("met"))
    one, rounds = _cut_again(written(one), length, gram, hot, step)
    total = one.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = one.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "shard_key", "segment_id").select("shard", "shard_key", "segment_id", "segment", "met")

    def sorted_shards(source_: Iterator[tuple]) -> Iterator[tuple]:
        shard, last, size, ids, parts, met = None, None, 0, [], [], []
        for now, key, segment_id, segment, n in source_:
            if ids and (now != shard or key != last and size >= 2 * shard_bytes):
                yield from _shard_runs(ids, parts, met, length, memory)
                size, ids, parts, met = 0, [], [], []
            shard, last, size = now, key, size + len(segment)
            ids.append(segment_id)
            parts.append(segment)
            met.append(n)
        if ids:
            yield from _shard_runs(ids, parts, met, length, memory)

    runs = written(_mapped(dealt, "segment_id binary, first bigint, n bigint", sorted_shards))
    for parts in reversed(rounds):
        whole = parts.join(runs, "segment_id").select(F.col("whole_id").alias("segment_id"), (F.col("at") + F.col("first")).alias("first"), "n")
        runs = written(runs.join(parts.select("segment_id").distinct(), "segment_id", "left_anti").unionByName(whole))
    runs = where.join(runs, "segment_id").select("text_id", F.struct((F.col("start") + F.col("first")).alias("first"), "n").alias("run"))
    runs = runs.groupBy("text_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    single = held.where("copies = 1").select("text_id", "text").join(runs, "text_id")
    return rows.join(texts.select("text_id", "copies"), "text_id"), single


def _shard_runs(ids: list[bytes], parts: list[bytes], met: list[int], length: int, memory: int) -> Iterator[tuple]:
    """(segment id, first, number) of the neighbouring strings of a segment that repeat."""
    with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
        for segment_id, n, repeats in zip(ids, met, suffix.repeated(parts, length, folder, memory=memory), strict=True):
            if n > 1:  # equal segments were one: all of it repeats
                yield segment_id, 0, len(repeats)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], repeats, [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield segment_id, a, b - a


def removed(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], str]:
    """The maximal runs of removed bytes as (start, stop), and the SHA-256 of the rest, for sorted runs of strings."""
    kept, at, spans = hashlib.sha256(), 0, []
    for first, n in runs:
        stop = first + n + length - 1
        if spans and first <= at:
            spans[-1] = (spans[-1][0], max(at, stop))
        else:
            kept.update(raw[at:first])
            spans.append((first, stop))
        at = spans[-1][1]
    kept.update(raw[at:])
    return spans, kept.hexdigest()


def kept_text(raw: bytes, runs: list[tuple[int, int]], length: int = LENGTH) -> bytes:
    """The text without its repeated strings."""
    mask = np.ones(len(raw), bool)
    for first, n in runs:
        mask[first:first + n + length - 1] = False
    return np.frombuffer(raw, np.uint8)[mask].tobytes()


def removal(docs: DataFrame, *, length: int = LENGTH, text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, repeats (any byte is removed) and removed (array of start, stop) of every row of ``docs``."""
    rows, single = repeated_spans(docs, length=length, text_col=text_col, **options)

    def digest(source: Iterator[tuple]) -> Iterator[tuple]:
        for text_id, words, runs in source:
            spans, kept = removed(words.encode(), [(r["first"], r["n"]) for r in runs], length)
            yield text_id, [{"start": a, "stop": b} for a, b in spans], kept

    cut = written(_mapped(single, "text_id binary, removed array<struct<start:bigint,stop:bigint>>, kept_sha256 string", digest))
    text = text_of(docs, text_col)
    whole = written(docs.select(F.unhex(F.md5(text)).alias("text_id"), F.unhex(F.sha2(text, 256)).alias("sha")).groupBy("text_id").agg(F.first("sha").alias("sha")))
    out = rows.join(whole, "text_id").join(cut, "text_id", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    out = out.select(
        "doc_id", "n_bytes", F.when(all_gone, everything).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(all_gone, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256",
        (F.col("n_bytes") - gone).alias("n_kept"), (F.size("removed") > 0).alias("repeats"), "removed")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that start anywhere else."""
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_suffix_dedup": op1}
ORACLE: dict[str, str] = {}
