"""Order MinHash fingerprints: likeness that follows edit distance.

The k-mers of a text (``K`` code points) are numbered by occurrence, so repeats count, and
hashed with their number.  The hash deals them into ``BINS`` bins; each bin keeps the
``TUPLE`` smallest, puts them back in text order and hashes the k-mers as a tuple.  Two
texts agree in a bin if they share those k-mers in that order, so moved text counts as
different, as it does for edit distance.  One hash dealt into bins stands for as many
independent ones.  A bin with too few k-mers takes the next full bin's tuple, salted by the
distance; a text without any full bin has bins made of the whole text.

Defined results.  A missing text is empty; all empty texts have one fingerprint.  A text shorter
than a k-mer is one k-mer.  Rows follow each other by id, rows that repeat an id by their
text's hash, a missing id first; the last is followed by the first, a single row by itself.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.llm.common import batches, mixed64, text_of
from railbird.session import written

K = 8
BINS = 64
TUPLE = 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k code points; of all of them if there are fewer."""
    h = mixed64(codes.astype(np.uint64) + np.uint64(1))
    width, factor, want = 1, _A, min(k, len(codes))
    out, done, rest = None, 0, h
    with np.errstate(over="ignore"):
        while want:
            if want & 1:
                if out is None:
                    out, done = rest, width
                else:
                    n = len(h) - done - width + 1
                    out, done = out[:n] * factor + rest[done:done + n], done + width
            want >>= 1
            if want:
                n = len(rest) - width
                rest, width = rest[:n] * factor + rest[width:width + n], 2 * width
                factor = factor * factor
    return mixed64(out)


def signature(text: str, *, k: int = K, bins: int = BINS, tuple_size: int = TUPLE) -> np.ndarray:
    """``bins`` 16-bit values."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    steps = np.arange(bins, dtype=np.uint64)
    whole = mixed64(steps * _B + np.uint64(xxhash.xxh64_intdigest(text.encode())))
    if not len(codes):
        return (whole >> np.uint64(48)).astype(np.uint16)
    kmer = _kmers(codes, k)
    n = len(kmer)
    low = np.uint64(n.bit_length())
    ordered = np.sort((kmer >> low << low) | np.arange(n, dtype=np.uint64))
    at, key = (ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), ordered >> low
    index = np.arange(n)
    first = np.zeros(n, np.int64)
    new = np.flatnonzero(key[1:] != key[:-1]) + 1
    first[new] = new
    nth = (index - np.maximum.accumulate(first)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mixed64(key * _A + nth * _B)
    shift = np.uint64(64 - (bins - 1).bit_length())
    low_part = h & ((np.uint64(1) << shift) - np.uint64(1))

    # The smallest of each bin are almost surely among the smallest few of all; else all are sorted.
    share = 8 * bins * tuple_size / n
    few = np.flatnonzero(low_part < np.uint64(int(share * float(1 << int(shift))))) if share < 1 else index
    for some in (few, index):
        order = some[np.argsort(h[some], kind="stable")]
        starts = np.searchsorted(h[order] >> shift, np.arange(bins + 1, dtype=np.uint64))
        full = np.diff(starts) >= tuple_size
        if full.all() or len(some) == n:
            break
    if not full.any():
        return (whole >> np.uint64(48)).astype(np.uint16)
    pick = order[np.minimum(starts[:-1, None] + np.arange(tuple_size), len(order) - 1)]
    places = np.sort(at[pick], axis=1)
    value = np.zeros(bins, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(tuple_size):
            value = mixed64(value * _B + kmer[places[:, i]])
        if not full.all():
            ahead = np.flatnonzero(np.concatenate((full, full)))
            source = ahead[np.searchsorted(ahead, np.arange(bins))]
            value = np.where(full, value, mixed64(value[source % bins] + (source - np.arange(bins)).astype(np.uint64) * _A))
        value = mixed64(value + steps)
    return (value >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, *, tuple_size: int = TUPLE) -> float:
    """The share of equal bins, brought back from tuples to single k-mers by its root."""
    return float((a == b).mean()) ** (1 / tuple_size)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many code points of another."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _bytes(sig: np.ndarray) -> bytes:
    return sig.astype(">u2").tobytes()


def _compared(doc_id, text: str, sig: np.ndarray, following: str, next_sig: np.ndarray) -> tuple:
    other = edited(text, following)
    other_sig = signature(other) if other != text else sig
    return (doc_id, len(text), hashlib.sha256(other.encode()).digest(), _bytes(sig), _bytes(other_sig),
            likeness(sig, other_sig), likeness(sig, next_sig))


_RESULT = "doc_id {id}, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_EDGES = "task int, last boolean, text string"


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def neighbour_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The rows are dealt by ranges of the id and sorted in each, once.  A task's last document
    needs the next task's first one: those two per task are written beside the results and
    compared afterwards, so what meets in one place follows the number of tasks.
    """
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ddl = _RESULT.format(id=id_type)
    schema = _arrow(spark, f"{ddl}, {_EDGES}")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[tuple]:
            task, held = TaskContext.get().partitionId(), None
            for doc_id, words, _ in _rows(source):
                sig = signature(words)
                if held is None:
                    yield (doc_id, *[None] * 6, task, False, words)
                else:
                    yield (*_compared(*held, words, sig), None, None, None)
                held = doc_id, words, sig
            if held is not None:
                yield (held[0], *[None] * 6, task, True, held[1])

        yield from batches(results(), schema, 512)

    dealt = rows.repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = written(dealt.mapInArrow(make, f"{ddl}, {_EDGES}"))

    # Only the numbers of the tasks are put in one order, a number each; texts then find each other by them.
    edges = found.where("last is not null").select("doc_id", "task", "last", "text")
    order = Window.orderBy("task")
    after = edges.where("last").select("task").withColumn("next", F.coalesce(
        F.lead("task").over(order), F.first("task").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = edges.where("not last").select(F.col("task").alias("next"), F.col("text").alias("following"))
    edges = edges.where("last").join(after, "task").join(firsts, "next")

    def join_up(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (_compared(i, a, signature(a), b, signature(b)) for i, a, b in _rows(source))
        yield from batches(pairs, pa.schema(list(schema)[:7]), 512)

    borders = edges.select("doc_id", "text", "following").mapInArrow(join_up, ddl)
    names = [f.name for f in borders.schema]
    out = found.where("last is null").select(*names).unionByName(borders)
    digits = {n: F.lower(F.hex(n)) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return out.withColumns(digits)


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return neighbour_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_order_minhash": op3}
ORACLE: dict[str, str] = {}
