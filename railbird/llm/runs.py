"""Periodic runs of words: harmonic-grid candidates, extended exactly on a run-length grammar.

A run is a stretch of words with smallest period q, at least ``max(24, 3 q)`` long, that no neighbouring
word extends keeping period q.  Its words i and i + q are equal on a stretch of at least ``max(24 - q, 2 q)``
places, so a grid of that step meets it for every q: about ``n ln n / 2`` candidates (i, i + q) for a
text of n words.  Candidates whose first words are equal are extended to both sides by the grammar
(``recompression``); the two lengths give the run with nothing left to verify.  A run is found for multiples
of its period too; of equal stretches the smallest period counts.

Texts are worked on where they lie, without a shuffle: a task lays whole texts end to end, up to about
``WORDS`` words, and builds one grammar for them; a longer text has one of its own.  Candidates
are made in portions of about ``CANDIDATES``.  So memory follows the longest text, and a lost task
only repeats its own rows.

Defined results.  Words are the stretches between the blanks ``\\x20`` and ``\\x09`` to ``\\x0D``; a missing text has none.
Without words there are no runs and the collapsed text is empty.  Of runs with the same exponent the first one, then the
smallest period, counts.  A missing id hashes as the empty text.  Rows that repeat are each judged; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import batches, text_of
from railbird.llm.recompression import Grammar

#: Words of the texts that share a grammar, and candidates held at a time.
WORDS = 200_000
CANDIDATES = 1_000_000
#: A run has at least this many words, and this many periods.
SHORTEST, PERIODS = 24, 3


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of every sequence of word numbers as (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    marks = -1 - np.arange(len(texts) + 1, dtype=np.int64)
    parts = [marks[:1]]
    for n, text in enumerate(texts):
        parts += [text, marks[n + 1 : n + 2]]
    s = np.concatenate(parts)
    bases = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    grammar, found = None, []
    for doc, i, period in _candidates(s, sizes, bases):
        if not len(i):
            continue
        grammar = grammar or Grammar(s)
        ahead, behind = grammar.extension(i, i + period, 1), grammar.extension(i - 1, i + period - 1, -1)
        length = ahead + behind + period
        good = length >= np.maximum(SHORTEST, PERIODS * period)
        found.append(np.unique(np.stack([doc, i - behind - bases[doc], length, period], axis=1)[good], axis=0))
    if found:
        rows = np.unique(np.concatenate(found), axis=0)  # by text, start, length, period
        first = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if len(rows) else np.zeros(0, bool)
        rows = rows[first]
        for doc, start, length, period in rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].tolist():
            out[doc].append((start, length, period))
    return out


def _candidates(s: np.ndarray, sizes: np.ndarray, bases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of (text, place, period) on the grids whose words at place and place + period are equal."""
    periods = np.where(sizes >= SHORTEST, sizes // PERIODS, 0)
    ends = np.cumsum(periods)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        # Up to CANDIDATES pairs of text and period at a time, then portions of their grid points.
        slot = np.arange(at, min(total, at + CANDIDATES))
        doc = np.searchsorted(ends, slot, side="right")
        period = slot - (ends[doc] - periods[doc]) + 1
        step = np.maximum(SHORTEST - period, (PERIODS - 1) * period)
        points = -(-(sizes[doc] - period) // step)
        upto = np.cumsum(points)
        lo = 0
        while lo < len(slot):
            done = int(upto[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + CANDIDATES, side="right")))
            n = points[lo:hi]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(bases[doc[lo:hi]], n) + nth * np.repeat(step[lo:hi], n)
            q = np.repeat(period[lo:hi], n)
            same = np.flatnonzero(s[i] == s[i + q])
            yield np.repeat(doc[lo:hi], n)[same], i[same], q[same]
            lo = hi
        at += len(slot)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the query plants by the hash of the id."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of several the first, then that of the smallest period."""
    def order(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
        gap = b[1] * a[2] - a[1] * b[2]
        return gap or (a[0] - b[0]) or (a[2] - b[2])

    return min(runs, key=cmp_to_key(order), default=None)


def _numbers(words: list[bytes], book: dict[bytes, int]) -> np.ndarray:
    return np.fromiter([book.setdefault(w, len(book)) for w in words], np.int64, len(words))


def _described(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    top = strongest(runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    if runs:
        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _portions(rows: Iterator[tuple[int | None, list[bytes]]], most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run, and the digests of all runs and of the text without their repeats, for every row.

    ``plant`` first writes the query's test repetitions into the texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = (f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")
    longs = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def read() -> Iterator[tuple[int | None, list[bytes]]]:
            nonlocal schema
            for batch in source:
                schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), *longs, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = text.as_py().encode().split()  # of bytes: cuts at ASCII blanks only
                    yield doc_id, planted(words, doc_id) if plant else words

        def found() -> Iterator[tuple]:
            for portion in _portions(read(), WORDS):
                book: dict[bytes, int] = {}
                for (doc_id, words), runs in zip(portion, find_runs([_numbers(w, book) for _, w in portion]), strict=True):
                    yield _described(doc_id, words, runs)

        rows = found()
        first = next(rows, None)
        if first is not None:
            yield from batches(_chained(first, rows), schema)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(judge, ddl)


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of them planted as the query's contract says."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


QUERIES = {"op12_periodic_runs": op12}
ORACLE: dict[str, str] = {}
