"""Periodic runs: grammar extensions and whole results against plain code, and odd rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from railbird.llm import runs as R
from railbird.llm.recompression import Grammar

DATA = "/root/testdata/sf0.001"


def sequences(seed):
    """Texts over small alphabets, many of them with repeated stretches."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rng.integers(1, 7)):
        d = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40))
        for _ in range(rng.integers(0, 3)):
            d = np.concatenate([d[: len(d) // 2], np.tile(d[len(d) // 3 :], rng.integers(1, 6)), d[: len(d) // 4]])[:400]
        out.append(d.astype(np.int64))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_extensions(seed):
    docs, rng = sequences(seed), np.random.default_rng(seed)
    s = np.concatenate([[-1], *(x for k, d in enumerate(docs) for x in (d, [-2 - k]))]).astype(np.int64)
    inner = np.flatnonzero(s >= 0)
    if len(inner) < 2:
        return
    i, j = rng.choice(inner, 300), rng.choice(inner, 300)
    i, j = i[i != j], j[i != j]
    grammar = Grammar(s)
    for step in (1, -1):
        for x, y, n in zip(i, j, grammar.extension(i, j, step), strict=True):
            assert (s[x : x + n] == s[y : y + n]).all() if step > 0 else (s[x - n + 1 : x + 1] == s[y - n + 1 : y + 1]).all()
            assert s[x + n * step] != s[y + n * step]


def plain_runs(words):
    """All maximal stretches of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_random_texts(seed, monkeypatch):
    monkeypatch.setattr(R, "CANDIDATES", 37 if seed % 2 else 10**6)
    docs = sequences(seed)
    assert R.find_runs(docs) == [sorted(plain_runs(d.tolist()), key=lambda r: (r[0], r[2])) for d in docs]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_query_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in R.op12(spark, DATA).collect()}
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 10
    for i, t in docs:
        if len(t or "") < 20_000:
            assert got[i] == plain(i, t)


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "x " + "a b " * 12 + "c", "é b " * 30, "a\x85b " * 30, "a b c a b c " * 40_000, "z" * 300_000, ("p q r s " * 9 + "t u ") * 5]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)] + [(1, "a " * 30, 2, "m"), (None, "b " * 30, 2, "m"), (None, None, 2, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, n_runs string")
    for plant in (False, True):
        got = sorted(map(repr, R.periodic_runs(df.repartition(3), plant=plant).collect()))
        assert len(got) == len(rows)
        if plant:
            assert got == sorted(repr(r) for r in _as_rows([plain(i, t) for i, t, *_ in rows if t is None or len(t) < 400_000], R.periodic_runs(df.where("length(text) >= 400000"), plant=True).collect()))
    long = R.periodic_runs(df.where("doc_id = 9")).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 240_000, 3)
    assert R.periodic_runs(df.limit(0)).count() == 0


def _as_rows(tuples, others):
    from pyspark.sql import Row

    kind = Row("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return [kind(*t) for t in tuples] + others


def test_ties_go_to_the_first_then_the_smallest_period():
    assert R.strongest([(5, 30, 10), (3, 60, 20), (3, 30, 10), (0, 29, 10)]) == (3, 30, 10)
    assert R.strongest([]) is None
