"""Repeated strings against counting all of them."""

import hashlib
import random
from collections import Counter

import pytest

from railbird.llm import suffix_dedup as D

DATA = "/root/testdata/sf0.001"


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if n[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = bytes(gone).lstrip(b"\0").replace(b"\0", b" ").split()
        out.append((i, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain(rows, 400)
    got = sorted((tuple(r)[:5] for r in D.op1(spark, DATA).collect()), key=str)
    assert got == want and sum(r[2] for r in want) > 0


def corpus(seed, n):
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choices("abcdefg é", k=k))
    shared = [make(60) for _ in range(4)]
    texts = [None, "", "x" * 3000, "xy" * 700, "x" * 19, "tiny"]
    for _ in range(n):
        parts = [make(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "Z"
            parts += ["".join(p), make(rnd.randint(0, 40))]
        texts.append("".join(parts))
    texts += rnd.choices(texts, k=10)
    return [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[8]), (7, texts[20]), (7, texts[20])]


@pytest.mark.parametrize("options", [
    {"gram": 8}, {"gram": 8, "hot": 3, "step": 4}, {"gram": 4, "hot": 1, "step": 5, "shard_bytes": 900, "memory": 2000}])
def test_small_strings(spark, options):
    rows = corpus(len(options), 70)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_id string").repartition(5)
    got = D.removal(docs, length=20, **options).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, 20)
    for r in got:
        assert r.n_kept == r.n_bytes - r.n_removed and r.repeats == (r.n_removed > 0) and len(r.removed) == r.n_spans
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed and all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))


@pytest.mark.parametrize("step", [8, 6])
def test_edges_of_a_passage_with_many_contexts(spark, monkeypatch, step):
    rnd = random.Random(step)
    make = lambda k: "".join(rnd.choices("abcdefgh", k=k))
    passage, near = make(90), make(7)
    texts = [make(30) + (near if i % 3 else "") + passage + make(30) for i in range(150)]
    rows = list(enumerate([*texts, passage, passage[5:60], passage[20:] + near, texts[3][9:]]))
    dealt, mapped = [], D._mapped
    monkeypatch.setattr(D, "_mapped", lambda df, ddl, *a: dealt.append(df) or mapped(df, ddl, *a))
    got = D.removal(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=8, hot=10, step=step, shard_bytes=300).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, 20)
    # Without the further cuts, the 150 segments of an edge are in one shard.
    (shards,) = [df for df in dealt if "shard" in df.columns]
    assert shards.groupBy("shard").count().agg({"count": "max"}).first()[0] < 60


def test_empty_table(spark):
    assert D.removal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_cut_out():
    raw = bytes(range(100))
    runs = [(10, 3), (20, 1), (40, 5), (41, 2), (90, 1)]
    spans, digest = D.removed(raw, runs, 10)
    assert D.kept_text(raw, runs, 10) == raw[:10] + raw[30:40] + raw[54:90]
    assert spans == [(10, 30), (40, 54), (90, 100)] and digest == hashlib.sha256(D.kept_text(raw, runs, 10)).hexdigest()
