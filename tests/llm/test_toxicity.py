"""Toxic spans: the field against sums over all taggings, accuracy on rows held out, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from railbird.llm import crf, toxicity as T

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40, 130])
def test_marginals_equal_sums_over_taggings(n):
    rng = np.random.default_rng(n)
    e, first, trans, start = rng.normal(0, 3, n), rng.random(n) < 0.3, rng.normal(0, 1, (2, 2)), 0.4
    first[::9] = True
    got, counts, at_first = crf.marginals(e, first, trans, start, pairs=True)
    want, pairs, edges = np.zeros(n), np.zeros((2, 2)), [*np.flatnonzero(first).tolist(), n]
    for a, b in itertools.pairwise(edges):
        total, tag, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(start * y[0] + (e[a:b] * y).sum() + sum(trans[p] for p in itertools.pairwise(y)))
            total, tag = total + w, tag + w * np.array(y)
            for p in itertools.pairwise(y):
                pair[p] += w
        want[a:b], pairs = tag / total, pairs + pair / total
    assert np.allclose(got, want) and np.allclose(counts, pairs) and np.isclose(at_first, want[first].sum())


def test_gradient_ends_where_expected_counts_meet_the_tags(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [[rng.choice(["good", "fine", "bad", "worse", "the"]) for _ in range(30)] for _ in range(60)]
    v = crf.Vocabulary(*T.numbered(map(" ".join, texts)))
    tags = np.array([w in ("bad", "worse") for t in texts for w in t]) & (rng.random(1800) < 0.9)
    tagger, chance = crf.fit(v, tags, np.ones(60, bool), steps=400)
    assert abs(chance.sum() - tags.sum()) < 0.02 * tags.sum()
    assert tagger.evidence("BAD") > tagger.evidence("unknown") > tagger.evidence("good")
    e = np.array([tagger.evidence(w) for t in texts for w in t])
    assert np.allclose(tagger.chances(e, v.first), chance, atol=1e-3)


    alone = crf.fit(v, tags, np.ones(60, bool), steps=10)[1]
    monkeypatch.setattr(crf, "PORTION", 100)
    assert np.allclose(alone, crf.fit(v, tags, np.ones(60, bool), steps=10)[1], atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in T.op11(spark, DATA).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert all(0 <= s.start < s.stop <= len(text[i]) and not text[i][s.start : s.stop].isspace() for s in r.spans)
    known = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r.doc_id].held_out and r.toxic is not None]
    # A few dozen toxic training documents hold too little of the rarer languages; none is taken for toxic wrongly.
    assert all(t for t, p in known if p) and np.mean([p for t, p in known if t]) >= 0.75
    words = {text[i][s.start : s.stop].lower() for i, r in got.items() if r.predicted for s in r.spans}
    assert {"idiot", "scum", "moron"} <= words


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = T.train(docs, labels), T.train(docs, turned)
    assert a.tagger.weights == b.tagger.weights and a.level == b.level


def test_copies_count_once():
    base = [f"w{k} w{k + 1} x{k % 7}" for k in range(400)]
    texts = [" ".join(base[:100]), " ".join(base[:99] + ["other"]), " ".join(base[200:]), "", "a", "A"]
    assert T.one_of_each(T.numbered(texts)[1]).tolist() == [True, False, True, True, True, False]


@pytest.mark.parametrize("labels, predicted", [([], 0), ([(1, 0), (2, 0)], 0), ([(1, 1), (2, 1), (3, 1)], 1), ([(1, None), (9, 1), (None, 1)], 0)])
def test_one_kind_of_label(spark, labels, predicted):
    rows = [(1, "a b c", 3.0, "x"), (2, None, 1.0, "x"), (2, "", 1.0, "x"), (3, "a b", 0.0, None), (None, "é " * 300_000, 0.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, spans string")
    judge = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = T.scored(docs, judge).select("doc.c0", "doc.c1", "score", "spans").collect()
    assert len(got) == 5 and all((r.score >= T.CUT) == bool(predicted and r.c1) and r.spans == [] for r in got)
    assert T.scored(docs.limit(0), judge).count() == 0


def test_spans_count_code_points():
    tagger = crf.Tagger({"wbad": 12.0}, -6.0, np.zeros((2, 2)), 0.0)
    judge = T.Judge(tagger)
    texts = ["ééé bad, bad ok BAD", "ok", "", "bad " * 5]
    found = list(T.judged(texts, judge, T._Evidence(tagger)))
    assert [[texts[k][s["start"] : s["stop"]] for s in spans] for k, (_, spans) in enumerate(found)] == [["bad, bad", "BAD"], [], [], ["bad bad bad bad bad"]]
    assert [s >= T.CUT for s, _ in found] == [True, False, False, True]
