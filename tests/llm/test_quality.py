"""Quality ranking: accuracy on rows held out, and odd inputs."""

import zlib

import numpy as np
import pytest

from railbird.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op6(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    labels = [(got[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([(s >= 0.7) == (q == 1) for s, q in labels]) >= 0.97
    good, bad = [s for s, q in labels if q], [s for s, q in labels if not q]
    assert np.mean([[a > b for a in good] for b in bad]) >= 0.99


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    a, b = Q.train(docs, labels), Q.train(docs, turned)
    assert (a.weights == b.weights).all() and a.level == b.level


def test_level_parts_with_fewest_errors():
    s, g = np.array([0.0, 1.0, 2.0, 5.0, 6.0]), np.array([False, False, False, True, True])
    assert Q.best_quantile(s, g) == pytest.approx(3.5)
    assert np.isfinite(Q.best_quantile(np.array([1.0, 1.0]), np.array([True, False])))


@pytest.mark.parametrize("labels, predicted", [([], 1), ([(1, 1), (2, 1)], 1), ([(1, 0), (2, 0)], 0), ([(1, None), (9, 1)], 1)])
def test_one_kind_of_label(spark, labels, predicted):
    rows = [(1, "a b c", 3.0), (2, None, 1.0), (2, "", 1.0), (None, "x " * 20000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    ranker = Q.train(docs, known)
    kept = Q.good_documents(docs, known)
    assert kept.columns == docs.columns and kept.count() == (4 if predicted else 0)
    assert Q.scored(docs.limit(0), ranker).count() == 0


def test_fit_equals_a_plain_one():
    """The weights against gradient descent on the penalised logistic loss of the same pairs, the scores against the formula."""
    rnd = np.random.default_rng(4)
    good = rnd.random(120) < 0.6
    x = rnd.normal(0, 1, (120, Q.N_FEATURES)) + good[:, None] * np.linspace(0, 1, Q.N_FEATURES)
    got = Q.fit(x, good, seed=7)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -4, 4)
    pick, better, worse = np.random.default_rng(7), np.flatnonzero(good), np.flatnonzero(~good)
    n = min(Q.MAX_PAIRS, len(better) * len(worse))
    d = z[pick.choice(better, n)] - z[pick.choice(worse, n)]
    w = np.zeros(Q.N_FEATURES)
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / n - 1e-2 * w)
    assert np.allclose(got.weights, w, atol=1e-4)
    s = z @ w
    plain = 1 / (1 + np.exp(-(4 / s.std() * (s - Q.best_quantile(s, good)) + np.log(Q.CUT / (1 - Q.CUT)))))
    assert np.allclose(got.score(x), plain, atol=1e-3)
