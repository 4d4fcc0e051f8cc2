"""Quality scores from preference pairs by a Bradley-Terry model.

A document labelled good is preferred to one labelled bad.  With features x, the chance that
document a is preferred to b is the logistic function of w * (x_a - x_b); w comes from
logistic loss on the differences of seeded pairs.  The decision is a quantile of the
training scores, the one that separates the labels best; scores are moved so that it lies
at ``CUT`` and squeezed into 0 to 1.

Features are counts over the whole text: how many letters, capitals, digits, marks and blanks
per byte, how long words and lines are, how often words and lines repeat.  Ids, sources,
languages and labels are no features.

Training reads at most ``MAX_LABELLED`` labelled documents (the lowest hashes of their ids)
and ``MAX_PAIRS`` pairs; that is the only bound, and it holds the model's training alone.
Every document is scored.

Defined results.  A missing text is scored as the empty text.  A document with several labels has
their majority, good on a tie; labels without a value don't count.  With labels of one kind
only, every document gets a score on that kind's side of the cut; with none, the cut itself.
Rows that repeat an id are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import text_of

#: Labelled documents used for training at most.
MAX_LABELLED = 8_000
#: Preference pairs drawn from them at most.
MAX_PAIRS = 40_000
CUT = 0.7
N_FEATURES = 19


def features(text: str) -> list[float]:
    """The features of one whole text."""
    raw = text.encode()
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).tolist()
    n = max(1, len(raw))
    upper, lower, digit, high = sum(h[65:91]), sum(h[97:123]), sum(h[48:58]), sum(h[128:])
    blank = h[9] + h[10] + h[13] + h[32]
    words, lines = text.split(), text.split("\n")
    n_words, different = max(1, len(words)), set(words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), upper / n, lower / n, digit / n, blank / n, high / n,
        (n - upper - lower - digit - blank - high) / n, h[46] / n_words, h[44] / n_words, h[124] / n_words,
        (h[33] + h[63]) / n_words, h[10] / n_words, len(raw) / n_words, len(different) / n_words,
        len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), sum(map((4).__gt__, map(len, words))) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
    ]


@dataclass(frozen=True)
class Ranker:
    """score(x) = logistic(slope * (w * clip((x - mean) / scale) - level) + logit(CUT))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    level: float
    slope: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.standard(x) @ self.weights - self.level) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, *, max_pairs: int = MAX_PAIRS, seed: int = 0, ridge: float = 1e-2) -> Ranker:
    """The ranker of feature rows ``x``, of which ``good`` says which are preferred to the others."""
    flat = np.zeros(N_FEATURES)
    if not len(x) or good.all() or not good.any():
        side = 0.0 if not len(x) else (-1.0 if good.all() else 1.0)
        return Ranker(flat, flat + 1, flat, side, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -4, 4)
    rnd = np.random.default_rng(seed)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    n = min(max_pairs, len(better) * len(worse))
    d = z[rnd.choice(better, n)] - z[rnd.choice(worse, n)]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on a convex loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / n - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    return Ranker(mean, scale, w, best_quantile(s, good), 4 / (s.std() + 1e-9))


def best_quantile(scores: np.ndarray, good: np.ndarray) -> float:
    """The score between two neighbours that parts good from bad with the fewest errors; of several, the widest gap."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    errors = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum((~g)[::-1])[::-1], [0]))
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    gaps = np.diff(edges)
    gaps[0] = gaps[-1] = 1e-12
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def held_out(doc_id: str) -> Column:
    """True for ids whose crc32, as text, leaves 2 when divided by 4; these are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and x, the features of column ``text``."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(make, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, seed: int = 0) -> Ranker:
    """The ranker of the labelled rows that are not held out."""
    known = labels.where("quality is not null").select("doc_id", "quality").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    # At most max_labelled rows of an id and a flag: a proven bound for the broadcast, and for what the driver gets.
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    got = _measured(rows, ["doc_id", "good"]).toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    x = np.array(got.column(2).to_pylist(), float).reshape(-1, N_FEATURES)[order]
    return fit(x, got.column(1).to_numpy()[order].astype(bool), seed=seed)


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """Every row of ``docs`` as a struct ``doc`` of c0, c1 and so on, in the order of its columns, and its ``score``."""
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    inner = docs.select(packed.alias("doc"), text_of(docs).alias("text"))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(x))], ["doc", "score"])

    return inner.mapInArrow(make, f"doc {inner.schema['doc'].dataType.simpleString()}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``CUT``, with their columns, whatever their names."""
    good = scored(docs, train(docs, labels, **options)).where(F.col("score") >= CUT)
    return good.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranker = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), ranker).select(F.col("doc.c0").alias("doc_id"), "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op6_quality_ranking": op6}
ORACLE: dict[str, str] = {}
