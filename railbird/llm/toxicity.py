"""Toxicity by a linear-chain conditional random field: tagged words, spans, scores of documents.

``labels.toxic`` marks documents; training needs tagged words.  They are made from it: in a
toxic training document a word is tagged if one of its features stands in clearly more toxic than
clean training documents (a binomial likelihood ratio beyond what chance gives among so many
features, and at least ``RATIO`` times the share); all words of clean ones are untagged.  A toxic document without such a
word takes no part in the first fit; the fitted field's own spans then tag all toxic
documents for a second one, as far as it finds any.

A document's score comes from the largest marginal of its words, moved so that the split of the training
documents with the fewest errors lies at ``CUT``.  Offending offsets are the runs of words with marginals of at
least a half.  Ids, sources, languages and labels are no features.

Of near copies among the training documents of a kind one is used.  Training reads at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents (the lowest hashes of their ids) of at most
``MAX_BYTES`` bytes, and keeps at most ``MAX_FEATURES`` features: bounds of the model's training alone.  Every
document is scored, whole, in one pass without a shuffle.

Defined results.  A missing text is scored as the empty text, which scores below the cut, whatever the model.  A document
with several labels has their majority, toxic on a tie; labels without a value don't count.  Of labelled rows that
repeat an id the smallest text counts.  With training documents of one kind only, or none, all documents score 0 (clean
or none) or 1 (toxic; the empty text 0).  Rows that repeat an id are each scored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import mixed64, text_of
from railbird.llm.crf import STEPS, Tagger, Vocabulary, fit
from railbird.llm.quality import best_quantile
from railbird.session import written

CUT = 0.7
#: Bounds of the training sample.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES, MAX_FEATURES = 1_500, 3_000, 10_000, 60_000
#: A feature speaks for a tag if its share among toxic documents is this many times that among clean ones.
RATIO = 10.0
#: Words scored at a time, and evidence remembered by word.
PORTION, REMEMBERED = 400_000, 300_000
FIND = re.compile(r"\w+")


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Judge:
    """A field and the log odds of a largest marginal that lie at the cut; without a field a constant score."""

    tagger: Tagger | None
    level: float = 0.0
    constant: float = 0.0

    def scores(self, top: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Scores of documents with these largest marginals; ``empty`` ones have no words."""
        if self.tagger is None:
            return np.where(empty, 0.0, self.constant)
        z = np.clip(log_odds(top) - self.level + np.log(CUT / (1 - CUT)), -30, 30)
        return np.where(empty, 0.0, 1 / (1 + np.exp(-z)))


def telling(vocabulary: Vocabulary, toxic: np.ndarray) -> np.ndarray:
    """True for words with a feature that stands in clearly more toxic texts than chance gives."""
    a, b = vocabulary.texts_with(toxic).astype(float), vocabulary.texts_with(~toxic).astype(float)
    many, few = toxic.sum(), (~toxic).sum()
    share, n = many / (many + few), np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0)
    good = (gain > np.log(max(2, len(a))) + 2) & (a / many >= RATIO * b / few)
    return vocabulary.sums(good.astype(float)) > 0


def one_of_each(texts: list[np.ndarray], *, bands: int = 10, rows: int = 3) -> np.ndarray:
    """True for the first of texts (numbers of words) that share a band of minima of hashed word pairs, nearly always copies of one another."""
    first, keep = [set() for _ in range(bands)], np.ones(len(texts), bool)
    salts = mixed64(np.arange(1, bands * rows + 1, dtype=np.uint64))[:, None]
    for k, words in enumerate(texts):
        x = words.astype(np.uint64)
        x = np.unique(x[:-1] * np.uint64(1 << 32) + x[1:]) if len(x) > 1 else x
        lows = mixed64(mixed64(x)[None, :] ^ salts).min(axis=1) if len(x) else np.zeros(bands * rows, np.uint64)
        marks = [tuple(m) for m in lows.reshape(bands, rows).tolist()]
        keep[k] = not any(m in seen for m, seen in zip(marks, first, strict=True))
        for m, seen in zip(marks, first, strict=True):
            seen.add(m)
    return keep


def numbered(texts: Iterable[str]) -> tuple[list[str], list[np.ndarray]]:
    """The different words of texts in lower case, and every text as numbers of them."""
    book: dict[str, int] = {}
    chains = [np.fromiter((book.setdefault(w, len(book)) for w in FIND.findall(t.lower())), np.int32) for t in texts]
    return list(book), chains


def learned(texts: list[str], toxic: np.ndarray) -> Judge:
    """The judge of whole training texts and their marks."""
    words, chains = numbered(texts)
    # Copies of a text would make all its words look telling.
    keep = np.zeros(len(texts), bool)
    for kind in (toxic, ~toxic):
        keep[np.flatnonzero(kind)] = one_of_each([chains[k] for k in np.flatnonzero(kind)])
    chains, toxic = [c for c, k in zip(chains, keep, strict=True) if k], toxic[keep]
    if not toxic.any() or toxic.all():
        return Judge(None, constant=float(bool(len(toxic) and toxic.all())))
    v = Vocabulary(words, chains, most=MAX_FEATURES)
    inside = toxic[v.text]
    tags = telling(v, toxic)[v.chain] & inside
    if not tags.any():
        return Judge(None)
    tagged = ~toxic | (np.bincount(v.text, weights=tags, minlength=v.n_texts) > 0)
    found, chance = fit(v, tags, tagged)
    more = (chance >= 0.5) & inside | tags
    tagged = ~toxic | (np.bincount(v.text, weights=more, minlength=v.n_texts) > 0)
    tagger, chance = fit(v, more, tagged, begin=found, steps=STEPS // 2)
    top = np.zeros(v.n_texts)
    np.maximum.at(top, v.text, chance)
    odds = log_odds(top)
    return Judge(tagger, best_quantile(odds, toxic))


def held_out(doc_id: str) -> Column:
    """True for ids whose crc32, as text, leaves 1 when divided by 3; these are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, seed: int = 0) -> Judge:
    """The judge of the labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    rows = docs.select("doc_id", text_of(docs).alias("text")).where(F.octet_length("text") <= MAX_BYTES)
    # Ids are chosen before any text moves.
    known = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    toxic, clean = (known.where(F.col("toxic") == kind).orderBy(*order).limit(most) for kind, most in ((True, max_toxic), (False, max_clean)))
    chosen = written(toxic.unionByName(clean))
    # At most max_toxic + max_clean ids: a proven bound for the broadcast, and of MAX_BYTES each for what the driver gets.
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text").toArrow()
    by_id = np.argsort(got.column(0).to_numpy(), kind="stable")
    texts, marks = got.column(2).to_pylist(), got.column(1).to_numpy().astype(bool)
    return learned([texts[k] for k in by_id.tolist()], marks[by_id])


class _Evidence(dict):
    """The evidence of words by the words as they are written."""

    def __init__(self, tagger: Tagger) -> None:
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        e = self[word] = self.tagger.evidence(word)
        return e


def _spans(text: str, chances: np.ndarray) -> list[dict]:
    """The runs of words with marginals of a half or more, as places in the text."""
    out, before = [], -2
    hits = set(np.flatnonzero(chances >= 0.5).tolist())
    for k, m in enumerate(FIND.finditer(text)):
        if k in hits:
            if before == k - 1:
                out[-1]["stop"] = m.end()
            else:
                out.append({"start": m.start(), "stop": m.end()})
            before = k
    return out


def judged(texts: list[str], judge: Judge, evidence: dict[str, float]) -> Iterator[tuple[float, list[dict]]]:
    """Score and spans of every text, in portions of about ``PORTION`` words."""
    def portion(part: list[str], words: list[list[str]]) -> Iterator[tuple[float, list[dict]]]:
        sizes = np.array([len(w) for w in words], np.int64)
        total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
        first = np.zeros(total, bool)
        first[starts[sizes > 0]] = True
        chances = np.zeros(total)
        if judge.tagger is not None:
            e = np.fromiter(map(evidence.__getitem__, chain.from_iterable(words)), float, total)
            chances = judge.tagger.chances(e, first)
        top = np.zeros(len(part))
        if total:
            top[sizes > 0] = np.maximum.reduceat(chances, starts[sizes > 0])
        scores = judge.scores(top, sizes == 0)
        for k, text in enumerate(part):
            spans = _spans(text, chances[starts[k] : starts[k] + sizes[k]]) if top[k] >= 0.5 else []
            yield float(scores[k]), spans

    part, words, held = [], [], 0
    for text in texts:
        found = FIND.findall(text)
        part.append(text)
        words.append(found)
        held += len(found)
        if held >= PORTION:
            yield from portion(part, words)
            part, words, held = [], [], 0
    if part:
        yield from portion(part, words)


def scored(docs: DataFrame, judge: Judge) -> DataFrame:
    """The row of every document as a struct ``doc``, its ``score`` and its offending ``spans`` (start, stop; counted in code points)."""
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(packed.alias("doc"), text_of(docs).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _Evidence(judge.tagger) if judge.tagger else {}
        for batch in source:
            found = list(judged(batch.column(1).to_pylist(), judge, evidence))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], spans)], ["doc", "score", "spans"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc {kind}, score double, spans array<struct<start:long,stop:long>>")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and offending offsets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judge = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner = scored(docs.select("doc_id", "text"), judge).select(F.col("doc.c0").alias("doc_id"), "score", "spans")
    return inner.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")


QUERIES = {"op11_toxic_spans": op11}
ORACLE: dict[str, str] = {}
