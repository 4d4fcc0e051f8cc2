"""A linear-chain conditional random field with two tags, in numpy.

Tag 1 marks offending words.  A word's evidence for it is a bias and the weights of its features (the
word in lower case, its first 3 to 6 and last 3 and 4 letters); four weights score neighbouring tags and one a
first word.  Marginals come from the forward-backward sums, training follows the gradient of the conditional
likelihood of tagged words.

Texts are laid end to end: before a first word the sum over the tags is cut, so one chain
holds many texts.  The chain is folded into rows, whose 2 x 2 transfer matrices are
multiplied side by side, and every row starts from the sums of the rows before it.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np


def features(word: str) -> list[str]:
    """The features of one word."""
    w = word.lower()
    out = ["w" + w]
    out += ["p" + w[:n] for n in (3, 4, 5, 6) if len(w) > n]
    out += ["s" + w[-n:] for n in (3, 4) if len(w) > n]
    return out


def marginals(evidence: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, *, pairs: bool = False):
    """The chance of tag 1 for every word; with ``pairs`` also the expected counts of neighbouring tags and of first tags 1.

    ``evidence`` is the log of what speaks for tag 1 against tag 0, ``first`` marks first words, ``trans[i, j]``
    scores tag j after tag i and ``start`` tag 1 of a first word.
    """
    n = len(evidence)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    e, cut = np.zeros(rows * width), np.ones(rows * width, bool)
    e[:n], cut[:n] = evidence, first
    on = 1 / (1 + np.exp(-np.clip(e, -40, 40)))
    # Time runs along the first axis, so that a step reads one stretch of memory.
    on, cut = np.ascontiguousarray(on.reshape(rows, width).T), np.ascontiguousarray(cut.reshape(rows, width).T)
    t, s = np.exp(trans - trans.max()), 1 / (1 + np.exp(-start))
    t00, t01, t10, t11 = (np.where(cut, x, y) for x, y in zip((1 - s, s, 1 - s, s), t.ravel(), strict=True))
    m00, m01, m10, m11 = t00 * (1 - on), t01 * on, t10 * (1 - on), t11 * on

    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(width):
        a, b = p00 * m00[k] + p01 * m10[k], p00 * m01[k] + p01 * m11[k]
        c, d = p10 * m00[k] + p11 * m10[k], p10 * m01[k] + p11 * m11[k]
        whole = a + b + c + d
        p00, p01, p10, p11 = a / whole, b / whole, c / whole, d / whole
    into, out = np.empty((rows, 2)), np.empty((rows, 2))
    x, y = 0.5, 0.5
    for r, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        into[r] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for r, (a, b, c, d) in zip(range(rows - 1, -1, -1), zip(p00[::-1].tolist(), p01[::-1].tolist(), p10[::-1].tolist(), p11[::-1].tolist(), strict=True), strict=True):
        out[r] = x, y
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)

    f0, f1 = np.empty((width + 1, rows)), np.empty((width + 1, rows))
    f0[0], f1[0] = into.T
    for k in range(width):
        a, b = f0[k] * m00[k] + f1[k] * m10[k], f0[k] * m01[k] + f1[k] * m11[k]
        whole = a + b
        f0[k + 1], f1[k + 1] = a / whole, b / whole
    b0, b1 = np.empty((width, rows)), np.empty((width, rows))
    b0[-1], b1[-1] = out.T
    for k in range(width - 1, 0, -1):
        a, b = m00[k] * b0[k] + m01[k] * b1[k], m10[k] * b0[k] + m11[k] * b1[k]
        whole = a + b
        b0[k - 1], b1[k - 1] = a / whole, b / whole
    g0, g1 = f0[1:] * b0, f1[1:] * b1
    chance = (g1 / (g0 + g1)).T.ravel()[:n]
    if not pairs:
        return chance
    inner = ~cut
    joint = [f * m * b for f, m, b in ((f0[:-1], m00, b0), (f0[:-1], m01, b1), (f1[:-1], m10, b0), (f1[:-1], m11, b1))]
    whole = sum(joint)
    counts = np.array([(j / whole)[inner].sum() for j in joint]).reshape(2, 2)
    return chance, counts, float(chance[np.asarray(first, bool)].sum())


@dataclass
class Tagger:
    """Weights of features, and of neighbouring tags."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    start: float

    def evidence(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def chances(self, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(evidence, first, self.trans, self.start)


class Vocabulary:
    """Texts as one chain of word numbers, and the words' features as numbers.

    ``words`` are the different words in lower case, ``texts`` their numbers in every text.
    """

    def __init__(self, words: list[str], texts: list[np.ndarray], *, least: int = 2, most: int = 100_000) -> None:
        self.n_words, self.n_texts = len(words), len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.chain = np.concatenate([np.zeros(0, np.int32), *texts])
        self.starts = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        self.first = np.zeros(len(self.chain), bool)
        self.first[self.starts[sizes > 0]] = True
        names: dict[str, int] = {}
        lists = [np.fromiter((names.setdefault(f, len(names)) for f in features(w)), np.int32) for w in words]
        self.word = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        self.feature = np.concatenate([np.zeros(0, np.int32), *lists])
        # Features of few texts are none, nor are those beyond the most frequent.
        self.names = list(names)
        count = self.texts_with(np.ones(len(texts), bool))
        keep = np.flatnonzero(count >= least)
        keep = np.sort(keep[np.argsort(-count[keep], kind="stable")[:most]])
        number = np.full(len(names), -1, np.int32)
        number[keep] = np.arange(len(keep))
        self.names = [self.names[k] for k in keep.tolist()]
        held = number[self.feature] >= 0
        self.word, self.feature = self.word[held], number[self.feature[held]]

    def texts_with(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts every feature stands."""
        edges = np.searchsorted(self.word, np.arange(self.n_words + 1))
        ends, out = [*self.starts[1:].tolist(), len(self.chain)], np.zeros(len(self.names), np.int64)
        for k in np.flatnonzero(chosen).tolist():
            words = np.unique(self.chain[self.starts[k] : ends[k]])
            n = edges[words + 1] - edges[words]
            at = np.repeat(edges[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[np.unique(self.feature[at])] += 1
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of values of features, the sum for every word."""
        return np.bincount(self.word, weights=values[self.feature], minlength=self.n_words)


#: Gradient steps of a fit, and words whose sums it holds at a time (a longer text has its own).
STEPS, PORTION = 60, 200_000


def fit(vocabulary: Vocabulary, tags: np.ndarray, used: np.ndarray, *, begin: Tagger | None = None, steps: int = STEPS,
        ridge: float = 1.0, rate: float = 0.25) -> tuple[Tagger, np.ndarray]:
    """The field of largest (penalised) conditional likelihood of ``tags``, by adaptive gradient steps, and the words' marginals.

    It starts from ``begin``, if there is one.  Words of texts that are not ``used`` count for nothing.
    """
    v, k = vocabulary, len(vocabulary.names)
    keep = used[v.text]
    chain, first, y = v.chain[keep], v.first[keep], tags[keep].astype(np.int8)
    seen = np.bincount((2 * y[:-1] + y[1:])[~first[1:]], minlength=4).astype(float)
    seen_first = float(y[first].sum())
    # Whole texts, about PORTION words at a time.
    heads = np.flatnonzero(first)
    edges = [0, *heads[np.flatnonzero(np.diff(heads // PORTION)) + 1].tolist(), len(chain)]
    theta = np.zeros(k + 6)
    theta[k] = -3.0
    if begin:
        theta[:] = [*(begin.weights.get(n, 0.0) for n in v.names), begin.bias, *begin.trans.ravel(), begin.start]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        evidence, trans, start = v.sums(theta[:k]) + theta[k], theta[k + 1 : k + 5].reshape(2, 2), theta[k + 5]
        gap, counts, at_first = np.zeros(v.n_words), np.zeros((2, 2)), 0.0
        for a, b in itertools.pairwise(edges):
            words = chain[a:b]
            chance, some, starts = marginals(evidence[words], first[a:b], trans, start, pairs=True)
            gap += np.bincount(words, weights=y[a:b] - chance, minlength=v.n_words)
            counts, at_first = counts + some, at_first + starts
        slope = np.concatenate([np.bincount(v.feature, weights=gap[v.word], minlength=k) - ridge * theta[:k], [gap.sum()], seen - counts.ravel(), [seen_first - at_first]])
        mean += 0.2 * (slope - mean)
        square += 0.05 * (slope * slope - square)
        theta += rate * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
    trans = theta[k + 1 : k + 5].reshape(2, 2).copy()
    tagger = Tagger({n: float(x) for n, x in zip(v.names, theta[:k], strict=True) if abs(x) > 1e-3}, float(theta[k]), trans, float(theta[k + 5]))
    return tagger, marginals_of(v, v.sums(theta[:k]) + theta[k], tagger)


def marginals_of(vocabulary: Vocabulary, evidence: np.ndarray, tagger: Tagger) -> np.ndarray:
    """The marginals of all words of the texts, about ``PORTION`` at a time."""
    v = vocabulary
    heads = np.flatnonzero(v.first)
    edges = [0, *heads[np.flatnonzero(np.diff(heads // PORTION)) + 1].tolist(), len(v.chain)]
    return np.concatenate([np.zeros(0), *(tagger.chances(evidence[v.chain[a:b]], v.first[a:b]) for a, b in itertools.pairwise(edges))])
