"""Induced sorting against plain sorting."""

import random
from collections import Counter

import numpy as np
import pytest

from railbird.llm import suffix as S


@pytest.mark.parametrize("seed", range(12))
def test_order_of_all_suffixes(seed):
    rnd = random.Random(seed)
    t = [rnd.randint(1, rnd.choice([1, 2, 5, 300])) for _ in range(rnd.randint(0, 300))] + [0]
    assert S.suffix_order(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def plain(segments, limit):
    n = Counter(s[i:i + limit] for s in segments for i in range(len(s) - limit + 1))
    return [[n[s[i:i + limit]] > 1 for i in range(max(0, len(s) - limit + 1))] for s in segments]


@pytest.mark.parametrize("memory", [S.MEMORY, 500])
@pytest.mark.parametrize("seed", range(10))
def test_repeated_strings(tmp_path, monkeypatch, seed, memory):
    if memory < S.MEMORY:
        monkeypatch.setattr(S, "BLOCK", 7)
    rnd = random.Random(seed)
    alphabet = ["ab", "abcdé\0", "a"][seed % 3]
    limit = rnd.choice([3, 8, 21, 40])
    whole = "".join(rnd.choices(alphabet, k=400))
    segments = []
    for _ in range(rnd.randint(1, 12)):
        a = rnd.randrange(300)
        piece = whole[a:a + rnd.randint(0, 120)] + "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))
        segments.append(piece.encode())
    segments = list(dict.fromkeys(segments))
    got = [g.tolist() for g in S.repeated(segments, limit, str(tmp_path), memory=memory)]
    assert got == plain(segments, limit)
