"""SimHash groups against all pairs, and the covering code's promises."""

import random

import numpy as np
import pytest
import xxhash

from railbird.llm import simhash as S


def plain_fingerprint(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeÉß", k=rnd.randint(1, 6))) for _ in range(60)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.5:
            words = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rnd.choices(vocab, k=rnd.randint(1, 120))))
    return out


@pytest.mark.parametrize("text", ["", " \t\n", "A", "a b c", "A b\x0bC  d e", "É " * 9, "x " * 70_000, "a\xa0b c\x1cd"])
def test_fingerprint(text):
    assert S.simhash(text) == plain_fingerprint(text)


def test_every_word_has_an_anchor_within_three():
    code = S.Golay()
    words = np.arange(1 << 23, dtype=np.uint32)[:: 97]
    homes = code.home(words)
    assert np.bitwise_count(homes ^ words).max() == 3
    assert (code.home(homes) == homes).all()


def test_close_words_meet():
    code, rnd = S.Golay(), np.random.default_rng(1)
    words = rnd.integers(0, 1 << 22, 500).astype(np.uint32)
    rows, anchors = code.anchors(words, 22)
    met = set(zip(rows.tolist(), anchors.tolist()))
    for i, w in enumerate(words):
        for bit in range(22):
            other = code.home(np.array([w ^ np.uint32(1 << bit)]))[0]
            assert (i, int(other)) in met


@pytest.mark.parametrize("slice_size", [4096, 3])
def test_groups_match_all_pairs(spark, slice_size, monkeypatch):
    monkeypatch.setitem(S.links.__kwdefaults__, "slice_size", slice_size)
    data = texts(3, 160) + [None, "", "  "]
    rows = [(i * 7 % 1000, t, "x") for i, t in enumerate(data)]
    got = S.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {i: plain_fingerprint(t or "") for i, t, _ in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == plain_components(fps)


def test_near_fingerprints_of_a_hot_centre(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(400)} | {0, 1 << 63}
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    found = S.links(df, slice_size=50).collect()
    numbered = dict(enumerate(sorted(fps)))
    of = {f: i for i, f in numbered.items()}
    for r in found:
        assert (numbered[of[r.a % (1 << 64)]] ^ r.b % (1 << 64)).bit_count() <= 4
    got = {r.node % (1 << 64): r.root for r in S.components(S.links(df, slice_size=50)).collect()}
    want = plain_components(numbered)
    groups = {}
    for i, f in numbered.items():
        groups.setdefault(got.get(f, S._signed(f)), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_one_of_each_group_with_odd_rows(spark):
    rows = [(5, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (None, None, 3), (None, "", 4), (9, "q r s t u v", 5), (9, "zz yy", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = sorted((r.doc_id or -1, r.text or "", r.component_id) for r in S.one_of_each_group(docs).collect())
    assert [k[:2] for k in kept] == [(-1, ""), (3, "a b c d e"), (9, "q r s t u v"), (9, "zz yy")]
    assert S.one_of_each_group(docs.limit(0)).count() == 0
