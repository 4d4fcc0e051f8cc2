"""Order MinHash: the k-mers chosen against a plain version, neighbours in order, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from railbird.llm import fingerprints as P
from railbird.llm.common import mixed64


def plain_bins(text):
    """For each bin the places of the two smallest numbered k-mers, in text order; None if there are fewer."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kmer = P._kmers(codes, P.K)
    low, seen, found = len(kmer).bit_length(), {}, {}
    for at, h in enumerate(kmer.tolist()):
        nth = seen.get(h, 0)
        seen[h] = nth + 1
        key = np.array([(h >> low) * 0x9E3779B97F4A7C15 + nth * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1], np.uint64)
        g = int(mixed64(key)[0])
        found.setdefault(g >> 58, []).append((g, at))
    return {b: sorted(at for _, at in sorted(x)[:2]) for b, x in found.items() if len(x) > 1}, kmer


@pytest.mark.parametrize("n", [9, 60, 400, 3000])
def test_bins_hold_the_smallest_in_text_order(n):
    rnd = random.Random(n)
    text = "".join(rnd.choices("ab cé", k=n))
    chosen, kmer = plain_bins(text)
    got = P.signature(text)
    for b, places in chosen.items():
        value = np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            for at in places:
                value = mixed64(value * P._B + kmer[at:at + 1])
            value = mixed64(value + np.uint64(b))
        assert got[b] == int(value[0] >> np.uint64(48))


def test_kmers_are_equal_where_text_is():
    text = "the cat sat on the cat sat on the mat"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    for k in (1, 2, 3, 5, 7, 8, 12):
        h = P._kmers(codes, k).tolist()
        assert len(h) == len(text) - k + 1
        grams = [text[i:i + k] for i in range(len(h))]
        assert len(set(h)) == len(set(grams)) and len(set(zip(h, grams))) == len(set(h))


def test_likeness_falls_with_edits_and_with_order():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(400)]
    text = " ".join(words)
    few = " ".join(["zzzzzz" if i % 50 == 0 else w for i, w in enumerate(words)])
    many = " ".join(["zzzzzz" if i % 5 == 0 else w for i, w in enumerate(words)])
    turned = " ".join(words[::-1])
    a, b, c, d = (P.likeness(P.signature(text), P.signature(t)) for t in (text, few, many, turned))
    assert a == 1 and b > 0.7 > c > d


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
def test_neighbours_and_odd_rows(spark, partitions):
    texts = ["", None, "a", "abc", "abcd", "x" * 40_000, "héllo wörld " * 30, "\U0001F600" * 9, "abcd", "word word", ""]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (6, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.neighbour_fingerprints(docs).collect()
        one = P.neighbour_fingerprints(docs.where("doc_id = 9")).collect()
        none = P.neighbour_fingerprints(docs.limit(0)).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    tie = {(r[0], r[1]): r[2] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[:2]]))
    want = {}
    for (i, a, _), (_, b, _) in zip(order, order[1:] + order[:1]):
        other = P.edited(a or "", b or "")
        want[i, len(a or ""), hashlib.sha256(other.encode()).hexdigest()] = (P._bytes(P.signature(a or "")).hex(), P._bytes(P.signature(other)).hex())
    assert {(r.doc_id, r.n_chars, r.edited_sha256): (r.fingerprint, r.edited_fingerprint) for r in got} == want
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [(r.near_edited, r.near_next) for r in one] == [(1.0, 1.0)] and none == 0
