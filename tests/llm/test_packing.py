"""Packing: ids against the tokenizer, gapless sequences, close to the fewest possible."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from railbird.llm import packing as P

ODD = [
    None, "", " \n", "word", "İstanbul ΣΑΣ σ. a.b, x., don't DON'T 's ''s é ́a", "\x1c\x1d a\xa0b 1234 12.5 ½ x" + " y",
    "<|endoftext|> a<|endoftext|>b <|startoftext|>.", "你好,世界. ª a b\x0bc ΑΣ. ǅ ß ẞ Ω Å ﬁ fi", "$$$ a$$$ ...!? Ab, Ab. Ab.. ab", "long " * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_remembered_ids_are_the_tokenizers(tokenizer):
    rnd = random.Random(2)
    alphabet = "abcdeéÉSIİ'’.,!?$-_ \n\t0123½你Σ́\xa0|<>"
    texts = [t or "" for t in ODD] + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(400)]
    words = P.WordIds(P.default_tokenizer(), remembered=50)
    for _ in range(2):
        for i in range(0, len(texts), 7):
            for text, raw in zip(texts[i:i + 7], words.encode(texts[i:i + 7])):
                assert np.frombuffer(raw, "<u4").tolist() == ids_of(tokenizer, text)[:-1], text


def test_best_fit_takes_the_least_room():
    assert P.best_fit([5, 6, 4, 3, 2], 10) == [[1, 2], [0, 3, 4]]
    assert P.best_fit([], 10) == []
    sizes = random.Random(1).choices(range(1, 101), k=500)
    bins = P.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 100


def test_open_bins_that_do_not_combine_use_all_tasks_of_a_level(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "alpha " * 40) for i in range(400)], "doc_id long, text string").repartition(8)
    levels, kept = [], P.written
    monkeypatch.setattr(P, "written", lambda df: levels.append(kept(df)) or levels[-1])
    got = P.pack(docs, capacity=64, slack=2, chunk=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    # 400 open bins in chunks of 100 ask for four tasks; all went to one.
    assert levels[1].selectExpr("(sequence_id >> 33) & 16777215").distinct().count() == 4


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "slack": 2, "fan_in": 2, "chunk": 40}])
def test_sequences_are_whole_and_gapless(spark, tokenizer, options):
    rnd = random.Random(4)
    texts = ODD + [" ".join(rnd.choices(["alpha", "beta", "zwölf", "x1y"], k=rnd.randint(0, 300))) for _ in range(200)]
    rows = [(i % 150, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(12)
    got = P.pack(docs, **options).collect()
    cap, places, parts = options.get("capacity", 2048), {}, []
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    want = []
    for doc_id, text, _ in rows:
        ids = ids_of(tokenizer, text)
        for k, start in enumerate(range(0, len(ids), cap)):
            cut = ids[start:start + cap]
            want.append((doc_id, k, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted(parts) == sorted(want)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= cap
    assert len(places) <= 1.05 * sum(p[3] for p in parts) / cap + 2


def test_items_that_do_not_combine_end(spark):
    docs = spark.createDataFrame([(i, "word " * 40) for i in range(120)], "doc_id long, text string").repartition(6)
    got = P.pack(docs, capacity=64, fan_in=2, chunk=20).collect()
    assert len({r.sequence_id for r in got}) == 120 and all(r.offset == 0 for r in got)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
