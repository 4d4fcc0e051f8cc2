"""The pipeline's stages against plain versions on the small tables."""

from collections import Counter

import numpy as np

import corpus_pipeline as C
from railbird.llm import exact_dedup, mixing, quality, simhash
from test_simhash import plain_components, plain_fingerprint

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(C.STAGES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ranker = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    judged = stage["quality classifier"](spark, docs, DATA)
    good = {i for i, t in texts.items() if ranker.score(np.array([quality.features(t)]))[0] >= quality.CUT}
    assert {r.doc_id for r in judged.collect()} == good and 0 < len(good) < len(texts)

    single = stage["exact dedup"](spark, judged, DATA)
    last = {}
    for i in sorted(good):
        last[texts[i]] = i
    assert sorted(r.doc_id for r in single.collect()) == sorted(last.values())

    apart = stage["near dedup"](spark, single, DATA)
    groups = plain_components({i: plain_fingerprint(texts[i]) for i in last.values()})
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(groups.values()))

    mixed = stage["source mixing"](spark, apart, DATA)
    assert mixed.columns == docs.columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert set(n) <= set(groups.values()) and max(n.values()) <= 3
    assert C.run(spark, DATA).where("piece = 0").count() == sum(n.values())


def test_stages_keep_columns_of_any_name(spark):
    names = ["__k", "__h", "__own", "__n", "__nth", "__quality", "__taken", "known", "hash", "nth", "doc", "size", "n", "score", "taken", "__row", "__id", "__text", "__hash", "c0"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40 + i)) + ".", f"s{i % 2}", *(f"{n}{i}" for n in names)) for i in range(8)] + [(None, None, None, *names)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{n}` string' for n in names)}")
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = [quality.good_documents(docs, labels), exact_dedup.drop_exact_copies(docs), simhash.one_of_each_group(docs), mixing.mixed_documents(docs)]
    for out in made:
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == want[r[0]] for r in got)


def test_exact_copies_with_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x", "c"), (3, "x", "d"), (None, "y", "e"), (4, "y" * 30000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = sorted((r.doc_id or -1, r.group_size, r.kept, r.keep_id) for r in exact_dedup.exact_groups(docs).collect())
    assert got == sorted([
        (-1, 1, True, None), (-1, 2, False, 3), (1, 3, False, 2), (2, 3, True, 2), (2, 3, False, 2), (3, 2, True, 3), (4, 1, True, 4)], key=lambda r: r[:3])
    kept = sorted(r.keep_id for r in exact_dedup.drop_exact_copies(docs).collect())
    assert kept == ["b", "d", "e", "f"] and exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    from pyspark.sql import functions as F

    texts = ["aa", "bb", "aa", "ccc", "bb", "aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda c: F.length(c)
    got = exact_dedup.exact_groups(docs, content_hash=weak, digest=lambda c: F.encode(F.substring(c, 1, 0), "utf-8")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {0: (5, 3), 1: (4, 2), 2: (5, 3), 3: (3, 1), 4: (4, 2), 5: (5, 3)}
