"""Source mixing: the schedule's evenness, what it takes, odd rows; and the queries that SQL can express."""

import compare
import pytest

from railbird.llm import mixing as M
from railbird.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = Q.queries()[name](spark, DATA)
    cur = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of(names, cur.fetchall())


def docs_of(spark, sizes):
    rows = [(i, s, " ".join(["w"] * n), "clash") for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string").repartition(4)


def test_targets_fill_up_to_the_limit(spark):
    docs = docs_of(spark, [("a", 10), ("b", 300), ("c", 200), (None, 90), ("é", 0)])
    got = {r.source: (r.source_size, r.weight, r.target) for r in M.source_targets(M.word_sizes(docs)).collect()}
    # a, b, c, é, missing weigh 5, 2, 1, 5, 2; a stops at 30, é at 0, and the missing one at 270 of what 570 / 5 * 2 would give.
    assert got["a"] == (10, 5.0, 30.0) and got["é"] == (0, 5.0, 0.0)
    assert got["b"][2] == pytest.approx(228) and got["c"][2] == pytest.approx(114) and got[None][2] == pytest.approx(228)
    assert sum(t for _, _, t in got.values()) == pytest.approx(600)


def test_slots_are_spread_evenly(spark):
    sizes = [(f"s{i % 4}", 50) for i in range(400)]
    word_sizes = M.word_sizes(docs_of(spark, sizes))
    sources = M.source_targets(word_sizes)
    slots = sorted((r.slot, r.src) for r in M.schedule(sources, block_words=10).collect())
    share = {r.src: r.target / 20_000 for r in sources.collect()}
    assert [s for s, _ in slots] == sorted({s for s, _ in slots})
    for n in (50, 200, 1000, len(slots)):
        for src, p in share.items():
            assert abs(sum(1 for _, s in slots[:n] if s == src) - n * p) <= 8


@pytest.mark.parametrize("block_words", [3, 7, 1000])
def test_taken_words_meet_the_targets(spark, block_words, monkeypatch):
    monkeypatch.setattr(M, "SPLIT_ROWS", 16)
    sizes = [("hot", i % 40) for i in range(300)] + [(None, 13), ("b", 400), ("b", 0), ("c", 2), ("c", 9), ("d", 1)]
    docs = docs_of(spark, sizes)
    docs = docs.unionByName(docs.where("doc_id in (3, 5)"))
    got = M.taken_words(docs, block_words=block_words).collect()
    assert len(got) == len(sizes) + 2 and all(0 <= r.taken <= 3 * r.size for r in got)
    for source in {s for s, _ in sizes}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].source_size == sum(r.size for r in own)
    again = M.taken_words(docs.repartition(3), block_words=block_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_the_mix_takes_whole_stretches_once_a_run(spark):
    docs = docs_of(spark, [("a", 17), ("a", 5), ("b", 40), ("b", 1), ("c", 3)])
    sizes = M.word_sizes(docs)
    rows = M.mix(sizes, M.source_targets(sizes), block_words=4).collect()
    size = {r.doc_id: r.size for r in sizes.collect()}
    seen = set()
    for r in rows:
        words = {(r.doc_id, r.run, w) for w in range(r.first, r.first + r.words)}
        assert r.words > 0 and r.first + r.words <= size[r.doc_id] and not words & seen
        seen |= words


def test_mixed_documents_and_empty_tables(spark):
    docs = docs_of(spark, [("a", 10), ("b", 300), ("c", 200), (None, 90), ("é", 0)]).withColumnRenamed("size", "__n_words")
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    ids = [r.doc_id for r in mixed.collect()]
    assert ids.count(0) == 3 and ids.count(4) == 1 and max(map(ids.count, ids)) <= 3
    assert M.taken_words(docs.limit(0)).count() == 0 and M.mixed_documents(docs.limit(0)).count() == 0
    only = docs.where("doc_id = 4")
    assert [r.taken for r in M.taken_words(only).collect()] == [0]
