"""Bisector tournaments: against plain k-means in Python integers, and odd inputs."""

import hashlib
import math

import compare
import pytest

from railbird.llm import bisectors as B

DATA = "/root/testdata/sf0.001"


def plain(rows, *, k, rounds, seed=1, size=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min(range(len(c)), key=lambda n, v=v: (dist(v, c[n]), n)) for _, v in kept]
        if turn < rounds:
            for n in range(len(c)):
                own = [v for (_, v), m in zip(kept, near, strict=True) if m == n]
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[n]
    far = [dist(v, c[n]) for (_, v), n in zip(kept, near, strict=True)]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((repr(i), n, d, sum(e for e, m in zip(far, near, strict=True) if m == n), sum(far), digest[n]) for (i, _), n, d in zip(kept, near, far, strict=True))


def rows_of(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_query_equals_plain_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = B.op13(spark, DATA)
    assert rows_of(got) == plain(rows, k=16, rounds=3)
    cur = compare.duck(DATA).execute(B.ORACLE["op13_bisector_tournament"])
    assert compare.rows_of([c[0] for c in cur.description], cur.fetchall()) == compare.rows_of(got.columns, [tuple(r) for r in got.collect()])


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_rows(spark, k):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [-0.01, 0.3]), (2, [5.0, -7.51]), (None, [3.0, 3.0]), (4, None), (5, [1.0]), (6, [1.0, None]),
            (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), *((i, [float(i % 7), -i / 3]) for i in range(11, 40))]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, v int, cluster int")
    got = rows_of(B.clusters(df.repartition(5), size=2, k=k, rounds=2))
    assert got == plain(rows, k=k, rounds=2, size=2)
    assert B.clusters(df.limit(0), size=2, k=k, rounds=2).count() == 0


def test_ties_and_wide_numbers():
    cup = B.Tournament([[0, 0], [2, 0], [0, 2], [0, 0]])
    assert cup.nearest(B.whole([[1, 0], [1, 1], [0, 1], [2, 1], [0, 0]])).tolist() == [0, 0, 0, 1, 0]
    big = 10**30
    cup = B.Tournament([[0, 0], [big, 1], [big, 0]])
    v = B.whole([[big, 1], [big, 0], [big // 2, 0], [1, 1]])
    assert cup.nearest(v).tolist() == [1, 2, 0, 0] and cup.distances(v, cup.nearest(v)).tolist() == [0, 0, (big // 2) ** 2, 2]


def test_wide_vectors(spark):
    rows = [(i, [1e30 * (i % 3), float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in B.clusters(df, size=2, k=3, rounds=2).collect()}
    want = {eval(r[0]): r for r in plain(rows, k=3, rounds=2, size=2)}
    assert {i: r.cluster for i, r in got.items()} == {i: r[1] for i, r in want.items()}
    assert all(r.centroid_sha256 == want[i][5] and r.distance == (want[i][2] if want[i][2] < 1 << 63 else None) for i, r in got.items())
