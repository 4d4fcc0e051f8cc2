"""Centroid clustering in whole numbers: nearest centroids by a tournament of bisectors.

For every pair of centroids a < b a normal ``2 (c_b - c_a)`` and a threshold ``|c_b|^2 - |c_a|^2`` are
made once a round.  A vector lies nearer to b exactly if its product with the normal exceeds
the threshold, so k - 1 such sign tests, each between the winner so far and the next
number, leave the nearest centroid; a test that ends at zero keeps the smaller number.  Only the
last winner's distance is computed.  All numbers are whole, so nothing depends on the order of sums.

Every round is one pass without a shuffle of vectors: a task adds its vectors up by centroid and
hands on one row for each centroid and component.

Defined results.  A vector with another number of components, a null or a component that is not finite
(or gets so by scaling) is left out; so is a null vector.  Rows that repeat an id are vectors of
their own; where they decide the start, ties of the hash go to the smaller vector.  A missing id
hashes as the empty text.  With fewer vectors than centroids there are as many centroids as vectors; an
empty table gives an empty table.  A distance or inertia beyond 64 bits is null, its cluster is exact still.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.session import written

COMPONENTS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Up to this size of components all sums of 64 products fit 64 bits.
NARROW = 1 << 27
#: Sums travel as high * LIMB + low, as they may pass 38 digits.
LIMB = 10**18


def whole(rows: np.ndarray | list[list[int]]) -> np.ndarray:
    """Whole numbers as int64 where no product can overflow, else as Python integers."""
    if isinstance(rows, np.ndarray) and (not rows.size or np.abs(rows).max() <= NARROW):
        return rows.astype(np.int64)
    rows = [[int(x) for x in row] for row in rows]
    return np.array(rows, dtype=np.int64 if all(abs(x) <= NARROW for row in rows for x in row) else object)


class Tournament:
    """The bisectors of all pairs of ``centroids``."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = self.centroids = whole(centroids)
        squares = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of every vector."""
        best = np.zeros(len(vectors), np.intp)
        for b in range(1, len(self.centroids)):
            side = (vectors * self.normals[best, b]).sum(axis=1) > self.thresholds[best, b]
            best[side.astype(bool)] = b
        return best

    def distances(self, vectors: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The squared distance of every vector to centroid ``best``."""
        gap = vectors - self.centroids[best]
        return (gap * gap).sum(axis=1)


def whole_vectors(rows: DataFrame, *, id_col: str, vector_col: str, size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the scaled and floored components (whole numbers in doubles, which hold them exactly)."""
    x = F.col(f"`{vector_col}`")
    scaled = F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))
    finite = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # floor() gives longs, which saturate; a double of 2^53 or more is whole as it is.
    floor = F.transform(scaled, lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    return rows.where(x.isNotNull() & (F.size(x) == size)).where(finite).select(F.col(f"`{id_col}`").alias("vec_id"), floor.alias("v"))


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id, in the order of their hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(x) for x in r.v] for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.num_columns - 1)
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of their vectors' means; one without vectors stays."""
    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cup, sums, counts = Tournament(centroids), {}, {}
        for batch in source:
            if not batch.num_rows:
                continue
            v = _matrix(batch)
            best = cup.nearest(v)
            for c in np.unique(best).tolist():
                own = v[best == c]
                sums[c] = sums.get(c, 0) + own.sum(axis=0).astype(object)
                counts[c] = counts.get(c, 0) + len(own)
        rows = [(c, d, *divmod(int(x), LIMB), counts[c]) for c in sums for d, x in enumerate(sums[c])]
        if rows:
            c, d, high, low, n = zip(*rows, strict=True)
            wide = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(map(Decimal, high), wide), pa.array(map(Decimal, low), wide), pa.array(n, pa.int64())],
                ["c", "d", "high", "low", "n"])

    parts = vectors.select("v").mapInArrow(add, "c int, d int, high decimal(38,0), low decimal(38,0), n long")
    # At most k times the number of components: a bound that doesn't follow the table.
    out = [list(c) for c in centroids]
    for r in parts.groupBy("c", "d").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect():
        out[r.c][r.d] = (int(r.high) * LIMB + int(r.low)) // r.n
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cup = Tournament(centroids)
        for batch in source:
            v = _matrix(batch) if batch.num_rows else np.zeros((0, len(centroids[0])), np.int64)
            best = cup.nearest(v)
            far = [int(x) if x < 1 << 63 else None for x in cup.distances(v, best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(find, f"vec_id {kind}, cluster int, distance long")


def clusters(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = COMPONENTS, k: int = CENTROIDS,
    rounds: int = ROUNDS, seed: int = 1,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    vectors = written(whole_vectors(rows, id_col=id_col, vector_col=vector_col, size=size))
    centroids = start(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    found = written(assigned(vectors, centroids) if centroids else vectors.selectExpr("vec_id", "0 as cluster", "0L as distance").limit(0))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # One row for each centroid: k rows at most, broadcast and summed.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"), F.count_if(F.col("distance").isNull()).alias("gaps"))
    per = sums.collect()
    total = None if any(r.gaps for r in per) else sum(int(r.part) for r in per)
    known = [(r.cluster, _long(None if r.gaps else int(r.part)), _long(total), digests[r.cluster]) for r in per]
    table = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x: int | None) -> int | None:
    return x if x is not None and x < 1 << 63 else None


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` that is kept with its cluster."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    dist = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"select vec_id, v.v, c.cluster, {dist} as distance from v cross join c{{n}} c qualify row_number() over (partition by v.vec_id order by distance, c.cluster) = 1"
    mean = ("select cluster, list(x order by d) as v from (select cluster, d, cast(floor_div(sum(x), count(*)) as hugeint) as x from "
            "(select cluster, unnest(range(1, 65)) as d, unnest(v) as x from a{n}) group by cluster, d) group by cluster")
    parts = [
        "v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as hugeint)) as v from embeddings "
        "where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as cluster, v from v qualify cluster < 16)",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} as ({near.format(n=n)})")
        if n < ROUNDS:
            parts.append(f"m{n} as ({mean.format(n=n)})")
            parts.append(f"c{n + 1} as (select c.cluster, coalesce(m.v, c.v) as v from c{n} c left join m{n} m on m.cluster = c.cluster)")
    text = (
        "with " + ",\n".join(parts) + f"\nselect vec_id, cast(a.cluster as int) as cluster, cast(distance as bigint) as distance, "
        "cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, "
        f"sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.cluster = a.cluster")
    # Floors of negative means: division in SQL cuts towards zero.
    return text.replace("floor_div(sum(x), count(*))", "(sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*)")


QUERIES = {"op13_bisector_tournament": op13}
ORACLE = {"op13_bisector_tournament": _oracle()}
