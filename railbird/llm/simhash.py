"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is cut into three parts of 22, 21 and 21 bits.  Two fingerprints
that differ in at most four bits differ in at most one bit in some part.  Each part,
padded with zeros to 23 bits, lies within three bits of exactly one word of the
perfect binary Golay code: its anchor.  A fingerprint is at home at its own anchor and
is replicated to every anchor that is home to a word within one bit of it, all of them
within the covering radius plus the threshold.  So two fingerprints with close parts meet
where one is at home.  All meetings at an anchor are compared, in blocks.

What grows and how.  Equal fingerprints are one.  An anchor's homes are dealt into slices of
at most ``SLICE`` on average, and replicas go to every slice, so no task has to hold
a hot anchor.  A slice gives a spanning forest of its links, never all pairs.  Components come from
rounds of pointing every fingerprint at its smallest neighbour and jumping on; the number
of rounds follows the logarithm of a component's length.

Defined results.  A missing text and one without words have fingerprint zero, which links like
any other.  A missing id is the largest; its component is named by the smallest id there is.
Rows that repeat an id all come out.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.llm.common import batches, text_of
from railbird.session import written

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: (first bit, width) of the parts.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Homes compared together at one anchor.
SLICE = 4096
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def simhash(text: str, *, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text: a bit is 1 if set in over half the shingle hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1:] - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)), np.uint64, n)
    if n > 1:
        return _majority(hashes, n)
    return int(hashes[0])


def _majority(hashes: np.ndarray, n: int) -> int:
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash (tells rows that repeat an id apart) and fp (the fingerprint's bits as a signed integer) of every row."""
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps = [_signed(simhash(t, shingle=shingle, seed=seed)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(make, f"doc_id {id_type}, text_hash bigint, fp bigint")


def _syndromes() -> np.ndarray:
    """For each of the 2048 syndromes the error of at most three bits that makes it."""
    single = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= GOLAY << (j - 11)
        single.append(r)
    table = np.zeros(2048, np.uint32)
    for i in range(23):
        table[single[i]] = 1 << i
        for j in range(i):
            table[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                table[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return table


class Golay:
    """Nearest code words of 23-bit words, in bulk."""

    def __init__(self) -> None:
        self.errors = _syndromes()

    def home(self, words: np.ndarray) -> np.ndarray:
        r = words.astype(np.uint32, copy=True)
        for j in range(22, 10, -1):
            r ^= (r >> np.uint32(j) & np.uint32(1)) * np.uint32(GOLAY << (j - 11))
        return words.astype(np.uint32) ^ self.errors[r]

    def anchors(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) pairs: every anchor that is home to a word within one bit; the row's own home is among them."""
        near = np.stack([self.home(words), *[self.home(words ^ np.uint32(1 << i)) for i in range(width)]], axis=1)
        near.sort(axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        rows, _ = np.nonzero(first)
        return rows, near[first]


def _part(fps: np.ndarray, part: int) -> np.ndarray:
    at, width = PARTS[part]
    return (fps.view(np.uint64) >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)


_PLACES = pa.schema([("part", pa.int32()), ("anchor", pa.int32()), ("home", pa.bool_()), ("fp", pa.int64())])


def _places(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in source:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for part, (_, width) in enumerate(PARTS):
            words = _part(fps, part)
            rows, anchors = code.anchors(words, width)
            own = code.home(words)[rows] == anchors
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), part, np.int32)), pa.array(anchors.astype(np.int32)), pa.array(own), pa.array(fps[rows]),
            ], schema=_PLACES)


def _forest(homes: np.ndarray, others: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one slice: every link found joins two trees, so there are fewer links than fingerprints."""
    all_fps = np.unique(np.concatenate((homes, others)))
    parent = np.arange(len(all_fps))
    at_home, bits = np.searchsorted(all_fps, homes), all_fps.view(np.uint64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, len(at_home), 256):
        rows = at_home[i:i + 256]
        for j in range(0, len(bits), 1 << 14):
            near = np.bitwise_count(bits[rows][:, None] ^ bits[None, j:j + (1 << 14)]) <= threshold
            a, b = np.nonzero(near)
            a, b = rows[a], b + j
            # Links inside a tree that is already whole are passed over in bulk.
            while True:
                open_ = parent[a] != parent[b]
                a, b = a[open_], b[open_]
                if not len(a):
                    break
                x, y = root(int(a[0])), root(int(b[0]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    yield int(all_fps[a[0]]), int(all_fps[b[0]])
                while not np.array_equal(up := parent[parent], parent):
                    parent[:] = up


def _compared(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by place; a place may run over several batches."""
        def links() -> Iterator[tuple[int, int]]:
            key, homes, others = None, [], []
            for batch in source:
                part, anchor, piece, own, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                cut = np.flatnonzero((part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
                    if a == b:
                        continue
                    now = (int(part[a]), int(anchor[a]), int(piece[a]))
                    if now != key and key is not None:
                        yield from _place(homes, others, threshold)
                        homes, others = [], []
                    key = now
                    here, mine = fps[a:b], own[a:b].astype(bool)
                    homes.append(here[mine])
                    others.append(here[~mine])
            if key is not None:
                yield from _place(homes, others, threshold)

        yield from batches(links(), schema, 8192)

    return make


def _place(homes: list, others: list, threshold: int) -> Iterator[tuple[int, int]]:
    mine = np.concatenate(homes)
    if len(mine):
        yield from _forest(mine, np.concatenate(others), threshold)


def links(fps: DataFrame, *, threshold: int = THRESHOLD, slice_size: int = SLICE) -> DataFrame:
    """Spanning links (a, b) between the different fingerprints in column ``fp``.

    The sizes of the anchors' homes are a table of at most three times 4096 rows: a size
    that does not depend on the data, so it may be broadcast.
    """
    if threshold > 4:
        raise ValueError("three parts find up to four differing bits")
    places = written(fps.select("fp").mapInArrow(_places, "part int, anchor int, home boolean, fp bigint"))
    sizes = places.where("home").groupBy("part", "anchor").agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("slices"))
    dealt = places.join(F.broadcast(sizes), ["part", "anchor"])
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    dealt = dealt.select("part", "anchor", F.explode(F.when(F.col("home"), own).otherwise(every)).alias("slice"), "home", "fp")
    # A home must meet the homes of the other slices too: it also goes there as a replica.
    crossed = places.where("home").join(F.broadcast(sizes.where("slices > 1")), ["part", "anchor"])
    crossed = crossed.select(
        "part", "anchor", F.explode(F.filter(every, lambda s: s > F.pmod(F.xxhash64("fp"), F.col("slices")))).alias("slice"),
        F.lit(False).alias("home"), "fp")
    dealt = dealt.unionByName(crossed).repartition("part", "anchor", "slice").sortWithinPartitions("part", "anchor", "slice")
    found = dealt.mapInArrow(_compared(threshold), "a bigint, b bigint")
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for the nodes of ``edges`` (a, b).

    Each round points every node at the smallest node it sees, then rewrites the edges
    between those: stars merge, so rounds follow the logarithm of the longest path.
    Every round is written to the shared folder.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    tree = written(edges.select("a", "b").where("a <> b").distinct())
    while True:
        # Large star: neighbours above a node point at the smallest node around it.
        seen = both(tree)
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = seen.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point at the smallest of them.
        down = large.where("a < b").groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        after = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            small.select(F.col("m").alias("a"), F.col("b"))).where("a <> b").distinct()
        after = written(after)
        same = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if same == tree.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first():
            break
        tree = after
    return tree.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id (smallest id of its component) and first_hash (text hash of that row) of every row of ``docs``."""
    marks = written(fingerprints(docs, id_col=id_col, text_col=text_col))
    # One row per fingerprint; equal ones are reduced before the shuffle.
    rank = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_hash")
    names = written(marks.groupBy("fp").agg(F.min(rank).alias("least")))
    roots = written(components(links(names, threshold=threshold)))
    named = names.join(roots, names["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("first"))
    of_fp = named.join(lowest, "root").select("fp", "first")
    return marks.join(of_fp, "fp").select(
        "doc_id", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))


def one_of_each_group(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that come first in their group (smallest id, then text hash), with all their columns.

    Of rows that repeat id and text, one stays.
    """
    keep = near_groups(docs, threshold=threshold).select("component_id", "first_hash").distinct()
    keep = keep.select(_known("component_id").alias("known"), F.col("first_hash").alias("hash"))
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(packed.alias("doc"), _known("doc_id").alias("known"), F.xxhash64(text_of(docs)).alias("hash"))
    kept = rows.join(keep, ["known", "hash"], "left_semi")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("known", "hash").orderBy("known"))).where("nth = 1")
    return kept.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _known(name: str):
    """The id as text, so that a missing one can be joined by."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7}
ORACLE: dict[str, str] = {}
