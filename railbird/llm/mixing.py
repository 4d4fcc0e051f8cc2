"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, shuffled by a seeded hash, form one stream of words that
repeats when the source is wanted more than once; the stream is cut into blocks of
equally many words.  A schedule of slots follows the golden-ratio sequence: the point of
a slot, looked up among the cumulative target weights, names the slot's source, and the
n-th slot of a source takes the n-th block of its stream.  The mix is the join of slots
and blocks.

Defined results.  A missing text has no words.  Documents without words are in no block
and take nothing.  Rows that repeat an id count each for themselves.  Missing sources are
one source, the last.  The sources table (one row per source) is the only thing ordered
in one task.  Everything follows from ids, sizes and the seed, so runs agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.functions.ordered import block_split, numbered, running
from railbird.llm.common import WORD, text_of
from railbird.session import written

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 512
#: Rows of a source that are summed up in one task.
SPLIT_ROWS = 4_096


def word_sizes(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """doc_id, source, size of every document."""
    return docs.select("doc_id", "source", F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: its rank, size, weight and target.

    ``weights`` repeat along the sources by code point, missing last.  The targets share the
    total size by weight; none passes ``most`` times its source's size, and what is cut off
    is shared by weight among the others.  Sources reach their limit in the order of limit
    over weight, and the level at which the others stay is the highest of the levels met
    on the way.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("src", F.row_number().over(by_name))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(listed, ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", (F.col("source_size") * most).cast("double")).withColumn("__at", F.col("limit") / F.col("weight"))
    before = Window.orderBy("__at", "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    none = F.lit(0.0)
    s = s.withColumn(
        "__level",
        (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("limit").over(before), none))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)))
    level = F.max("__level").over(whole)
    s = s.withColumn("target", F.least(F.col("limit"), F.col("weight") * level))
    return s.select("src", "source", "source_size", "n_docs", "weight", "target")


def _planned(sources: DataFrame, block_words: int) -> DataFrame:
    """How often each source's stream runs whole, what is left, and the slots this needs."""
    n = F.when(F.col("source_size") > 0, F.ceil(F.col("source_size") / block_words)).otherwise(0).cast("long")
    s = sources.withColumn("wanted", F.round("target").cast("long")).withColumn("n_blocks", n)
    s = s.withColumn("runs", F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("left", F.col("wanted") - F.col("runs") * F.col("source_size"))
    return s.withColumn("n_slots", (F.col("runs") * F.col("n_blocks") + F.ceil(F.col("left") / block_words)).cast("long"))


def schedule(sources: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix in order: slot, src, run, block, upto (words of the source's stream that count in that run).

    A source whose points came too often leaves those slots out; one whose points came too
    seldom gets its last slots behind the others.  By the sequence's discrepancy these are
    a few slots per source, growing with the logarithm of all slots.
    """
    spark = sources.sparkSession
    plan = _planned(sources, block_words)
    n = plan.agg(F.sum("n_slots")).first()[0] or 0
    by_src = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n_slots").over(Window.partitionBy())
    edges = plan.where("n_slots > 0").select(
        F.lit(-1).cast("long").alias("slot"), F.coalesce(F.sum("n_slots").over(by_src) / total, F.lit(0.0)).alias("x"), F.col("src").alias("own"))
    i = F.col("id").cast("double") * GOLDEN
    points = spark.range(n).select(F.col("id").alias("slot"), (i - F.floor(i)).alias("x"), F.lit(None).cast("int").alias("own"))
    pieces = max(1, n // SPLIT_ROWS)
    looked_up = running(
        edges.unionByName(points), [], ["x", "slot"], {"src": ("last", F.col("own"))}, split=F.floor(F.col("x") * pieces).cast("long"))
    met = looked_up.where("slot >= 0").select("slot", "src")
    met = numbered(met, ["src"], ["slot"], "rank", split=block_split("slot", SPLIT_ROWS))

    counts = met.groupBy("src").agg(F.count(F.lit(1)).alias("met"))
    late = plan.join(counts, "src", "left").withColumn("met", F.coalesce("met", F.lit(0))).where("n_slots > met")
    late = late.withColumn("__before", F.coalesce(F.sum(F.col("n_slots") - F.col("met")).over(by_src), F.lit(0)))
    late = late.select("src", "met", "__before", F.explode(F.sequence(F.col("met") + 1, F.col("n_slots"))).alias("rank"))
    late = late.select((F.lit(n) + F.col("__before") + F.col("rank") - F.col("met") - 1).alias("slot"), "src", "rank")

    slots = met.select("slot", "src", "rank").unionByName(late).join(plan, "src").where("rank <= n_slots")
    r = F.col("rank") - 1
    slots = slots.select("slot", "src", F.floor(r / F.col("n_blocks")).alias("run"), (r % F.col("n_blocks")).alias("block"), "runs", "left", "source_size")
    upto = F.when(F.col("run") < F.col("runs"), F.col("source_size")).otherwise(F.col("left"))
    return slots.select("slot", "src", "run", "block", upto.alias("upto"))


def blocks(sizes: DataFrame, sources: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The documents in shuffled order with their words' place in their source's stream, cut at block borders.

    One row per document and block: src, block, doc_id, size, source_size, target,
    start (of the document), begin and end (of this piece).
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sizes.where("size > 0").join(
        sources.select(F.col("source").alias("__name"), "src", "source_size", "n_docs", "target"),
        F.col("source").eqNullSafe(F.col("__name"))).drop("__name", "source")
    rows = rows.withColumn("shuffled", key)
    share = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("double") / 4294967296.0
    split = F.floor(share * F.ceil(F.col("n_docs") / SPLIT_ROWS)).cast("long")
    rows = running(rows, ["src"], ["shuffled", "doc_id", "size"], {"end": ("sum", F.col("size"))}, split=split)
    start = F.col("end") - F.col("size")
    rows = rows.withColumn("start", start).drop("shuffled", "n_docs")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    return rows.select(
        "src", "block", "doc_id", "size", "source_size", "target", "start",
        F.greatest(F.col("start"), F.col("block") * block_words).alias("begin"),
        F.least(F.col("end"), (F.col("block") + 1) * block_words).alias("end"))


def mix(sizes: DataFrame, sources: DataFrame, *, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix: slot, src, run, block, doc_id, first word (within the document) and words taken."""
    slots, parts = schedule(sources, block_words=block_words), blocks(sizes, sources, block_words=block_words, seed=seed)
    joined = slots.join(parts, ["src", "block"]).withColumn("words", F.least("end", "upto") - F.col("begin"))
    return joined.where("words > 0").select(
        "slot", "src", "run", "block", "doc_id", "start", (F.col("begin") - F.col("start")).alias("first"), "words")


def taken_words(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: int = 3,
                block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with its size, its source's size and target, and the words the mix takes of it."""
    sizes = written(word_sizes(docs))
    sources = written(source_targets(sizes, weights, most))
    used = mix(sizes, sources, block_words=block_words, seed=seed)
    used = used.groupBy("src", "start", "run").agg(F.sum("words").alias("words")).groupBy("src", "start").agg(F.sum("words").alias("taken"))
    whole = blocks(sizes, sources, block_words=block_words, seed=seed).where(F.col("begin") == F.col("start"))
    out = whole.join(used, ["src", "start"], "left")
    out = out.join(sources.select("src", "source"), "src").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    empty = sizes.where("size = 0").join(
        sources.select(F.col("source").alias("__name"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__name")))
    return out.unionByName(empty.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, to the nearest whole number; rows without words stay once.

    A source so has up to half a document more or less than its target, and one document taken for less than half is dropped.
    """
    took = taken_words(docs, **options).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"))
    copies: Column = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    took = took.select(*(F.col(c).alias(f"of_{c}") for c in ("doc_id", "source", "size")), copies.alias("n"))
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    rows = docs.select(packed.alias("doc"), "doc_id", "source", size.alias("size"))
    met = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    rows = rows.join(took, met).where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size and the words a 5, 2, 1 mix takes of it."""
    out = taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_source_mixing": op2}
ORACLE = {
    "op2_source_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::double as n, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, case k % 3 when 1 then 5.0 when 2 then 2.0 else 1.0 end as w, 3 * n as lim from s),
l as (select *, (sum(n) over () - coalesce(sum(lim) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from w window b as (order by lim / w, k rows between unbounded preceding and 1 preceding)),
t as (select *, least(lim, w * max(level) over ()) as target from l),
c as (select d.*, t.n, t.target, round(t.target) as wanted,
  sum(size) over (partition by d.source order by md5('0:' || doc_id), doc_id, size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, n::bigint as source_size, target,
  sum(case when size = 0 then 0 else greatest(0, least(upto, wanted - run * n) - greatest(upto - size, 0)) end)::bigint as taken
from c, (select unnest(range(0, 4)) as run) group by doc_id, size, n, target""",
}
