"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside a group.

Defined results.  A missing text equals the empty text.  Of equal texts the row with
the largest id stays (a missing id is smaller than any other); of rows that repeat id
and text, one stays.  An empty table gives an empty table.  Other columns play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import text_of
from railbird.session import written


def _content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    content_hash: Callable[[Column], Column] = _content_hash, digest: Callable[[Column], Column] = _digest,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts meet under (content hash, text): the hash spreads them, the text itself is part
    of the key, so colliding hashes never merge.  Equal texts are reduced before the
    shuffle, so a group of copies costs one text for each map task.  Rows then find
    their group by hash and digest alone, which are narrow; groups that share both with
    a different text (none in practice) are found by text instead.
    """
    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    rows = rows.select("doc_id", "__text", content_hash(F.col("__text")).alias("__hash"))
    narrow = rows.select("doc_id", "__hash", digest(F.col("__text")).alias("__digest"))
    narrow = narrow.groupBy("doc_id", "__hash", "__digest").agg(F.count(F.lit(1)).alias("__same"))

    classes = rows.groupBy("__hash", "__text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = written(classes.select("__hash", digest(F.col("__text")).alias("__digest"), "keep_id", "group_size"))

    twins = classes.groupBy("__hash", "__digest").count().where("count > 1").select("__hash", "__digest")
    if twins.isEmpty():
        found = narrow.join(classes, ["__hash", "__digest"])
    else:
        found = _among_twins(rows.withColumn("__digest", digest(F.col("__text"))), narrow, classes, twins)

    # Rows that repeat id and text were counted; they come apart again here, and the first one stays.
    top = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    found = found.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__same").cast("int"))))
    return found.select(
        "doc_id", "keep_id", "group_size", (top & (F.col("__nth") == 1)).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def _among_twins(rows: DataFrame, narrow: DataFrame, classes: DataFrame, twins: DataFrame) -> DataFrame:
    """The rows with their groups where different texts share hash and digest."""
    keys = ["__hash", "__digest"]
    clear = narrow.join(twins, keys, "left_anti").join(classes, keys)
    mixed = rows.join(twins, keys, "left_semi")
    same = mixed.groupBy("doc_id", *keys, "__text").agg(F.count(F.lit(1)).alias("__same"))
    own = mixed.groupBy(*keys, "__text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    mixed = same.join(own, [*keys, "__text"]).drop("__text")
    return clear.unionByName(mixed)


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each different text.

    Of rows that repeat id and text but differ elsewhere, one stays, whichever.
    """
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = text_of(docs, text_col)
    rows = docs.select(packed.alias("__row"), F.col(id_col).alias("__id"), text.alias("__text"))
    rows = rows.select("*", _content_hash(F.col("__text")).alias("__hash"))
    kept = rows.groupBy("__hash", "__text").agg(
        F.max_by("__row", F.struct(F.col("__id").isNotNull(), F.col("__id"))).alias("__best"))
    return kept.select(*[F.col(f"__best.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its group of equal texts."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_exact_dedup": op10}
ORACLE = {
    "op10_exact_dedup": """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, sha256(text) as text_sha256
from t window w as (partition by text)""",
}
