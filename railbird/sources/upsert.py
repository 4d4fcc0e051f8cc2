"""Tables that are kept up to date: incremental, replay-safe upserts into hash buckets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructField, StructType

from railbird.session import written

Reduce = Callable[[DataFrame], DataFrame]
BUCKET = "bucket"
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))


def read_upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of an upserted table (none before the first upsert)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(path).drop(BUCKET)


def upsert(rows: DataFrame, path: str, keys: Sequence[str], reduce: Reduce, *, buckets: int = BUCKETS) -> None:
    """Merges ``rows`` into the table at ``path``.

    ``reduce`` maps rows to the rows to keep, key by key, with the same columns; it must give the same again on what it has kept
    and on repeats, so a batch that is replayed changes nothing.  Only the buckets of the rows' keys are read
    and rewritten, each as a whole folder: readers see a bucket's old rows or its new ones.
    """
    spark, schema = rows.sparkSession, rows.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = written(rows.withColumn(BUCKET, bucket))
    # At most ``buckets`` numbers.
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
    if not touched:
        return
    if _exists(spark, path):
        held = spark.read.schema(new.schema).parquet(path).where(F.col(BUCKET).isin(touched))
        new = held.unionByName(new)
    kept = reduce(new.drop(BUCKET)).select(*schema.names).withColumn(BUCKET, bucket)
    # Read to the end before any of its own input is replaced.
    kept = written(kept.repartition(F.col(BUCKET)))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upserts(stream: DataFrame, path: str, keys: Sequence[str], reduce: Reduce, checkpoint: str, *, buckets: int = BUCKETS) -> DataStreamWriter:
    """Upserts every batch of a stream."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, keys, reduce, buckets=buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def first_and_last_version(versions: DataFrame) -> DataFrame:
    """The versions of every hand that ``current_hands`` needs: its first and its last one."""
    of = Window.partitionBy("id")
    ends = versions.withColumns({"_first": F.min("version").over(of), "_last": F.max("version").over(of)})
    ends = ends.where((F.col("version") == F.col("_first")) | (F.col("version") == F.col("_last"))).drop("_first", "_last")
    return ends.dropDuplicates(["id", "version"])
