"""JSON files written beside captured images, one object per file."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railbird.session import new_folder, small_files

REVIEW = """event_id string, player_name string, position string, action_type string, amount double,
  confidence_score double, raw_data string"""
SHOWN_CARD = """hand_id string, seat int, side string, avatar_hamming int, captured_at string,
  cnn_prediction struct<rank:string,suit:string,rank_conf:double,suit_conf:double>"""
LABEL = "expected struct<rank:string,suit:string>, source string, notes string"
#: Files of one folder at most, where they are written here.
FOLDER = 1024
#: Files that are listed, and so held by the driver, at once; a folder without folders in it is not divided.
LISTED = 1 << 15


def _from_gbk(content: Column) -> Column:
    """SQL's decode knows no Chinese code page."""
    @F.pandas_udf(T.StringType())
    def udf(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    return udf(content)


def write_sidecars(texts: DataFrame, folder: str) -> None:
    """A file for every row of ``texts``, a single text column, in folders of at most ``FOLDER`` files.

    No two tasks share a folder, so the driver moves whole folders to their place.
    """
    parts = texts.withColumn("folder", F.expr(f"monotonically_increasing_id() div {FOLDER}"))
    parts.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(folder)


def _skipped(name: str) -> bool:
    """Whether Spark passes over files and folders of this name."""
    hidden = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return hidden and not name.startswith(("_metadata", "_common_metadata"))


def _parts(fs: JavaObject, found: JavaObject) -> Iterator[tuple[str, int]]:
    """What was found, with its number of files; of a folder with too many, what is in it."""
    held = fs.getContentSummary(found.getPath()) if found.isDirectory() else None
    if held is None or held.getFileCount() <= LISTED or held.getDirectoryCount() == 1:
        # Characters of patterns stand for themselves.
        yield re.sub(r"([\\{}\[\]*?])", r"\\\1", found.getPath().toString()), held.getFileCount() if held else 1
        return
    for child in fs.listStatus(found.getPath()):
        if not _skipped(child.getPath().getName()):
            yield from _parts(fs, child)


def _groups(spark: SparkSession, folder: str) -> Iterator[list[str]]:
    """The paths to list together: ``LISTED`` files at most, or else a single path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    group, count = [], 0
    for found in fs.globStatus(root) or []:
        for path, files in _parts(fs, found):
            if group and count + files > LISTED:
                yield group
                group, count = [], 0
            group.append(path)
            count += files
    yield group or [folder]


def read_sidecars(spark: SparkSession, folder: str, schema: str, *, pattern: str = "*.json") -> DataFrame:
    """Parsed sidecars with their path.

    Files are UTF-8; older ones are in the Chinese Windows code page and are
    decoded as such when they are not valid UTF-8.

    The files are read once, many in a task, and the rows written to the checkpoint folder, one group of files after the
    other: Spark lists what it reads on the driver.
    """
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, _from_gbk(F.when(utf8.isNull(), F.col("content"))))
    table = new_folder(spark, "table")
    with small_files(spark):
        for paths in _groups(spark, folder):
            files = (
                spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
                .load(paths).select("path", "content"))
            parsed = files.select("path", text.alias("text")).select("path", F.from_json("text", schema).alias("j")).select("path", "j.*")
            parsed.write.mode("append").parquet(table)
            rows = parsed.schema
            # Python lets go of a plan, and so of its list of files, when it collects its garbage.
            del files, parsed
            gc.collect()
    return spark.read.schema(rows).parquet(table)
