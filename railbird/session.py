"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
FINE_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SIZE_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Parts a shuffle is dealt to before Spark joins small ones, and the size up to which it does.
FINE_PARTS, FINE_SIZE = 1024, "16m"
OPEN_CONF = "spark.sql.files.openCostInBytes"
#: The bytes a small file counts for when Spark shares files out to tasks.
OPEN_COST = "64k"
#: The bytes of file lists that the driver keeps for later after a read.
KEPT_CONF = "spark.sql.hive.filesourcePartitionFileCacheSize"


def local_session(cores: int | str = "*", app: str = "railbird", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def fine_shuffles(spark: SparkSession) -> None:
    """Lets Spark deal shuffles finely and join small parts, unless the cluster says how many parts there are.

    A task that sorts a part for joins and windows holds several copies of it.  With a fixed number of parts they grow with
    the input; dealt finely, parts are joined up to a size instead.
    """
    if spark.conf.get(FINE_CONF, None) is None:
        spark.conf.set(FINE_CONF, str(max(FINE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        if spark.sparkContext.getConf().get(SIZE_CONF) is None:
            spark.conf.set(SIZE_CONF, FINE_SIZE)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Reads that run inside take up to 2048 small files a task, not 32, unless the cluster sets what opening a file costs.

    The driver forgets their lists of files with the reads.
    """
    old = {key: spark.conf.get(key) for key in (OPEN_CONF, KEPT_CONF)}
    if spark.sparkContext.getConf().get(OPEN_CONF) is None:
        spark.conf.set(OPEN_CONF, OPEN_COST)
    spark.conf.set(KEPT_CONF, "0")
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder: on a cluster an executor could
    not read what another one wrote there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="railbird-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of one run below the checkpoint folder, for all that ``written`` makes inside; it is removed at the end.

    What is built inside has to be used or saved inside.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the run's folder, or else in the shared checkpoint folder."""
    return f"{_RUN.get() or ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the run's folder, or else in the shared checkpoint folder.

    Cuts the lineage like a reliable checkpoint, but computes the plan once: a
    checkpoint runs its last stage a second time to write it.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
