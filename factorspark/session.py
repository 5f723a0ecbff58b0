"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factorspark", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is written for.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave
    both unset so that the submit configuration and AQE decide.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only when the session names none (unit tests, local runs) a temporary folder
    is set; a cluster is expected to name a shared one.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="factorspark-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHARED: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one job read, spilling to disk when large.

    The lineage stays, so lost blocks are recomputed. ``release_shared`` frees them.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(kept)
    return kept


def shared_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Like ``shared``, stored partitioned by ``keys`` and sorted by ``keys`` and ``order``.

    Every window, aggregate and join on ``keys`` that reads it then needs neither a shuffle nor
    a sort: the one exchange is paid once for all branches.
    """
    return settled(df.repartition(*keys).sortWithinPartitions(*keys, *order))


def settled(df: DataFrame) -> DataFrame:
    """Like ``shared``, filled at once: plans on top then know its partitioning, order and size, and neither shuffle nor sort again."""
    kept = shared(df)
    kept.count()
    return kept


#: Spark removes the shuffle files of a query when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[DataFrame] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back; what the job shuffled goes as soon as it is written.

    Unlike ``settled`` nothing but the table itself stays on disk. ``discard`` and ``release_shared`` remove it, or the end of the driver's JVM.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("error").option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    path, files = _folder(spark, folder)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(folder)
    table.written_in = folder
    _WRITTEN.append(table)
    return table


def _folder(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned and that no later job reads."""
    for df in tables:
        _WRITTEN[:] = [x for x in _WRITTEN if x is not df]
        path, files = _folder(df.sparkSession, df.written_in)
        files.delete(path, True)


def release_shared() -> None:
    while _SHARED:
        _SHARED.pop().unpersist()
    discard(*_WRITTEN)
