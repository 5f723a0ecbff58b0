"""Incremental ingest of option sessions: each new file is merged into the session table once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from factorspark.operators.flow import dedupe_sessions
from factorspark.session import checkpointed
from factorspark.sources import schemas


def session_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Session files as a stream. No row is dropped for its age: the merge makes repeated deliveries harmless."""
    return (spark.readStream.schema(schemas.FLOW).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", True).parquet(path))


def _published(spark: SparkSession, table: str, kind: str) -> DataFrame | None:
    """The rows of each date as its last published version has them; none before the first.

    ``table``/manifest holds one small file for each version with the dates it replaces, ``table``/data the versions themselves. A version is
    there for readers once its file in the manifest is, for all dates and both kinds of rows at once; what a stopped writer left is not.
    """
    try:
        manifest = spark.read.schema("version int, d date").parquet(f"{table}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = manifest.groupBy("d").agg(F.max("version").alias("version"))
    rows = spark.read.schema(StructType([*_fields(), StructField("version", IntegerType()), StructField("kind", StringType())])).parquet(f"{table}/data")
    return rows.where(F.col("kind") == kind).join(newest, ["d", "version"]).select(*[f.name for f in _fields()])


def _fields() -> list[StructField]:
    return StructType.fromDDL(schemas.FLOW).fields


def _next_version(spark: SparkSession, table: str) -> int:
    try:
        return 1 + (spark.read.schema("version int, d date").parquet(f"{table}/manifest").agg(F.max("version")).first()[0] or 0)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 1


def publish(dates: DataFrame, table: str, version: int) -> None:
    """Make a written version the one of its dates: one file, which a file system shows whole or not at all."""
    dates.select(F.lit(version).alias("version"), "d").coalesce(1).write.mode("append").parquet(f"{table}/manifest")


def merge_sessions(batch: DataFrame, table: str, prefer: str = "last") -> None:
    """Write a new version of the session dates the batch touches, keeping the better source of each date, and publish it.

    The rows of kind ``all`` are the latest of every source, losers too, so a source whose rows come in several batches is judged as if
    they had come in one. Where a row of the same symbol, date and source is there already the batch wins. Those of kind ``best``, which
    readers use, are deduplicated from them. Nothing that is published is ever rewritten; a version that was written but not published is
    written anew by the next try. Re-running a batch gives the same tables, and a batch may come with dates of any age. One writer at a time.
    """
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    known = _published(spark, table, "all")
    both = batch.withColumn("_new", F.lit(1))
    if known is not None:
        known = known.join(batch.select("d").distinct(), "d", "left_semi").select(*batch.columns)
        both = both.unionByName(known.withColumn("_new", F.lit(0)))
    key = ["symbol", "d", "source_seq"]
    rest = [c for c in batch.columns if c not in key]
    # of rows that repeat inside one batch the greatest stays, so that a retry decides alike
    latest = both.groupBy(*key).agg(F.max(F.struct("_new", *rest)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    latest = checkpointed(latest.select(*batch.columns))
    version = _next_version(spark, table)
    for rows, kind in ((latest, "all"), (dedupe_sessions(latest, prefer), "best")):
        rows.repartition("d").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("d").parquet(
            f"{table}/data/version={version}/kind={kind}")
    publish(latest.select("d").distinct(), table, version)


def sessions_table(spark: SparkSession, table: str) -> DataFrame:
    """The merged sessions: one source for each symbol and date; no rows before the first batch."""
    rows = _published(spark, table, "best")
    return spark.createDataFrame([], StructType(_fields())) if rows is None else rows


def start_ingest(stream: DataFrame, table: str, checkpoint: str, prefer: str = "last",
                 after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Process everything that has arrived, then stop; progress is kept in ``checkpoint``.

    ``after`` is called with each merged batch (daily alerts, for instance).
    """
    def handle(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            merge_sessions(kept, table, prefer)
            if after:
                after(kept)
        finally:
            kept.unpersist()
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
