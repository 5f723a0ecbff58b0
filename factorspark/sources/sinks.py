"""Partitioned, repeatable writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def existing_keys(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Distinct partition keys already written at ``path`` (None when nothing is there); other errors are not taken for that."""
    try:
        return df.sparkSession.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_ranked(df: DataFrame, path: str, keys: Sequence[str] = ("regime", "snapshot_date"), overwrite: bool = False) -> None:
    """Write one partition per key; existing partitions are skipped, or replaced on request."""
    todo = df
    if not overwrite:
        done = existing_keys(df, path, keys)
        if done is not None:
            todo = df.join(done, list(keys), "left_anti")
    mode = "overwrite" if overwrite else "append"
    (todo.repartition(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A sectioned report table as CSV (with header) or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
