"""Exact duplicates by a content sort: sampled splitters, an external sort, full comparisons of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import range_bucket, range_key, stored


def _runs(rows: DataFrame) -> DataFrame:
    """Number the runs of equal texts inside each range bucket of rows (b, t, id, ...).

    Rows are sorted by the keys of the buckets and the whole text, so that equal texts are neighbours; a row opens a
    run if its text differs from the one before.
    """
    rows = rows.withColumn("head", F.substring(F.col("t").cast("binary"), 1, 64)).withColumn("h", F.xxhash64("t"))
    order = Window.partitionBy("b").orderBy("head", "h", "t", "id")
    before = F.lag("t").over(order)
    rows = rows.withColumn("opens", before.isNull() | (before != F.col("t")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.sum(F.col("opens").cast("long")).over(upto), "pos": F.row_number().over(order)})
    run = Window.partitionBy("b", "run")
    return rows.withColumns({
        "last_run": F.max("run").over(Window.partitionBy("b")), "top": F.max("id").over(run),
        "n": F.count(F.lit(1)).over(run), "closes": F.col("pos") == F.max("pos").over(run)})


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (t, id, ...) with the number b of their bucket, by (first bytes, hash, id).

    The id among the keys spreads a text that very many rows share over several buckets.
    """
    return rows.withColumn("b", range_bucket(rows, range_key(F.col("t"), F.col("id"))))


def _joined(runs: DataFrame) -> DataFrame:
    """For runs at a border of a bucket, which may go on in the next: totals of the whole group, by (b, run)."""
    heads = runs.where(F.col("opens") & ((F.col("run") == 1) | (F.col("run") == F.col("last_run")))).select("b", "run", "t", "top", "n")
    whole = heads.groupBy("t").agg(F.max("top").alias("all_top"), F.sum("n").alias("all_n"), F.max("b").alias("last_b"))
    return heads.select("b", "run", "t").join(whole, "t").select("b", "run", "all_top", "all_n", "last_b")


def _decided(rows: DataFrame, ends: DataFrame) -> DataFrame:
    kept = F.col("closes") & (F.col("last_b").isNull() | (F.col("last_b") == F.col("b")))
    return rows.join(ends, ["b", "run"], "left").withColumns({
        "keep_id": F.coalesce("all_top", "top"), "group_size": F.coalesce("all_n", "n"), "kept": kept})


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms (default: unchanged) are; null counts as empty. The row with the
    largest id of a group stays (a null id is smaller than any other); of repeated rows with that id, one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), (normalise(t) if normalise else t).alias("t"))
    runs = _runs(_dealt(rows)).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    border = F.col("opens") & ((F.col("run") == 1) | (F.col("run") == F.col("last_run")))
    runs = stored(runs.select("b", "run", "last_run", "id", "top", "n", "opens", "closes", "sha", F.when(border, F.col("t")).alias("t")), "exact")
    out = _decided(runs, _joined(runs))
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names are."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), (normalise(t) if normalise else t).alias("t"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns if c != text or normalise],
        *([] if normalise else [F.col(text).isNull().alias("text is null")])).alias("rest"))
    runs = _runs(_dealt(rows))
    border = F.col("opens") & ((F.col("run") == 1) | (F.col("run") == F.col("last_run")))
    # texts are moved and sorted once: the last row of each run may stay, and the first of a run at a border tells what goes on there
    runs = stored(runs.where(F.col("closes") | border).select("b", "run", "last_run", "id", "top", "n", "opens", "closes", "t", "rest"), "exact")
    kept = _decided(runs, _joined(runs)).where("kept")
    own = F.when(~F.col("rest")["text is null"], F.col("t")) if not normalise else F.col("rest")[text]
    return kept.select(*[own.alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
