"""The line table rolled up once to cells of mergeable sums, and the domain tables that follow from them.

A cell is one (symbol, day). Everything the factor scores need of the lines is a sum, a count, a maximum or a minimum, so bars, the
market, yearly fundamentals, quarterly estimates, surprises and dividends are further roll-ups of the cells.

Suppliers that trade on few days have nearly a cell for each line, and a cell is wider than its lines. Suppliers are therefore taken in
slices of SLICE_LINES lines: each slice reads the lines again, and what lies on disk at any time is that of one slice, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.session import written
from factorspark.sources import adapters as ad

#: Lines of a slice, and of one of its tasks: so few are added up and sorted in memory.
SLICE_LINES, TASK_LINES = 16_000_000, 100_000
#: A slice of which few columns or few lines are moved is so many times as long.
NARROW = 4


def supplier_slices(spark: SparkSession, sf_dir: str, lines: int | None = None, key: str = "l_suppkey") -> tuple[list[Column], int]:
    """Conditions on ``key`` that part the suppliers into slices of ``lines`` lines each, about, and the number of tasks for a slice.

    Every supplier is in one slice.
    """
    rows = ad.table(spark, sf_dir, "lineitem").count()
    n = max(1, -(-rows // (lines or SLICE_LINES)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // n // TASK_LINES))
    return [F.pmod(F.xxhash64(key), F.lit(n)) == k for k in range(n)], tasks


def supplier_cells(spark: SparkSession, sf_dir: str, among: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Cells of the suppliers, or of those of one slice, written: each file holds whole quarters of a supplier, so roll-ups combine them at once.

    Lines are exchanged once, by supplier and quarter, as they are: that is less than cells are, and a supplier with many lines is dealt over its quarters.
    """
    li = ad.table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", F.to_date("l_shipdate").alias("d"))
    if among is not None:
        li = li.where(among)
    ext, disc, tax, qty = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    dealt = li.withColumn("_quarter", F.trunc("d", "quarter")).repartition(*([tasks] if tasks else []), "l_suppkey", "_quarter")
    cells = dealt.groupBy("l_suppkey", "_quarter", "d").agg(
        F.max(ext / qty).alias("high"), F.min(ext / qty).alias("low"), F.sum(ext).alias("ext"), F.sum(qty).alias("qty"),
        F.sum(ext * (1 - disc)).alias("net"), F.sum(ext * tax).alias("ext_tax"), F.sum(ext * disc * (1 - tax)).alias("ext_disc"),
        F.sum(ext * (1 - disc) * tax).alias("net_tax"), F.sum(disc).alias("disc"), F.count(disc).alias("n_disc"),
        F.sum(tax).alias("tax"), F.count(tax).alias("n_tax"), F.count(qty).alias("n_qty"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "A", tax * ext / qty)).alias("paid"))
    return written(cells.drop("_quarter").withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))), "cells")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as a cell of its own, with what bars take: for roll-ups to so few rows that no exchange of cells is worth its while."""
    ext, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return ad.table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("d"), (ext / qty).alias("high"), (ext / qty).alias("low"), ext.alias("ext"), qty.alias("qty"))


def bars(cells: DataFrame) -> DataFrame:
    return cells.select("symbol", "d", "high", "low", (F.col("ext") / F.col("qty")).alias("close"), F.col("qty").alias("volume"))


def market_bars(cells: DataFrame) -> DataFrame:
    """All cells of a day as one bar: one row for each calendar day."""
    return cells.groupBy("d").agg(F.max("high").alias("high"), F.min("low").alias("low"), (F.sum("ext") / F.sum("qty")).alias("close"),
                                  F.sum("qty").alias("volume")).withColumn("symbol", F.lit("MKT"))


def region_bars(spark: SparkSession, sf_dir: str, lines: int | None = None) -> DataFrame:
    """Bars of the regions. Where the suppliers are too many to be sent to all tasks, their join moves the lines, one slice at a time."""
    unit = ad.unit_price()
    parts = [written(ad.region_lines(spark, sf_dir).where(among).groupBy("symbol", "d").agg(
        F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_extendedprice").alias("ext"), F.sum("l_quantity").alias("qty")), "regions")
        for among in supplier_slices(spark, sf_dir, NARROW * (lines or SLICE_LINES))[0]]
    return spark.read.schema(parts[0].schema).parquet(*[x.written_in for x in parts]).groupBy("symbol", "d").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), (F.sum("ext") / F.sum("qty")).alias("close"), F.sum("qty").alias("volume"))


def fundamentals(cells: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = {"avg_disc": F.sum("disc") / F.sum("n_disc"), "avg_tax": F.sum("tax") / F.sum("n_tax"), "avg_qty": F.sum("qty") / F.sum("n_qty")}
    agg = cells.groupBy("symbol", "l_suppkey", F.year("d").alias("yr")).agg(
        F.sum("ext").alias("market_cap"), F.sum("net").alias("total_revenue"), F.sum("ext_tax").alias("total_debt"),
        F.sum("ext_disc").alias("free_cashflow"), F.sum("net_tax").alias("ebit"), *[e.alias(n) for n, e in mean.items()],
        F.sum("n").alias("n_lines"), (F.sum("ext") / F.sum("qty")).alias("price"))
    return ad.company_snapshots(agg.drop("symbol"), spark, sf_dir)


def _means(cells: DataFrame, *keys) -> DataFrame:
    return cells.groupBy("symbol", *keys).agg((F.sum("disc") / F.sum("n_disc")).alias("ad"), (F.sum("tax") / F.sum("n_tax")).alias("at"))


def estimates(cells: DataFrame) -> DataFrame:
    return ad.quarterly_estimates(_means(cells, F.year("d").alias("yr"), F.quarter("d").alias("qr")))


def surprises(cells: DataFrame) -> DataFrame:
    found = _means(cells, F.to_date(F.date_trunc("quarter", "d")).alias("d"))
    return found.select("symbol", "d", ((F.col("ad") - F.col("at")) * 1000).alias("surprise_pct"))


def dividends(cells: DataFrame) -> DataFrame:
    return cells.where("paid IS NOT NULL").select("symbol", F.col("d").alias("ex_date"), F.col("paid").alias("amount"))
