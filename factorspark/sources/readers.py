"""File sources: bars, ranked lists, option days, transactions, portfolios, universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.operators.cleaning import fill_bars
from factorspark.operators.selection import normalise_columns
from factorspark.sources import schemas


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars with the adjusted close preferred, no null closes and gaps filled from the close."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.schema(schemas.BARS).format(fmt).load(path)
    return fill_bars(raw)


def read_ranked(spark: SparkSession, path: str, regime: str, start: str, end: str) -> DataFrame:
    """Dated ranked lists ``..._<regime>_<MMDD or YYYYMMDD>.csv`` in an inclusive range.

    The date comes from the file name, the rank from the score, and ``seq`` numbers the snapshots.
    """
    raw = (spark.read.option("header", True).schema(schemas.RANKED)
           .csv(f"{path.rstrip('/')}/*{regime}_*.csv")
           .withColumn("_day", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{8})", 1)))
    st = normalise_columns(raw).withColumn("snapshot_date", F.try_to_date("_day", "yyyyMMdd")).where(
        F.col("snapshot_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("_day")
    days = st.select("snapshot_date").distinct().withColumn(
        "seq", F.row_number().over(Window.orderBy("snapshot_date")) - 1)   # one row per snapshot
    return st.withColumn("regime", F.lit(regime)).join(days, "snapshot_date")


def read_option_day(spark: SparkSession, path: str) -> DataFrame:
    """Option day aggregates (gzip CSV): contract, date from the file name, volume, close."""
    raw = spark.read.option("header", True).schema(schemas.OPTION_DAY).csv(path)
    day = F.try_to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return raw.select(F.col("ticker").alias("contract"), day.alias("d"), "volume", "close", F.lit(None).cast("long").alias("oi"))


def read_transactions(spark: SparkSession, path: str, portfolio: str = "main", default_date: str | None = None) -> DataFrame:
    """Trades from JSON (a list, or an object with ``transactions``) or CSV.

    Rows whose price or shares are not numbers are skipped; a missing commission is 0 and a
    missing date becomes ``default_date``. ``tx_seq`` keeps the file order.
    """
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).schema(schemas.TX_JSON).csv(path).withColumn(
            "tx_seq", F.monotonically_increasing_id())
    else:
        doc = spark.read.option("multiLine", True).json(path)
        if "transactions" in doc.columns:
            doc = doc.select(F.posexplode("transactions").alias("tx_seq", "t")).select("tx_seq", "t.*")
        else:
            doc = doc.withColumn("tx_seq", F.monotonically_increasing_id())
        have = set(doc.columns)
        raw = doc.select("tx_seq", *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
                                     for c in ("ticker", "type", "price", "shares", "date", "commission")])
    day = F.coalesce(F.try_to_date(F.col("date"), "yyyy-MM-dd"),
                     F.lit(default_date).cast("date") if default_date else F.current_date())
    st = raw.select(
        F.lit(portfolio).alias("portfolio"), F.upper(F.trim("ticker")).alias("symbol"),
        F.initcap(F.coalesce(F.trim("type"), F.lit("Buy"))).alias("type"),
        F.col("price").try_cast("double").alias("price"), F.col("shares").try_cast("double").alias("shares"), day.alias("d"),
        F.coalesce(F.col("commission").try_cast("double"), F.lit(0.0)).alias("commission"), F.col("tx_seq").cast("long").alias("tx_seq"))
    return st.where("price is not null and shares is not null and symbol is not null")


def read_portfolio(spark: SparkSession, path: str) -> DataFrame:
    """Members of the newest portfolio file (templates excluded): ``(portfolio, symbol, shares)``."""
    raw = spark.read.option("multiLine", True).schema(schemas.PORTFOLIO_JSON).json(path).withColumn(
        "file", F.col("_metadata.file_name")).where(~F.col("file").contains("template"))
    newest = raw.agg(F.max_by(F.struct("file", "tickers", "shares"), "file").alias("p")).select("p.*")
    st = newest.select(F.col("file").alias("portfolio"), F.explode("tickers").alias("_t"), F.col("shares").alias("_s"))
    return st.select("portfolio", F.upper(F.trim("_t")).alias("symbol"), F.try_element_at("_s", F.col("_t")).alias("shares")).distinct()


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and ``#`` comments dropped, upper case, no duplicates."""
    line = F.upper(F.trim("value"))
    return spark.read.text(path).select(line.alias("symbol")).where(
        (F.col("symbol") != "") & ~F.col("symbol").startswith("#")).dropDuplicates()
