"""Filling, completeness, availability, calendars, null profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.session import shared


def calendar_of(df: DataFrame) -> DataFrame:
    """Distinct dates numbered from 1: ``(d, session)``; one row per calendar day at most."""
    return df.select("d").distinct().withColumn("session", F.row_number().over(Window.orderBy("d")))


def fill_forward(df: DataFrame, x: str = "close", limit: int | None = 2, back: bool = False) -> DataFrame:
    """Carry each symbol's value over missing sessions, at most ``limit`` of them.

    Each row is stretched up to the session before the symbol's next row, so only rows that
    exist afterwards are produced; no symbol x date grid is built. ``back`` also fills
    the sessions before the first row.
    """
    cal = shared(calendar_of(df))      # one row for each day, read three times
    w = Window.partitionBy("symbol").orderBy("session")
    last = cal.agg(F.max("session")).scalar()
    st = df.where(F.col(x).isNotNull()).select("symbol", "d", x).join(cal, "d")
    st = st.withColumn("_end", F.coalesce(F.lead("session").over(w) - 1, last))
    if limit is not None:
        st = st.withColumn("_end", F.least("_end", F.col("session") + limit))
    start = F.col("session")
    if back:
        start = F.when(F.lag("session").over(w).isNull(), F.lit(1)).otherwise(F.col("session"))
    st = st.withColumn("_from", start).select("symbol", x, F.col("session").alias("_own"),
                                              F.explode(F.sequence("_from", "_end")).alias("session"))
    return st.join(cal, "session").select("symbol", "d", x, (F.col("session") != F.col("_own")).alias("filled"))


def complete_dates(panel: DataFrame, key: str = "portfolio", x: str = "px") -> DataFrame:
    """Keep the dates on which every symbol of the portfolio has a value."""
    need = panel.groupBy(key).agg(F.count_distinct("symbol").alias("_need"))
    have = panel.where(F.col(x).isNotNull()).groupBy(key, "d").agg(F.count(F.lit(1)).alias("_have"))
    full = have.join(need, key).where(F.col("_have") == F.col("_need")).select(key, "d")
    return panel.join(full, [key, "d"], "left_semi")


def availability(bars: DataFrame, universe: DataFrame, start: Column, lookback: int = 252) -> DataFrame:
    """Whether a symbol has 80 percent of the look-back bars in the window before ``start``."""
    win = bars.where(F.col("d").between(F.date_sub(start, lookback + 30), start))
    n = win.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return universe.select("symbol").join(n, "symbol", "left").select(
        "symbol", F.coalesce("n_bars", F.lit(0)).alias("n_bars"),
        (F.coalesce("n_bars", F.lit(0)) >= 0.8 * lookback).alias("available"))


def min_history(bars: DataFrame, n: int = 200, companies: DataFrame | None = None) -> DataFrame:
    """Bars of symbols that have at least ``n`` of them and, with ``companies(symbol, market_cap)``, a market cap."""
    ok = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    if companies is not None:
        capped = companies.where("market_cap IS NOT NULL AND market_cap <> 0")
        ok = ok.join(capped, "symbol", "left_semi")
    return bars.join(ok.select("symbol"), "symbol", "left_semi")


def trading_days(calendar: DataFrame, start: Column, end: Column, step: int = 1) -> DataFrame:
    """Every ``step``-th calendar day from ``start`` that is a trading day (others are dropped)."""
    offset = F.datediff("d", start)
    return calendar.where(F.col("d").between(start, end) & (offset % step == 0)).select("d")


def last_trading_day(dates: DataFrame, calendar: DataFrame, within: int = 10) -> DataFrame:
    """Last trading day on or before each date, at most ``within`` days back."""
    back = dates.select("d", F.explode(F.sequence(F.lit(0), F.lit(within))).alias("_k"))
    back = back.withColumn("_day", F.date_sub(F.col("d"), F.col("_k")))
    cal = calendar.select(F.col("d").alias("_day")).distinct()
    hit = back.join(cal, "_day").groupBy("d").agg(F.max("_day").alias("trading_day"))
    return dates.join(hit, "d", "left")


def weekday_calendar(spark_df: DataFrame, holidays: Sequence[str] = ()) -> DataFrame:
    """Weekdays between the first and last date of ``spark_df`` without the holidays."""
    span = spark_df.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("d")).where(F.weekday("d") < 5)
    return days.where(~F.date_format("d", "yyyy-MM-dd").isin(*holidays)) if holidays else days


def data_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"),
                  F.count_distinct("d").alias("days"), F.count_distinct("symbol").alias("symbols"))


def null_profile(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Null (or NaN) count of each column and rows with any of them, per key (a file or a date)."""
    kinds = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        return m | F.isnan(c) if kinds[c] in ("double", "float") else m
    any_null = None
    for c in cols:
        any_null = missing(c) if any_null is None else any_null | missing(c)
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_null).alias("rows_affected"),
                              *[F.count_if(missing(c)).alias(c) for c in cols])
    return agg.unpivot([key, "rows", "rows_affected"], list(cols), "column", "nulls")


def fill_bars(raw: DataFrame) -> DataFrame:
    """Clean raw bars: adjusted close first, rows without a close dropped, gaps from close, volume 0."""
    close = F.coalesce("adjclose", "close") if "adjclose" in raw.columns else F.col("close")
    st = raw.withColumn("close", close).where(F.col("close").isNotNull() & ~F.isnan("close"))
    return st.select("symbol", F.to_date("d").alias("d"), F.coalesce("open", "close").alias("open"),
                     F.coalesce("high", "close").alias("high"), F.coalesce("low", "close").alias("low"),
                     "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))
