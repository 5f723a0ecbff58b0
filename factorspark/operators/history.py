"""Scoring of many past dates in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.operators.factors import composite_score
from factorspark.operators.regimes import regime_for_dates
from factorspark.operators.selection import full_rank


def with_regime(dates: DataFrame, periods: DataFrame, manual: str | None = None) -> DataFrame:
    """Regime of every scoring date from the periods, or one manual regime for all."""
    if manual is not None:
        return dates.withColumn("regime", F.lit(manual))
    return regime_for_dates(dates, periods).withColumnRenamed("regime_name", "regime")


FACTORS = ("value", "quality", "financial_health", "technical", "insider", "momentum", "stability", "size", "options_flow",
           "liquidity", "carry", "growth")


def batch_scores(factors: DataFrame, periods: DataFrame, manual: str | None = None) -> DataFrame:
    """Ranked composite of every snapshot date whose regime is known: one plan for all dates.

    ``factors(symbol, as_of, regime, sector, industry)`` with all twelve factors, as of each date and for each regime.
    """
    absent = [f for f in FACTORS if f not in factors.columns]
    if absent:
        raise ValueError(f"no column for the factors {absent}")
    days = with_regime(factors.select(F.col("as_of").alias("d")).distinct(), periods, manual).where("regime is not null")
    rows = factors.join(days.withColumnRenamed("d", "as_of"), ["as_of", "regime"])
    scored = composite_score(rows).select("regime", F.col("as_of").alias("snapshot_date"), "symbol",
                                          F.round("score", 6).alias("score"), "sector", "industry")
    return full_rank(scored, ["snapshot_date"], "score")


def batch_status(dates: DataFrame, periods: DataFrame, done: DataFrame, scorable: Column) -> DataFrame:
    """Outcome per requested date: exists, no_regime, error (nothing to score) or success."""
    st = regime_for_dates(dates, periods).join(done.select("d").distinct().withColumn("_done", F.lit(True)), "d", "left")
    status = (F.when(F.col("_done"), "exists").when(F.col("regime_name").isNull(), "no_regime")
              .when(scorable, "success").otherwise("error"))
    return st.withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
