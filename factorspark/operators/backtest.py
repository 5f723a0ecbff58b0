"""Rebalancing backtests: weights as of each day, daily returns, triggers, walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.allocation import KEYS, trailing_solves, weights_at
from factorspark.operators.risk import performance

UNBOUNDED = Window.unboundedPreceding


def asset_returns(panel: DataFrame, start: int | Column = 0) -> DataFrame:
    """Simple returns from row ``start`` on; the first row has return 0."""
    first = start if isinstance(start, Column) else F.lit(start)
    w = Window.partitionBy(*KEYS, "symbol").orderBy("i")
    st = panel.where(F.col("i") >= first).withColumn("ret", F.col("px") / F.lag("px").over(w) - 1)
    return st.withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def weights_as_of(panel: DataFrame, weights: DataFrame, lag_weights: bool = False) -> DataFrame:
    """Last weights on or before each day; equal weights before the first.

    Weights set on a day earn that day's return, unless ``lag_weights``.
    """
    st = panel.join(weights, [*KEYS, "d", "symbol"], "left")
    w = Window.partitionBy(*KEYS, "symbol").orderBy("i").rowsBetween(UNBOUNDED, -1 if lag_weights else 0)
    n = panel.groupBy(*KEYS).agg(F.count_distinct("symbol").alias("_n"))
    st = st.withColumn("_w", F.last("w", ignorenulls=True).over(w)).join(n, KEYS)
    return st.withColumn("weight", F.coalesce("_w", 1 / F.col("_n"))).drop("_w", "_n", "w")


def backtest(panel: DataFrame, weights: DataFrame, start: int | Column = 0, fee: float = 0.001,
             lag_weights: bool = False) -> DataFrame:
    """Daily portfolio return, fees on rebalance days, and compounded value from 1."""
    held = weights_as_of(asset_returns(panel, start), weights, lag_weights)
    day = held.groupBy(*KEYS, "d", "i").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    marks = weights.select(*KEYS, "d").distinct().withColumn("rebalanced", F.lit(True))
    first = start if isinstance(start, Column) else F.lit(start)
    day = day.join(marks, [*KEYS, "d"], "left").withColumn("rebalanced", F.coalesce("rebalanced", F.lit(False)))
    cost = F.when(F.col("rebalanced") & (F.col("i") > first), F.lit(fee)).otherwise(0.0)
    day = day.withColumn("ret", F.when(F.col("i") > first, F.col("gross") - cost).otherwise(0.0))
    w = Window.partitionBy(*KEYS).orderBy("i").rowsBetween(UNBOUNDED, 0)
    return day.withColumn("value", F.product(1 + F.col("ret")).over(w)).drop("gross")


def business_month_ends(panel: DataFrame) -> DataFrame:
    """Panel dates that are the last weekday of their month."""
    days = panel.select(*KEYS, "d", "i").distinct()
    end = F.last_day("d")
    back = F.greatest(F.weekday(end) - 4, F.lit(0))
    return days.where(F.col("d") == F.date_sub(end, back))


def monthly_weights(panel: DataFrame, start: int = 0, method: str = "mhrp") -> DataFrame:
    """Weights at each business month end with at least half the look-back before it."""
    return weights_at(panel, monthly_solves(panel, start), method)


def monthly_solves(panel: DataFrame, start: int = 0) -> DataFrame:
    """When ``monthly_weights`` solves, and on which rows."""
    ends = business_month_ends(panel).where(F.col("i") >= start).select(*KEYS, "d").withColumn("_m", F.lit(True))
    return trailing_solves(panel.join(ends, [*KEYS, "d"]), F.col("_m")).select(*KEYS, "d", "w0", "w1")


def initial_solve(panel: DataFrame, start: int) -> DataFrame:
    """Weights on the first ``lookback`` rows of all data, effective at the start."""
    days = panel.where(F.col("i") == start).select(*KEYS, "d").distinct()
    return days.withColumn("w0", F.lit(0)).withColumn("w1", F.col("lookback"))


def drift_weights(panel: DataFrame, start: int, every: int = 21, threshold: float = 0.05,
                  method: str = "mhrp") -> DataFrame:
    """Weights that change only when a candidate moves a name by more than the threshold.

    Candidates for all check dates are solved in one distributed batch; what remains in order
    is accepting or rejecting them, a fold over at most rows/21 candidates per portfolio.
    """
    return accepted(weights_at(panel, drift_solves(panel, start, every), method), threshold)


def drift_solves(panel: DataFrame, start: int, every: int = 21) -> DataFrame:
    """The initial solve and one every ``every`` rows, from the second on, with more than half the look-back before it."""
    k = F.col("i") - start
    check = (k > every) & (k % every == 0)
    cand = trailing_solves(panel, check).where(F.col("w1") - F.col("w0") > F.floor(F.col("lookback") / 2))
    return cand.select(*KEYS, "d", "w0", "w1").unionByName(initial_solve(panel, start))


def accepted(w: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Of the candidate weights ``(portfolio, lookback, d, symbol, w)`` those that move a name by more than the threshold; the first stands."""
    sets = w.groupBy(*KEYS, "d").agg(F.array_sort(F.collect_list(F.struct("symbol", "w"))).alias("ws"))
    seq = sets.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("d", "ws"))).alias("c"))

    def moved(a, b):
        gaps = F.zip_with(a, b, lambda x, y: F.abs(x["w"] - y["w"]))
        return F.array_max(gaps) > threshold

    def step(acc, c):
        take = moved(c["ws"], acc["cur"])
        return F.struct(F.when(take, c["ws"]).otherwise(acc["cur"]).alias("cur"),
                        F.when(take, F.array_append(acc["kept"], c)).otherwise(acc["kept"]).alias("kept"))
    first = F.col("c")[0]
    start_state = F.struct(first["ws"].alias("cur"), F.array(first).alias("kept"))
    kept = F.aggregate(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), start_state, step)["kept"]
    out = seq.select(*KEYS, F.inline(kept)).select(*KEYS, "d", F.inline("ws"))
    return out.select(*KEYS, "d", "symbol", "w")


def volatility_weights(panel: DataFrame, start: int, window: int = 21, threshold: float = 0.2,
                       method: str = "mhrp") -> DataFrame:
    """New weights when the equal-weight volatility moves by more than 20 percent in a day."""
    return weights_at(panel, volatility_solves(panel, start, window, threshold), method)


def volatility_solves(panel: DataFrame, start: int, window: int = 21, threshold: float = 0.2) -> DataFrame:
    """The initial solve and one on each day the volatility of the last ``window`` rows jumped."""
    eq = asset_returns(panel, start).where(F.col("i") > start).groupBy(*KEYS, "d", "i").agg(F.avg("ret").alias("r"))
    w = Window.partitionBy(*KEYS).orderBy("i")
    frame = w.rowsBetween(-(window - 1), 0)
    eq = eq.withColumn("vol", F.when(F.count("r").over(frame) == window, F.stddev_samp("r").over(frame)))
    eq = eq.withColumn("_prev", F.lag("vol").over(w)).withColumn("_j", F.row_number().over(w) - 1)
    hit = (F.col("_j") > window) & (F.abs(F.try_divide(F.col("vol") - F.col("_prev"), F.col("_prev"))) > threshold)
    days = eq.where(hit).select(*KEYS, "d").withColumn("_m", F.lit(True))
    cand = trailing_solves(panel.join(days, [*KEYS, "d"]), F.col("_m")).where(
        F.col("w1") - F.col("w0") > F.floor(F.col("lookback") / 2))
    return cand.select(*KEYS, "d", "w0", "w1").unionByName(initial_solve(panel, start))


def walk_forward_folds(panel: DataFrame, start: int, months: int = 3) -> DataFrame:
    """Fold dates with the rows they are fitted on and the row of the next fold."""
    days = panel.select(*KEYS, "d", "i").distinct()
    first = days.where(F.col("i") == start).select(*KEYS, F.col("d").alias("_d0"))
    folds = days.join(first, KEYS).where((F.col("d") >= F.col("_d0")) & (
        F.datediff("d", "_d0") % (months * 30) == 0)).drop("_d0")
    w = Window.partitionBy(*KEYS).orderBy("i")
    return folds.withColumn("next_i", F.lead("i").over(w)).where(F.col("next_i").isNotNull()).withColumn(
        "w0", F.greatest(F.col("i") - F.col("lookback"), F.lit(0))).withColumn("w1", F.col("i"))


def walk_forward(panel: DataFrame, start: int, months: int = 3, method: str = "mhrp") -> DataFrame:
    """Daily in-sample and out-of-sample returns of each fold.

    Fold dates come every ``months`` x 30 calendar days and are kept only when they are panel
    dates; a fold is fitted on the look-back rows before it and tested up to the next fold.
    """
    folds = walk_forward_folds(panel, start, months)
    weights = weights_at(panel, folds.select(*KEYS, "d", "w0", "w1"), method)
    # one row per fold and covered panel row, so the pairing is an equality join
    span = folds.select(*KEYS, F.col("d").alias("fold"), "w0", "w1", "next_i",
                        F.explode(F.sequence(F.col("w0"), F.col("next_i") - 1)).alias("i"))
    ret = asset_returns(panel).select(*KEYS, "i", "d", "symbol", "ret")
    part = F.when(F.col("i") < F.col("w1"), "in").otherwise("out")
    # the first row of each slice has no return inside it
    rows = span.withColumn("sample", part).where((F.col("i") != F.col("w0")) & (F.col("i") != F.col("w1")))
    j = rows.join(ret, [*KEYS, "i"]).join(
        weights.select(*KEYS, F.col("d").alias("fold"), "symbol", "w"), [*KEYS, "fold", "symbol"])
    return j.groupBy(*KEYS, "fold", "sample", "d").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))


def walk_forward_summary(daily: DataFrame) -> DataFrame:
    """Pooled in- and out-of-sample metrics side by side and the loss in Sharpe ratio."""
    pooled = daily.select(*KEYS, "sample", F.struct("fold", "d").alias("d"), "ret")
    m = performance(pooled, [*KEYS, "sample"])
    pick = {}
    for c in ("sharpe", "annual_return", "volatility", "max_drawdown"):
        for s in ("in", "out"):
            pick[f"{s}_{c}"] = F.max(F.when(F.col("sample") == s, F.col(c)))
    out = m.groupBy(*KEYS).agg(*[v.alias(n) for n, v in pick.items()])
    return out.withColumn("sharpe_degradation", F.col("in_sharpe") - F.col("out_sharpe"))
