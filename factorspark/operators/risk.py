"""Performance, tail risk, drawdown duration and factor attribution of return series.

A series has one row per key and date; the keys are usually portfolios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252
Z = {95: -1.6448536269514722, 99: -2.3263478740408408}   # fixed values: normal quantiles at 5 and 1 percent
UNBOUNDED = Window.unboundedPreceding


def compounded(series: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    """Growth of 1, its running peak and the drawdown from it."""
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(UNBOUNDED, 0)
    st = series.withColumn("growth", F.product(1 + F.col(r)).over(w))
    st = st.withColumn("peak", F.max("growth").over(w))
    return st.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def performance(series: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, drawdown and Calmar (252 days, rate 0)."""
    st = compounded(series, keys, r)
    x = F.col(r)
    agg = st.groupBy(*keys).agg(
        F.count(x).alias("n_days"), F.max_by("growth", "d").alias("_g"), F.avg(x).alias("_mu"),
        F.stddev_samp(x).alias("_sd"), F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2.0))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"))
    year = TRADING_DAYS ** 0.5
    cagr = F.when(F.col("_g") > 0, F.pow(F.col("_g"), TRADING_DAYS / F.col("n_days")) - 1)
    out = agg.withColumn("total_return", F.col("_g") - 1).withColumn("annual_return", cagr).withColumn(
        "volatility", F.col("_sd") * year)
    return (out.withColumn("sharpe", F.try_divide(F.col("_mu"), F.col("_sd")) * year)
            .withColumn("sortino", F.try_divide(F.col("_mu"), F.sqrt("_down")) * year)
            .withColumn("calmar", F.try_divide(F.col("annual_return"), F.abs("max_drawdown")))
            .drop("_g", "_mu", "_sd", "_down"))


PERFORMANCE_COLS = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")


def quick_metrics(returns: DataFrame, members: DataFrame, min_days: int = 20) -> DataFrame:
    """Equal-weight metrics per portfolio; skipped with too few available names or days.

    Names count as available when they have returns; at least three and at least half of the
    members are needed. Days count only when all available names have a return.
    """
    st = returns.where(F.col("ret").isNotNull()).join(members.select("portfolio", "symbol"), "symbol")
    have = st.groupBy("portfolio").agg(F.count_distinct("symbol").alias("valid"))
    want = members.groupBy("portfolio").agg(F.count(F.lit(1)).alias("listed"))
    ok = have.join(want, "portfolio").where(F.col("valid") >= F.greatest(F.lit(3.0), F.col("listed") * 0.5))
    day = st.groupBy("portfolio", "d").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("_n"))
    day = day.join(ok, "portfolio").where(F.col("_n") == F.col("valid"))
    perf = performance(day, ["portfolio"]).where(F.col("n_days") >= min_days)
    return perf.join(ok, "portfolio").withColumn("quick_sharpe", F.when(
        F.col("volatility") > 0, F.col("annual_return") / F.col("volatility")).otherwise(0.0))


def moments(x: Column) -> dict[str, Column]:
    """Population skewness and excess kurtosis as aggregates."""
    return {"skewness": F.skewness(x), "kurtosis": F.kurtosis(x)}


def tail_risk(series: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    """Historical, normal and skew-adjusted value at risk, shortfall, drawdown at risk, tail ratio."""
    x = F.col(r)
    st = compounded(series, keys, r)
    agg = st.groupBy(*keys).agg(
        F.count(x).alias("n_days"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        F.percentile(x, F.lit(0.05)).alias("var_95"), F.percentile(x, F.lit(0.01)).alias("var_99"),
        F.percentile("drawdown", F.lit(0.05)).alias("cdar_95"), F.percentile("drawdown", F.lit(0.01)).alias("cdar_99"),
        F.percentile(F.when(x > 0, x), F.lit(0.95)).alias("_up"), F.percentile(F.when(x < 0, x), F.lit(0.05)).alias("_down"))
    cut = agg.select(*keys, "var_95", "var_99")
    tail = series.join(cut, list(keys)).groupBy(*keys).agg(
        F.avg(F.when(x <= F.col("var_95"), x)).alias("cvar_95"), F.avg(F.when(x <= F.col("var_99"), x)).alias("cvar_99"))
    s, k = F.col("skewness"), F.col("kurtosis")
    out = agg.join(tail, list(keys))
    for level, z in Z.items():
        adj = z + (z * z - 1) / 6 * s + (z ** 3 - 3 * z) / 24 * k - (2 * z ** 3 - 5 * z) / 36 * s * s
        out = out.withColumn(f"var_normal_{level}", F.col("mean") + F.col("std") * z).withColumn(
            f"var_adjusted_{level}", F.col("mean") + F.col("std") * adj)
    jb = F.col("n_days") / 6 * (s * s + k * k / 4)
    return (out.withColumn("tail_ratio", F.try_divide(F.col("_up"), F.abs("_down")))
            .withColumn("jarque_bera", jb).withColumn("jarque_bera_p", F.exp(-F.col("jarque_bera") / 2)).drop("_up", "_down"))


TAIL_COLS = ("mean", "std", "skewness", "kurtosis", "var_95", "var_99", "cvar_95", "cvar_99", "cdar_95", "cdar_99",
             "var_normal_95", "var_normal_99", "var_adjusted_95", "var_adjusted_99", "tail_ratio", "jarque_bera", "jarque_bera_p")


def drawdown_duration(series: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    """Calendar days from the peak before the deepest drawdown to the recovery (or the last day)."""
    k = list(keys)
    st = compounded(series, k, r).select(*k, "d", "growth", "peak", "drawdown")
    low = st.groupBy(*k).agg(F.min_by(F.struct("d", "peak", "drawdown"), F.struct("drawdown", "d")).alias("_t"),
                             F.max("d").alias("_end"))
    low = low.select(*k, "_end", F.col("_t.d").alias("trough"), F.col("_t.peak").alias("_peak"),
                     F.col("_t.drawdown").alias("max_drawdown"))
    j = st.join(low, k)
    agg = j.groupBy(*k, "trough", "_end", "max_drawdown").agg(
        F.min(F.when((F.col("d") <= F.col("trough")) & (F.col("growth") >= F.col("_peak")), F.col("d"))).alias("peak_day"),
        F.min(F.when((F.col("d") >= F.col("trough")) & (F.col("growth") >= F.col("_peak")), F.col("d"))).alias("recovered"))
    return agg.select(*k, "max_drawdown", "trough", "peak_day", "recovered",
                      F.datediff(F.coalesce("recovered", "_end"), "peak_day").alias("duration_days"))


def solve_normal(df: DataFrame, k: int) -> DataFrame:
    """Columns ``b0`` .. of the solution of ``_c{i}_{j} b = _y{i}`` (i >= j), by a Cholesky factor written as column expressions.

    Each row is a system of its own, so any number of them is solved where they lie. An unknown whose column is (nearly) a combination
    of earlier ones gets 0.
    """
    def c(name: str) -> Column:
        return F.col(name)

    def less(first: Column, parts: list[Column]) -> Column:
        for p in parts:
            first = first - p
        return first
    for j in range(k):
        pivot = less(c(f"_c{j}_{j}"), [c(f"_l{j}_{m}") * c(f"_l{j}_{m}") for m in range(j)])
        df = df.withColumn(f"_ok{j}", F.coalesce(pivot > 1e-12 * c(f"_c{j}_{j}"), F.lit(False))).withColumn(
            f"_l{j}_{j}", F.when(c(f"_ok{j}"), F.sqrt(pivot)).otherwise(1.0))
        below = {f"_l{i}_{j}": F.when(c(f"_ok{j}"), less(c(f"_c{i}_{j}"), [c(f"_l{i}_{m}") * c(f"_l{j}_{m}") for m in range(j)]) / c(f"_l{j}_{j}"))
                 .otherwise(0.0) for i in range(j + 1, k)}
        z = less(c(f"_y{j}"), [c(f"_l{j}_{m}") * c(f"_z{m}") for m in range(j)]) / c(f"_l{j}_{j}")
        df = df.withColumns({**below, f"_z{j}": F.when(c(f"_ok{j}"), z).otherwise(0.0)})
    for j in reversed(range(k)):
        df = df.withColumn(f"b{j}", less(c(f"_z{j}"), [c(f"_l{i}_{j}") * c(f"b{i}") for i in range(j + 1, k)]) / c(f"_l{j}_{j}"))
    return df


def factor_attribution(series: DataFrame, factors: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exposures, alpha, R2 and annual contributions of each return series to several factors.

    ``series(*keys, d, ret)``, ``factors`` wide on ``d``, at most ten columns. Days on which a value is missing don't count. All cross
    moments of all series come from one aggregate; the normal equations of a series are solved in its row. A factor that is a combination of
    earlier ones has exposure 0; a series without a common day has no row.
    """
    if not 1 <= len(names) <= 10:
        raise ValueError("from one to ten factors")
    keys, k = list(keys), len(names)
    rows = series.select(*keys, "d", "ret").join(factors.select("d", *names), "d").dropna(subset=["ret", *names])
    cross = [F.covar_pop(names[i], names[j]).alias(f"_c{i}_{j}") for i in range(k) for j in range(i + 1)]
    st = rows.groupBy(*keys).agg(F.avg("ret").alias("_my"), F.var_pop("ret").alias("_yy"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(names)],
                                 *[F.covar_pop("ret", x).alias(f"_y{i}") for i, x in enumerate(names)], *cross)
    st = solve_normal(st.where("_my IS NOT NULL"), k)

    def total(of: str) -> Column:
        parts = [F.col(f"b{i}") * F.col(f"{of}{i}") for i in range(k)]
        return sum(parts[1:], parts[0])
    residual = (F.col("_my") - total("_m")) * TRADING_DAYS
    each = F.array(*[F.struct(F.lit(x).alias("factor"), F.col(f"b{i}").alias("exposure"), (F.col(f"b{i}") * F.col(f"_m{i}") * TRADING_DAYS).alias("contribution"))
                     for i, x in enumerate(names)])
    return st.select(*keys, residual.alias("alpha"), F.try_divide(total("_y"), F.col("_yy")).alias("r2"),
                     (F.col("_my") * TRADING_DAYS).alias("total_return"), residual.alias("residual_return"), F.inline(each))


def rebased(series: DataFrame, keys: Sequence[str], x: str = "value") -> DataFrame:
    """Percentage since each key's first value."""
    w = Window.partitionBy(*keys).orderBy("d").rowsBetween(UNBOUNDED, 0)
    return series.withColumn("since_start", (F.col(x) / F.first(x).over(w) - 1) * 100)


# Report windows.
WINDOWS = ("1W", "1M", "3M", "6M", "YTD", "1Y", "ALL")


def period_returns(series: DataFrame, keys: Sequence[str], x: str = "value") -> DataFrame:
    """Return over each report window up to the key's last date; at least two points needed."""
    k = list(keys)
    last = series.groupBy(*k).agg(F.max("d").alias("_end"), F.min("d").alias("_start"))
    e = F.col("_end")
    cut = F.array(*[F.struct(F.lit(n).alias("window"), c.alias("cutoff")) for n, c in zip(WINDOWS, (
        F.date_sub(e, 7), F.add_months(e, -1), F.add_months(e, -3), F.add_months(e, -6),
        F.trunc(e, "year"), F.add_months(e, -12), F.col("_start")))])
    st = series.join(last, k).select(*k, "d", x, F.explode(cut).alias("_w")).select(*k, "d", x, "_w.*").where(
        F.col("d") >= F.col("cutoff"))
    agg = st.groupBy(*k, "window").agg(F.count(F.lit(1)).alias("points"), F.min_by(x, "d").alias("_a"), F.max_by(x, "d").alias("_b"))
    return agg.where(F.col("points") >= 2).withColumn("period_return", F.try_divide(F.col("_b"), F.col("_a")) - 1).drop("_a", "_b")
