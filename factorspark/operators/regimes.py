"""Regime labels per instrument: periods, statistics, naming, transitions, lookups, models.

Labelled days are unique on ``(symbol, d)``, so each instrument's window is bounded by the
calendar; interval tables are turned into one row per covered day and joined on equality.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions import scores as sc
from factorspark.functions.exprs import clip
from factorspark.functions.windows import by_symbol, island_id, pct_change, rolling_std, sma
from factorspark.operators.indicators import TRADING_DAYS, adaptive_stats, clean_returns
from factorspark.session import shared

UNBOUNDED = Window.unboundedPreceding
K = 3


# ---- feature tables -----------------------------------------------------------------

def basic_features(bars: DataFrame) -> DataFrame:
    """Clipped return, adaptive volatility and price over its adaptive mean, per instrument."""
    st = clean_returns(bars.select("symbol", "d", "close"))
    st = adaptive_stats(st, "filled_ret").drop("adaptive_mean").withColumnRenamed("adaptive_std", "_vol")
    st = adaptive_stats(st, "close").drop("adaptive_std").withColumnRenamed("adaptive_mean", "_ma")
    ratio = F.when(F.col("_ma") != 0, F.col("close") / F.col("_ma")).otherwise(F.when(F.col("_ma").isNotNull(), 1.0))
    return st.select("symbol", "d", F.col("clipped_ret").alias("ret"), clip(F.col("_vol"), 0, 1).alias("vol"),
                     clip(ratio, 0.5, 2.0).alias("ma_ratio")).where(
        "ret is not null and vol is not null and ma_ratio is not null")


NINE_FEATURES = ("return_1d", "return_5d", "return_21d", "volatility_21d", "volatility_63d", "vol_change",
                 "vol_norm", "trend", "momentum")


def nine_features(bars: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """Returns, volatilities, volatility change, normalised level, trend and momentum.

    ``level(symbol, d, level)`` is a stress index; without it the instrument's own 21-day
    volatility is normalised instead.
    """
    w = by_symbol()
    st = bars.select("symbol", "d", "close").withColumn("return_1d", pct_change(F.col("close"), 1, w))
    r = F.col("return_1d")
    year = TRADING_DAYS ** 0.5
    st = st.select("*", sma(r, 5, w).alias("return_5d"), sma(r, 21, w).alias("return_21d"),
                   (rolling_std(r, 21, w) * year).alias("volatility_21d"),
                   (rolling_std(r, 63, w) * year).alias("volatility_63d"),
                   sma(F.col("close"), 50, w).alias("_s50"), sma(F.col("close"), 200, w).alias("_s200"),
                   pct_change(F.col("close"), 63, w).alias("momentum"))
    if level is None:
        st = st.withColumn("_lvl", F.col("volatility_21d"))
    else:
        st = st.join(level.select("symbol", "d", F.col("level").alias("_lvl")), ["symbol", "d"], "left")
    st = st.select("*", pct_change(F.col("volatility_21d"), 21, w).alias("vol_change"),
                   F.try_divide(F.col("_lvl") - sma(F.col("_lvl"), 252, w),
                                rolling_std(F.col("_lvl"), 252, w)).alias("vol_norm"),
                   F.try_divide(F.col("_s50") - F.col("_s200"), F.col("_s200")).alias("trend"))
    return st.select("symbol", "d", *NINE_FEATURES).dropna()


def three_features(bars: DataFrame) -> DataFrame:
    """21-day volatility, annualised 21-day mean return, and the volatility level per 100."""
    w = by_symbol()
    st = bars.select("symbol", "d", pct_change(F.col("close"), 1, w).alias("_r"))
    vol = rolling_std(F.col("_r"), 21, w) * TRADING_DAYS ** 0.5
    return st.select("symbol", "d", vol.alias("volatility"), (sma(F.col("_r"), 21, w) * TRADING_DAYS).alias("momentum"),
                     (vol / 100).alias("level")).dropna()


# ---- periods ------------------------------------------------------------------------

def run_periods(labels: DataFrame) -> DataFrame:
    """Runs of equal labels: start, end and calendar days including both ends."""
    w = by_symbol()
    change = F.coalesce(F.col("regime") != F.lag("regime").over(w), F.lit(True))
    st = labels.withColumn("_run", island_id(change, w))
    return st.groupBy("symbol", "_run").agg(
        F.first("regime").alias("regime"), F.min("d").alias("start_date"), F.max("d").alias("end_date")).drop(
        "_run").withColumn("days", F.datediff("end_date", "start_date") + 1)


def gap_periods(labels: DataFrame, max_gap: int = 5) -> DataFrame:
    """Periods of one label that end only at a gap of more than ``max_gap`` days (days without +1)."""
    w = Window.partitionBy("symbol", "regime").orderBy("d")
    jump = F.coalesce(F.datediff("d", F.lag("d").over(w)) > max_gap, F.lit(True))
    st = labels.withColumn("_run", island_id(jump, w))
    return st.groupBy("symbol", "regime", "_run").agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date")).drop("_run").withColumn(
        "days", F.datediff("end_date", "start_date"))


def period_calendar(periods: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per covered day with the first period's value (``period_seq`` order).

    The result has at most one row per key and calendar day, whatever the overlap.
    """
    days = periods.select(*keys, value, "period_seq", F.explode(F.sequence("start_date", "end_date")).alias("d"))
    return days.groupBy(*keys, "d").agg(F.min_by(value, "period_seq").alias(value))


def regime_for_dates(dates: DataFrame, periods: DataFrame) -> DataFrame:
    """Regime of each date: closed intervals, the first matching period wins; null if none."""
    return dates.join(period_calendar(periods, "regime_name"), "d", "left")


def restrict_to_regime(returns: DataFrame, periods: DataFrame, regime: str, min_days: int = 60) -> DataFrame:
    """Rows of each portfolio inside the regime's periods; a portfolio with under ``min_days`` such dates keeps all rows.

    The dates are counted over the portfolio, not for each symbol, so all its symbols keep the same dates.
    """
    days = period_calendar(periods.where(F.col("regime_name") == regime), "regime_name").withColumnRenamed(
        "regime_name", "_hit")
    st = returns.join(days, "d", "left")
    n = st.where(F.col("_hit").isNotNull()).groupBy("portfolio").agg(F.count_distinct("d").alias("_n"))
    return st.join(n, "portfolio", "left").where((F.coalesce("_n", F.lit(0)) < min_days) | F.col("_hit").isNotNull()).drop("_hit", "_n")


# ---- statistics ---------------------------------------------------------------------

def regime_statistics(labels: DataFrame) -> DataFrame:
    """Days, share and number of entries per regime (the first day is no entry)."""
    w = by_symbol()
    st = labels.select("symbol", "regime", (F.col("regime") != F.lag("regime").over(w)).alias("_in"))
    total = Window.partitionBy("symbol")
    agg = st.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("days"),
                                             F.sum(F.coalesce(F.col("_in").cast("int"), F.lit(0))).alias("entries"))
    return agg.withColumn("share", F.col("days") / F.sum("days").over(total))


def sample_skew(x: Column, n: Column) -> Column:
    """Sample-adjusted skewness (needs three values)."""
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column, n: Column) -> Column:
    """Sample-adjusted excess kurtosis (needs four values)."""
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def characterise(labels: DataFrame, returns: DataFrame) -> DataFrame:
    """Frequency, annual return, volatility, Sharpe, shape and drawdown per regime."""
    st = labels.join(returns.select("symbol", "d", "ret"), ["symbol", "d"], "left")
    w = Window.partitionBy("symbol", "regime").orderBy("d").rowsBetween(UNBOUNDED, 0)
    st = st.withColumn("_g", F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(w))
    # the running maximum starts at the first compounded value
    st = st.withColumn("_dd", F.when(F.col("ret").isNotNull(), F.col("_g") / F.max(
        F.when(F.col("ret").isNotNull(), F.col("_g"))).over(w) - 1))
    n, r = F.count("ret"), F.col("ret")
    agg = st.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("total_days"), F.avg(r).alias("_mu"), F.stddev_samp(r).alias("_sd"),
        sample_skew(r, n).alias("skewness"), sample_kurtosis(r, n).alias("kurtosis"),
        F.min("_dd").alias("max_drawdown"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))
    year = TRADING_DAYS ** 0.5
    share = F.col("total_days") / F.sum("total_days").over(Window.partitionBy("symbol"))
    return agg.select(
        "symbol", "regime", share.alias("frequency"), "total_days", (F.col("_mu") * TRADING_DAYS).alias("mean_return"),
        (F.col("_sd") * year).alias("volatility"),
        F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * year).otherwise(0.0).alias("sharpe"),
        "skewness", "kurtosis", "max_drawdown", "first_day", "last_day")


def regime_feature_means(labels: DataFrame, features: DataFrame, names: Sequence[str]) -> DataFrame:
    st = labels.join(features, ["symbol", "d"])
    return st.groupBy("symbol", "regime").agg(*[F.avg(c).alias(c) for c in names])


def name_regimes(chars: DataFrame) -> DataFrame:
    """Names by Sharpe rank for three regimes (by levels otherwise), with one Steady Growth assured."""
    sym = Window.partitionBy("symbol")
    rank = F.row_number().over(sym.orderBy(F.desc("sharpe"), F.asc("regime")))
    st = chars.withColumn("_rank", rank).withColumn("_k", F.count(F.lit(1)).over(sym))
    s, m, v = F.col("sharpe"), F.col("mean_return"), F.col("volatility")
    bull, steady, bear = F.lit("Strong Bull"), F.lit("Steady Growth"), F.lit("Crisis/Bear")
    # fixed values: naming thresholds
    three = (F.when(F.col("_rank") == 1, F.when((s > 0.4) & (m > 0.0), bull).otherwise(steady))
             .when(F.col("_rank") == 2, F.when((m < -0.05) | (s < -0.2), bear).otherwise(steady))
             .otherwise(F.when((s < 0.3) | (m < 0.02) | (v > 0.22), bear).otherwise(steady)))
    other = F.when((s > 0.7) & (m > 0.10) & (v < 0.15), bull).when((s < 0.2) | (m < 0.0) | (v > 0.22), bear).otherwise(steady)
    st = st.withColumn("_name", F.when(F.col("_k") == 3, three).otherwise(other))
    none = F.max((F.col("_name") == "Steady Growth").cast("int")).over(sym) == 0
    near = F.abs(s - 0.5) + F.abs(m - 0.08)
    closest = F.row_number().over(sym.orderBy(near.asc(), F.asc("_rank"))) == 1
    st = st.withColumn("_none", none).withColumn("_closest", closest)
    name = F.when(F.col("_none") & F.col("_closest") & (F.col("_k") >= 2), steady).otherwise(F.col("_name"))
    return st.withColumn("regime_name", name).drop("_rank", "_k", "_name", "_none", "_closest")


def transitions(labels: DataFrame) -> DataFrame:
    """Transition counts and probabilities between consecutive days, with expected duration."""
    nxt = F.lead("regime").over(by_symbol())
    st = labels.select("symbol", F.col("regime").alias("from_regime"), nxt.alias("to_regime")).where(
        F.col("to_regime").isNotNull())
    agg = st.groupBy("symbol", "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_regime"))
    agg = agg.withColumn("probability", p)
    stay = F.col("from_regime") == F.col("to_regime")
    return agg.withColumn("expected_duration", F.when(stay, F.try_divide(F.lit(1.0), 1 - F.col("probability"))))


def transition_rows(labels: DataFrame, k: int = K) -> DataFrame:
    """One row per instrument with the k x k matrix as columns ``a_<from><to>`` (0 if unseen)."""
    t = transitions(labels)
    return t.groupBy("symbol").agg(*[
        F.coalesce(F.max(F.when((F.col("from_regime") == i) & (F.col("to_regime") == j), F.col("probability"))),
                   F.lit(0.0)).alias(f"a_{i}{j}") for i in range(k) for j in range(k)])


def feature_importance(means: DataFrame, names: Sequence[str], top: int = 10) -> DataFrame:
    """Variance of the regime means of each feature, largest first."""
    long = means.unpivot(["symbol", "regime"], list(names), "feature", "mean")
    agg = long.groupBy("symbol", "feature").agg(F.var_samp("mean").alias("importance"))
    w = Window.partitionBy("symbol").orderBy(F.desc("importance"), F.asc("feature"))
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def separation(means: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean Euclidean distance between the k regime centres (k rows per instrument)."""
    a, b = means.alias("a"), means.alias("b")
    d2 = None
    for c in names:
        part = F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2.0))
        d2 = part if d2 is None else d2 + part
    pairs = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.regime") < F.col("b.regime")))
    return pairs.groupBy(F.col("a.symbol").alias("symbol")).agg(F.avg(F.sqrt(d2)).alias("separation"))


def validate_events(named: DataFrame, events: DataFrame) -> DataFrame:
    """Dominant regime in each event interval and whether it is the expected kind.

    ``named(symbol, d, regime_name)``; ``events(event, start_date, end_date, expected)``.
    """
    days = events.select("event", "expected", F.explode(F.sequence("start_date", "end_date")).alias("d"))
    counts = named.join(days, "d").groupBy("symbol", "event", "expected", "regime_name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("symbol", "event").orderBy(F.desc("n"), F.asc("regime_name"))
    top = counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return top.withColumn("matched", sc.labels_match(F.col("regime_name"), F.col("expected")))


def band_alignment(named: DataFrame, level: DataFrame) -> DataFrame:
    """Share of days on which the regime fits the volatility band."""
    st = named.join(level.select("symbol", "d", "level"), ["symbol", "d"])
    ok = sc.band_agrees(F.col("regime_name"), sc.vix_band(F.col("level")))
    return st.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.avg(ok.cast("double")).alias("alignment"))


def share_of_days(periods: DataFrame) -> DataFrame:
    """Percentage of period days per regime name."""
    agg = periods.groupBy("symbol", "regime_name").agg(F.sum("days").alias("days"))
    return agg.withColumn("percentage", F.col("days") / F.sum("days").over(Window.partitionBy("symbol")) * 100)


def current_regime(periods: DataFrame, boost: float = 2.0, cap: float = 0.8) -> DataFrame:
    """Regime of the period that ends last, with period frequencies boosted towards it.

    The current regime's frequency is doubled (at most ``cap``), the others are shrunk in
    proportion, and the result is rescaled to one.
    """
    freq = periods.groupBy("symbol", "regime_name").agg(F.count(F.lit(1)).alias("_n"))
    cur = periods.groupBy("symbol").agg(F.max_by("regime_name", F.struct("end_date", "start_date")).alias("current"),
                                        F.count(F.lit(1)).alias("_t"))
    st = freq.join(cur, "symbol").withColumn("_p", F.col("_n") / F.col("_t"))
    is_cur = F.col("regime_name") == F.col("current")
    sym = Window.partitionBy("symbol")
    p_cur = F.max(F.when(is_cur, F.col("_p"))).over(sym)
    st = st.withColumn("_pc", p_cur).withColumn("_new", F.least(F.col("_pc") * boost, F.lit(cap)))
    others = F.when(F.col("_pc") < 1, F.col("_p") * (1 - F.col("_new")) / (1 - F.col("_pc"))).otherwise(F.col("_p") * 0.1)
    st = st.withColumn("_q", F.when(is_cur, F.col("_new")).otherwise(others))
    return st.select("symbol", "regime_name", "current", (F.col("_q") / F.sum("_q").over(sym)).alias("probability"))


# ---- models -------------------------------------------------------------------------

def feature_pipeline(names: Sequence[str], max_components: int = 5) -> Pipeline:
    """Assemble and standardise; reduce to five components when there are more features."""
    stages = [VectorAssembler(inputCols=list(names), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)]
    if len(names) > max_components:
        stages.append(PCA(k=max_components, inputCol="_scaled", outputCol="features"))
    else:
        stages[-1].setOutputCol("features")
    return Pipeline(stages=stages)


def fit_mixture(features: DataFrame, names: Sequence[str], k: int = K, seeds: Sequence[int] = (42, 7, 11),
                max_iter: int = 50) -> PipelineModel:
    """Best of several seeded Gaussian mixtures by log-likelihood, as one reusable pipeline."""
    prep = feature_pipeline(names).fit(features)
    data = prep.transform(features).select("features").persist()
    try:
        fits = [GaussianMixture(k=k, seed=s, maxIter=max_iter, featuresCol="features", probabilityCol="probability",
                                predictionCol="regime").fit(data) for s in seeds]
        best = max(fits, key=lambda m: m.summary.logLikelihood)
    finally:
        data.unpersist()
    return PipelineModel(stages=[*prep.stages, best])


def label_days(model: PipelineModel, features: DataFrame, k: int = K) -> DataFrame:
    """Hard label and class probabilities of each day."""
    p = vector_to_array("probability")
    out = model.transform(features)
    return out.select("symbol", "d", F.col("regime").cast("int").alias("regime"),
                      *[p[i].alias(f"p_{i}") for i in range(k)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


FILTER_BLOCK = 1024


def filter_walk(q: np.ndarray, p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Day by day: yesterday's state through the transitions ``a``, weighted by the day's probabilities; equal shares where nothing is left."""
    out = np.empty_like(p)
    for t in range(len(p)):
        q = q @ a * p[t]
        total = q.sum()
        q = q / total if total > 0 else np.full(len(q), 1.0 / len(q))
        out[t] = q
    return out


class FilterMap:
    """What a block of days makes of any state before it.

    Rows of the product of the days' matrices, each of sum 1 with the logarithm of its size, are mixed by the state's shares. Where nothing
    is left on some day the filter starts again from equal shares: that depends only on which shares are positive, so for each such
    set (of 2 ** k - 1) there is either the product or the state that the new start has led to.
    """

    def __init__(self, rows: np.ndarray, size: np.ndarray, fixed: dict[int, np.ndarray]) -> None:
        self.rows, self.size, self.fixed = rows, size, fixed

    @classmethod
    def of(cls, p: np.ndarray, a: np.ndarray) -> FilterMap:
        k = len(a)
        rows, size, fixed = np.eye(k), np.zeros(k), {}
        for day in p:
            for mask, q in fixed.items():
                fixed[mask] = filter_walk(q, day[None], a)[0]
            rows = rows @ a * day
            total = rows.sum(axis=1)
            left = total > 0
            rows[left] /= total[left, None]
            size = np.where(left, size + np.log(np.where(left, total, 1.0)), -np.inf)
            if not left.all():
                for mask in range(1, 1 << k):
                    if mask not in fixed and not any(left[i] for i in range(k) if mask >> i & 1):
                        fixed[mask] = np.full(k, 1.0 / k)
        return cls(rows, size, fixed)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mask = sum(1 << i for i, x in enumerate(q) if x > 0)
        if mask in self.fixed:
            return self.fixed[mask]
        with np.errstate(divide="ignore"):
            w = np.log(q) + self.size
        w = np.exp(w - w.max())
        out = w @ self.rows
        return out / out.sum()


def filter_labels(probs: DataFrame, matrix: DataFrame, k: int = K, block: int = FILTER_BLOCK) -> DataFrame:
    """Forward filter: each day's probabilities weighted by yesterday's state and the transitions.

    ``probs(symbol, d, p_0..)`` and ``matrix(symbol, a_00..)``; a symbol without a matrix is left out. The filter is a product of a matrix
    for each day, so a series is cut into blocks: all blocks become maps at once, each symbol's few maps give the state before every
    block, and all blocks are walked at once. No array or group grows with a series.
    """
    ps, cells = [f"p_{i}" for i in range(k)], [f"a_{i}{j}" for i in range(k) for j in range(k)]
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("d")) - 1
    rows = shared(probs.select("symbol", "d", *ps, number.alias("i")).join(matrix.select("symbol", *cells), "symbol").withColumn("blk", F.floor(F.col("i") / block)))
    state = [f"q_{i}" for i in range(k)]

    def parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("i")
        return pdf, pdf[ps].to_numpy(float), pdf[cells].iloc[0].to_numpy(float).reshape(k, k)

    def first_day(p: np.ndarray) -> np.ndarray:
        return p / p.sum() if p.sum() > 0 else np.full(k, 1.0 / k)

    def as_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, a = parts(pdf)
        if key[1] == 0:         # a series starts with its first day: whatever came before, one state comes out
            end = filter_walk(first_day(p[0]), p[1:], a)[-1] if len(p) > 1 else first_day(p[0])
            m = FilterMap(np.eye(k), np.zeros(k), {mask: end for mask in range(1, 1 << k)})
        else:
            m = FilterMap.of(p, a)
        return pd.DataFrame([(key[0], key[1], m.rows.ravel().tolist(), m.size.tolist(), list(m.fixed), np.ravel(list(m.fixed.values())).tolist())],
                            columns=["symbol", "blk", "rows", "size", "masks", "fixed"])

    def opened(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, out = np.full(k, 1.0 / k), []
        for blk, r, size, masks, fixed in pdf.sort_values("blk")[["blk", "rows", "size", "masks", "fixed"]].itertuples(index=False):
            out.append((key[0], blk, *q))
            kept = np.reshape(fixed, (-1, k))
            q = FilterMap(np.reshape(r, (k, k)), np.asarray(size), {int(m): kept[x] for x, m in enumerate(masks)})(q)
        return pd.DataFrame(out, columns=["symbol", "blk", *state])

    def walked(key: tuple, pdf: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        pdf, p, a = parts(pdf)
        if key[1] == 0:
            q = np.vstack([first_day(p[0]), filter_walk(first_day(p[0]), p[1:], a)])
        else:
            q = filter_walk(starts[state].iloc[0].to_numpy(float), p, a)
        return pd.DataFrame({"symbol": key[0], "d": pdf["d"].to_numpy(), "regime": q.argmax(axis=1).astype(np.int32), **{c: q[:, x] for x, c in enumerate(state)}})
    maps = rows.groupBy("symbol", "blk").applyInPandas(
        as_map, "symbol string, blk long, rows array<double>, size array<double>, masks array<int>, fixed array<double>")
    doubles = ", ".join(f"{c} double" for c in state)
    starts = maps.groupBy("symbol").applyInPandas(opened, f"symbol string, blk long, {doubles}")
    return rows.groupBy("symbol", "blk").cogroup(starts.groupBy("symbol", "blk")).applyInPandas(walked, f"symbol string, d date, regime int, {doubles}")


def current_probability(filtered: DataFrame, k: int = K) -> DataFrame:
    """Last day's label and its filtered probability per instrument."""
    q = F.array(*[F.col(f"q_{i}") for i in range(k)])
    return filtered.groupBy("symbol").agg(F.max("d").alias("d"), F.max_by("regime", "d").alias("regime"),
                                          F.max_by(F.array_max(q), "d").alias("probability"))
