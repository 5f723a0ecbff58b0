"""Per-symbol technical indicators as window expressions.

Input is any table unique on ``(symbol, d)``; ``x`` names the measured column. Indicators
that share one ordering are put in one ``select`` so that one exchange and one sort serve
them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import clip, sigmoid, tanh01
from factorspark.functions.windows import (by_symbol, ema, full_frame, last_rows, pct_change,
                                           rolling_std, simple_return, sma, span_alpha, trailing_means, trailing_moments)

TRADING_DAYS = 252
UNBOUNDED = Window.unboundedPreceding


def returns(df: DataFrame, x: str = "close") -> DataFrame:
    """Simple return to the previous bar; null on a symbol's first bar."""
    return df.withColumn("ret", simple_return(F.col(x), by_symbol()))


def clean_returns(df: DataFrame, x: str = "close", bound: float = 0.5) -> DataFrame:
    """Returns with gaps filled (forward, then backward, then 0) and clipped to +-bound."""
    w = by_symbol()
    r = pct_change(F.col(x), 1, w)
    raw = df.withColumn("_r", F.when(F.abs(r) != F.lit(float("inf")), r))
    back = Window.partitionBy("symbol").orderBy(F.desc("d")).rowsBetween(UNBOUNDED, 0)
    ahead = F.last("_r", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, 0))
    filled = raw.withColumn("_f", ahead).withColumn(
        "filled_ret", F.coalesce("_f", F.last("_r", ignorenulls=True).over(back), F.lit(0.0)))
    return filled.withColumn("clipped_ret", clip(F.col("filled_ret"), -bound, bound)).drop("_r", "_f")


def moving_averages(df: DataFrame, x: str = "close",
                    sizes: Sequence[int] = (5, 10, 20, 50, 200)) -> DataFrame:
    return trailing_means(df, x, {n: f"sma_{n}" for n in sizes}, by_symbol())


def adaptive_stats(df: DataFrame, x: str, n: int = 20, min_rows: int = 5) -> DataFrame:
    """Rolling mean and std that fall back to the expanding window on short history."""
    w = by_symbol()
    roll, grow = w.rowsBetween(-(n - 1), 0), w.rowsBetween(UNBOUNDED, 0)
    c = F.col(x)

    def pick(agg):
        return (F.when(F.count(c).over(roll) >= min_rows, agg(c).over(roll))
                .when(F.count(c).over(grow) >= 2, agg(c).over(grow)))
    return df.select("*", pick(F.avg).alias("adaptive_mean"), pick(F.stddev_samp).alias("adaptive_std"))


def rolling_volatility(df: DataFrame, sizes: Sequence[int] = (20, 21, 63)) -> DataFrame:
    """Annualised volatility of ``ret`` over each window size."""
    w = by_symbol()
    return df.select("*", *[(rolling_std(F.col("ret"), n, w) * (TRADING_DAYS ** 0.5)).alias(f"vol_{n}")
                            for n in sizes])


def trailing_zscore(df: DataFrame, x: str = "close", n: int = 252) -> DataFrame:
    st = trailing_moments(df, x, n, by_symbol(), "_mean", "_squares")
    return st.withColumn("zscore", F.try_divide(F.col(x) - F.col("_mean"), F.sqrt(F.col("_squares") / (n - 1)))).drop("_mean", "_squares")


def momentum_changes(df: DataFrame, x: str = "close", lags: Sequence[int] = (10, 21, 63)) -> DataFrame:
    w = by_symbol()
    return df.select("*", *[pct_change(F.col(x), k, w).alias(f"chg_{k}") for k in lags])


def exponential_averages(df: DataFrame, x: str = "close",
                         spans: Sequence[int] = (5, 10, 12, 26)) -> DataFrame:
    return ema(df, {f"ema_{n}": (x, span_alpha(n)) for n in spans})


def macd(df: DataFrame, x: str = "close") -> DataFrame:
    """MACD(12, 26, 9) for symbols with at least 26 points; others get nulls."""
    w = Window.partitionBy("symbol")
    base = ema(df, {"_e12": (x, span_alpha(12)), "_e26": (x, span_alpha(26))})
    base = base.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_line", F.col("_e12") - F.col("_e26"))
    base = ema(base, {"_sig": ("_line", span_alpha(9))})
    ok = F.col("_n") >= 26
    return (base.withColumn("macd", F.when(ok, F.col("_line")))
            .withColumn("macd_signal", F.when(ok, F.col("_sig")))
            .withColumn("macd_hist", F.when(ok, F.col("_line") - F.col("_sig")))
            .drop("_e12", "_e26", "_n", "_line", "_sig"))


def rsi(df: DataFrame, x: str = "close", n: int = 14) -> DataFrame:
    """RSI on plain rolling means of gains and losses (the first change counts as 0)."""
    w = by_symbol()
    delta = F.col(x) - F.lag(x).over(w)
    base = df.withColumn("_g", F.when(delta > 0, delta).otherwise(0.0)).withColumn(
        "_l", F.when(delta < 0, -delta).otherwise(0.0))
    gain, loss = sma(F.col("_g"), n, w), sma(F.col("_l"), n, w)
    val = (F.when((loss == 0) & (gain > 0), F.lit(100.0))
           .when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))))
    return base.withColumn("rsi", val).drop("_g", "_l")


def bollinger(df: DataFrame, x: str = "close", n: int = 20, k: float = 2.0) -> DataFrame:
    w = by_symbol()
    c = F.col(x)
    base = df.withColumn("bb_mid", sma(c, n, w)).withColumn("_sd", rolling_std(c, n, w))
    return (base.withColumn("bb_upper", F.col("bb_mid") + k * F.col("_sd"))
            .withColumn("bb_lower", F.col("bb_mid") - k * F.col("_sd"))
            .withColumn("percent_b", F.try_divide(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))
            .withColumn("bandwidth", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")))
            .drop("_sd"))


def series_adx(df: DataFrame, x: str = "close", n: int = 14) -> DataFrame:
    """Directional strength of a single series: two-point highs and lows, plain means."""
    w = by_symbol()
    c = F.col(x)
    st = df.withColumn("_hi", full_frame(F.max, c, 2, w)).withColumn("_lo", full_frame(F.min, c, 2, w))
    up, down = F.col("_hi") - F.lag("_hi").over(w), F.lag("_lo").over(w) - F.col("_lo")
    st = (st.withColumn("_up", F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))))
          .withColumn("_dn", F.when(down.isNotNull(), F.greatest(down, F.lit(0.0))))
          .withColumn("_tr", F.col("_hi") - F.col("_lo")))
    atr = sma(F.col("_tr"), n, w)
    st = (st.withColumn("plus_di", 100 * F.try_divide(sma(F.col("_up"), n, w), atr))
          .withColumn("minus_di", 100 * F.try_divide(sma(F.col("_dn"), n, w), atr)))
    p, m = F.col("plus_di"), F.col("minus_di")
    st = st.withColumn("_dx", 100 * F.try_divide(F.abs(p - m), p + m))
    return st.withColumn("adx", sma(F.col("_dx"), n, w)).drop("_hi", "_lo", "_up", "_dn", "_tr", "_dx")


def true_adx(df: DataFrame, bars_back: int = 126, n: int = 14, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Last ADX, +DI and -DI per symbol (or ``keys``) from high, low and close with Wilder smoothing."""
    w = by_symbol(keys)
    sub = last_rows(df, bars_back, keys, name="_rn")
    pc, ph, pl = F.lag("close").over(w), F.lag("high").over(w), F.lag("low").over(w)
    up, down = F.col("high") - ph, pl - F.col("low")
    sub = sub.select(
        *keys, "d",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc),
                   F.abs(F.col("low") - pc)).alias("_tr"),
        F.when((up > down) & (up > 0), up).otherwise(0.0).alias("_up"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("_dn"),
        pc.isNotNull().alias("_has")).where("_has")
    a = 1.0 / n
    sm = ema(sub, {"_str": ("_tr", a), "_sup": ("_up", a), "_sdn": ("_dn", a)}, keys)
    sm = (sm.withColumn("plus_di", F.coalesce(100 * F.try_divide(F.col("_sup"), F.col("_str")), F.lit(0.0)))
          .withColumn("minus_di", F.coalesce(100 * F.try_divide(F.col("_sdn"), F.col("_str")), F.lit(0.0))))
    p, m = F.col("plus_di"), F.col("minus_di")
    sm = sm.withColumn("_dx", F.coalesce(100 * F.try_divide(F.abs(p - m), p + m), F.lit(0.0)))
    sm = ema(sm, {"adx": ("_dx", a)}, keys)
    return sm.groupBy(*keys).agg(
        F.max_by("adx", "d").alias("adx"), F.max_by("plus_di", "d").alias("plus_di"),
        F.max_by("minus_di", "d").alias("minus_di"))


def sma_cross(df: DataFrame, x: str = "close") -> DataFrame:
    """``bullish``/``bearish``/``neutral`` where SMA 5 crosses SMA 10, from the 11th row on."""
    w = by_symbol()
    st = df.withColumn("sma_5", sma(F.col(x), 5, w)).withColumn("sma_10", sma(F.col(x), 10, w))
    st = st.withColumn("_i", F.row_number().over(w) - 1)
    p5, p10 = F.lag("sma_5").over(w), F.lag("sma_10").over(w)
    sig = (F.when(F.col("_i") == 0, F.lit(None).cast("string"))
           .when(F.col("_i") < 10, "neutral")
           .when((F.col("sma_5") > F.col("sma_10")) & (p5 <= p10), "bullish")
           .when((F.col("sma_5") < F.col("sma_10")) & (p5 >= p10), "bearish")
           .otherwise("neutral"))
    return st.withColumn("cross_signal", sig).drop("_i")


def acceleration(df: DataFrame, x: str = "close") -> DataFrame:
    """Per symbol: mean of the last three first and second differences and the phase."""
    w = by_symbol()
    st = df.withColumn("velocity", F.col(x) - F.lag(x).over(w))
    st = st.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))
    st = last_rows(st.select("symbol", "d", "velocity", "acceleration"), 3)
    out = st.groupBy("symbol").agg(F.avg("velocity").alias("recent_velocity"),
                                   F.avg("acceleration").alias("recent_acceleration"))
    v, a = F.col("recent_velocity"), F.col("recent_acceleration")
    phase = (F.when((v > 0.1) & (a > 0.05), "accelerating_up")
             .when((v > 0.1) & (a < -0.05), "decelerating_up")
             .when((v < -0.1) & (a > 0.05), "decelerating_down")
             .when((v < -0.1) & (a < -0.05), "accelerating_down").otherwise("stable"))
    return out.withColumn("phase", phase)


def drawdowns(df: DataFrame, x: str = "close") -> DataFrame:
    """Running peak, drawdown (<= 0) and running maximum drawdown."""
    w = by_symbol().rowsBetween(UNBOUNDED, 0)
    st = df.withColumn("peak", F.max(x).over(w))
    st = st.withColumn("drawdown", F.try_divide(F.col(x), F.col("peak")) - 1)
    return st.withColumn("max_drawdown", F.min("drawdown").over(w))


def cumulative_growth(df: DataFrame, r: str = "ret") -> DataFrame:
    """Compounded growth of 1, with a null return counted as no change."""
    w = by_symbol().rowsBetween(UNBOUNDED, 0)
    return df.withColumn("growth", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(w))


def volume_flow(df: DataFrame) -> DataFrame:
    """Slopes per bar of on-balance volume and of accumulation/distribution."""
    w = by_symbol()
    signed = F.when(F.col("close") < F.lag("close").over(w), -F.col("volume")).otherwise(F.col("volume"))
    span = F.col("high") - F.col("low")
    clv = F.coalesce(F.when(span != 0, ((F.col("close") - F.col("low"))
                                        - (F.col("high") - F.col("close"))) / span), F.lit(0.0))
    st = df.select("symbol", "d", F.row_number().over(w).alias("_i"), signed.alias("_sv"),
                   (clv * F.col("volume")).alias("_av"))
    run = w.rowsBetween(UNBOUNDED, 0)
    st = st.select("symbol", "_i", F.sum("_sv").over(run).alias("_obv"), F.sum("_av").over(run).alias("_adl"))
    return st.groupBy("symbol").agg(F.regr_slope("_obv", "_i").alias("obv_slope"),
                                    F.regr_slope("_adl", "_i").alias("adl_slope"))


def price_profile(df: DataFrame, half_year: int = 126) -> DataFrame:
    """Per-symbol facts at the last bar that several scores share, in one pass.

    Bars are numbered backwards once; every look-back is a condition on that number, so the
    proximity, slope, moving-average and momentum inputs come from a single aggregate.
    """
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    st = df.select("symbol", "close", rn.alias("rn"))
    c, n = F.col("close"), F.col("rn")
    first_in_year = F.max_by("close", F.when(n <= TRADING_DAYS, n))
    agg = st.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), F.max("close").alias("high_close"),
        F.min_by("close", "rn").alias("last_close"), first_in_year.alias("_first"),
        F.avg(F.when(n <= 50, c)).alias("_s50"), F.avg(F.when(n <= 200, c)).alias("_s200"),
        (-F.regr_slope(F.when(n <= half_year, c), n)).alias("_slope"))
    return profile_facts(agg)


def profile_facts(agg: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The facts that follow from counts, the highest, last and first close of the year, the averages and the slope."""
    last = F.col("last_close")
    pct = F.try_divide(F.col("_s50"), F.col("_s200")) - 1
    return agg.select(
        *keys, "n_bars", "high_close", "last_close",
        clip((F.try_divide(last, F.col("high_close")) - 0.70) / 0.25, 0, 1).alias("proximity"),
        F.try_divide(F.col("_slope"), last).alias("slope_share"),
        F.when(F.col("n_bars") >= 200, F.coalesce(sigmoid(20 * pct), F.lit(0.5))).alias("ma_score"),
        F.least("n_bars", F.lit(TRADING_DAYS)).alias("n_used"),
        F.when(F.col("n_bars") >= 180, F.try_divide(last, F.col("_first")) - 1).alias("momentum_12m"))


def high_proximity(df: DataFrame) -> DataFrame:
    """How close the last close is to the highest close: 0 at 70 percent, 1 at 95 percent."""
    return price_profile(df).select("symbol", "n_bars", "high_close", "last_close", "proximity")


def _trend_score() -> Column:
    sign = F.when(F.col("plus_di") > F.col("minus_di"), 1.0).otherwise(-1.0)
    return tanh01(sign * F.col("adx") / 100 * F.col("slope_share") * TRADING_DAYS)


def trend_strength(df: DataFrame, bars_back: int = 126) -> DataFrame:
    """Half-year slope times ADX with the direction's sign, squeezed into 0..1."""
    st = price_profile(df, bars_back).join(true_adx(df, bars_back), "symbol")
    return st.select("symbol", "adx", "plus_di", "minus_di", "slope_share", _trend_score().alias("trend_score"))


def ma_score(df: DataFrame) -> DataFrame:
    """Sigmoid of SMA 50 over SMA 200 at the last bar (0.5 when SMA 200 is zero)."""
    return price_profile(df).select("symbol", "ma_score")


def technical_score(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """0.35 proximity + 0.40 trend + 0.25 moving-average score; 0 under 200 bars.

    Keeps the profile's columns, so one call also yields the 12-month momentum.
    """
    return with_technical((price_profile(df) if profile is None else profile).join(true_adx(df), "symbol", "left"))


def with_technical(st: DataFrame) -> DataFrame:
    """The score from the facts of the profile and the ADX of the same row."""
    raw = (0.35 * F.col("proximity") + 0.40 * F.coalesce(_trend_score(), F.lit(0.0))
           + 0.25 * F.coalesce("ma_score", F.lit(0.5)))
    return st.withColumn("technical", F.when(F.col("n_bars") < 200, 0.0).otherwise(raw))


def year_momentum(df: DataFrame) -> DataFrame:
    """Last close over the close 251 bars earlier; the whole span for 180 to 251 bars."""
    return price_profile(df).select("symbol", "n_used", "momentum_12m")


def reversion_features(df: DataFrame, x: str = "score", lookback: int = 20) -> DataFrame:
    """Twelve mean-reversion features over the last 21 rows, for rows with a full window."""
    w = by_symbol()
    c = F.col(x)
    f = w.rowsBetween(-lookback, 0)
    f10, f20 = w.rowsBetween(-9, 0), w.rowsBetween(-19, 0)
    st = df.select("symbol", "d", c.alias("x"), F.row_number().over(w).alias("i"),
                   (c - F.lag(c).over(w)).alias("dx"), F.lag(c, 4).over(w).alias("x4"),
                   F.lag(c, 9).over(w).alias("x9"))
    dirn = F.when(F.col("dx") > 0, 1).when(F.col("dx") < 0, -1).otherwise(0)
    st = st.withColumn("dirn", dirn)
    run = F.sum(F.when(F.col("dirn") == F.lag("dirn").over(w), 0).otherwise(1)).over(
        w.rowsBetween(UNBOUNDED, 0))
    st = st.withColumn("_run", run)
    in_run = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("d"))
    st = st.withColumn("_len", F.least(in_run, F.lit(9))).withColumn("_lag", F.lag("x").over(w))
    x_, x4, x9, dx = F.col("x"), F.col("x4"), F.col("x9"), F.col("dx")
    # 20 differences lie inside a window of 21 values
    diffs = w.rowsBetween(-(lookback - 1), 0)
    avg_gain = F.avg(F.greatest(dx, F.lit(0.0))).over(diffs)
    avg_loss = F.avg(F.greatest(-dx, F.lit(0.0))).over(diffs)

    def z(frame):
        sd = F.stddev_pop("x").over(frame)
        return (x_ - F.avg("x").over(frame)) / F.when(sd > 0, sd).otherwise(1.0)

    def change(a, b):
        return F.coalesce(F.try_divide(a - b, b), F.lit(0.0))
    hi, lo = F.max("x").over(f20), F.min("x").over(f20)
    r2 = F.pow(F.corr(F.col("x"), F.col("i").cast("double")).over(f), F.lit(2.0))
    speed = F.corr(F.col("_lag"), dx).over(diffs)
    return st.select(
        "symbol", "d", "i", x_.alias("current"),
        z(f10).alias("z_10"), z(f).alias("z_20"),
        (F.abs(change(x_, x4)) - F.abs(change(x4, x9))).alias("momentum_decay"),
        F.when(avg_loss > 0, 100 - 100 / (1 + F.try_divide(avg_gain, avg_loss))).otherwise(50.0).alias("rsi_proxy"),
        (change(x_, x4) * 100).alias("roc_5"), (change(x_, x9) * 100).alias("roc_10"),
        F.stddev_pop("x").over(f10).alias("vol_10"),
        F.coalesce(F.try_divide(hi - x_, hi), F.lit(0.0)).alias("from_high"),
        F.coalesce(F.try_divide(x_ - lo, lo), F.lit(0.0)).alias("from_low"),
        # a constant window is fitted perfectly
        F.coalesce(r2, F.lit(1.0)).alias("trend_r2"),
        F.when(F.col("dirn") > 0, F.col("_len")).when(F.col("dirn") < 0, -F.col("_len"))
        .otherwise(F.lit(-1) - F.least(F.coalesce(F.lag(F.when(F.col("dirn") < 0, F.col("_len"))).over(w),
                                                  F.lit(0)), F.lit(8))).alias("consecutive"),
        F.coalesce(-speed, F.lit(0.0)).alias("reversion_speed")
    ).where(F.col("i") > lookback)


def reversion_label(df: DataFrame, x: str = "score", lookback: int = 20, horizon: int = 10,
                    threshold: float = 0.05) -> DataFrame:
    """1 when the series reverts by the threshold within the horizon; full frames only."""
    w = by_symbol()
    c = F.col(x)
    past, ahead = w.rowsBetween(-lookback, -1), w.rowsBetween(1, horizon)
    st = df.select("symbol", "d", c.alias("x"), F.row_number().over(w).alias("i"),
                   F.avg(c).over(past).alias("_mean"), F.min(c).over(ahead).alias("_lo"),
                   F.max(c).over(ahead).alias("_hi"), F.count(c).over(ahead).alias("_ahead"))
    drop = F.try_divide(F.col("x") - F.col("_lo"), F.col("x"))
    rise = F.when(F.col("x") > 0, (F.col("_hi") - F.col("x")) / F.col("x")).otherwise(0.0)
    hit = F.when(F.col("x") > F.col("_mean"), drop >= threshold).otherwise(rise >= threshold)
    return (st.where((F.col("i") > lookback) & (F.col("_ahead") == horizon))
            .select("symbol", "d", F.coalesce(hit, F.lit(False)).cast("int").alias("reverted")))


def recovery_times(df: DataFrame, min_drawdown: float = 0.05, near_peak: float = 0.99,
                   skip_last: int = 20) -> DataFrame:
    """Bars until each deep-drawdown bar regains 99 percent of its peak (null if never).

    All bars under one running peak share a threshold, so the first later bar that reaches
    it is either inside that plateau or the start of the next one: two reverse running
    minima instead of a self-join.
    """
    w = by_symbol()
    st = df.select("symbol", "d", "close", F.row_number().over(w).alias("i"),
                   F.max("close").over(w.rowsBetween(UNBOUNDED, 0)).alias("peak"),
                   F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    st = regained(st, near_peak).withColumn("dd", 1 - F.col("close") / F.col("peak"))
    return st.where(F.col("dd") > min_drawdown).select(
        "symbol", "d", "dd", (F.col("_back") - F.col("i")).alias("bars_to_recover"),
        (F.col("i") <= F.col("n") - skip_last + 1).alias("counted"))


def regained(st: DataFrame, near_peak: float = 0.99, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``_back``: number of the first later bar that reaches ``near_peak`` of a bar's running peak. Rows (*keys, close, i, peak)."""
    w = by_symbol(keys, ("i",))
    new_peak = F.coalesce(F.col("peak") > F.lag("peak").over(w), F.lit(True))
    st = st.withColumn("_new", new_peak)
    st = st.withColumn("_plateau", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(UNBOUNDED, 0)))
    later = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(UNBOUNDED, -1)
    later_in = Window.partitionBy(*keys, "_plateau").orderBy(F.desc("i")).rowsBetween(UNBOUNDED, -1)
    back = F.coalesce(
        F.min(F.when(F.col("close") >= near_peak * F.col("peak"), F.col("i"))).over(later_in),
        F.min(F.when(F.col("_new"), F.col("i"))).over(later))
    return st.withColumn("_back", back).drop("_new", "_plateau")


def recovery_score(df: DataFrame) -> DataFrame:
    n = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    t = recovery_times(df)
    used = F.col("counted") & F.col("bars_to_recover").isNotNull()
    agg = t.groupBy("symbol").agg(
        F.sum(F.when(used, F.col("dd"))).alias("_w"),
        F.sum(F.when(used, F.col("dd") * F.col("bars_to_recover"))).alias("_wt"),
        F.count(F.lit(1)).alias("deep_bars"))
    mean = F.try_divide(F.col("_wt"), F.col("_w"))
    st = n.join(agg, "symbol", "left").withColumns({"deep_bars": F.coalesce("deep_bars", F.lit(0)), "mean_bars_to_recover": mean})
    return st.select("symbol", "n_bars", "deep_bars", "mean_bars_to_recover", recovery_column().alias("recovery"))


def recovery_column() -> Column:
    """From ``n_bars``, ``deep_bars`` and ``mean_bars_to_recover`` (null: none of the deep bars recovered)."""
    mean = F.col("mean_bars_to_recover")
    return (F.when(F.col("n_bars") < 126, 0.5).when(F.col("deep_bars") == 0, 0.8)
            .when(mean.isNull(), 0.3).otherwise(clip(1 - (mean - 10) / 50, 0, 1)))
