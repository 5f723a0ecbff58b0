"""Score-history trends: regressions, stability composites, forecasts, technical scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import clip, sigmoid
from factorspark.functions.windows import by_symbol, last_rows
from factorspark.operators import indicators as ind


def snapshot_sequence(hist: DataFrame) -> DataFrame:
    """Dense number ``seq`` of each snapshot date over all symbols, from 0.

    The dates are reduced to the distinct ones first (one row per calendar day at most), so
    the unpartitioned window is bounded by the calendar.
    """
    days = hist.select("d").distinct()
    seq = days.withColumn("seq", F.row_number().over(Window.orderBy("d")) - 1)
    return hist.join(seq, "d")


def score_regressions(hist: DataFrame) -> DataFrame:
    """Linear and quadratic fit of score on sequence number per symbol, with moments.

    The quadratic fit uses a regressor made orthogonal to the linear one, so its R2 is the
    linear R2 plus one more squared correlation; all sums are plain aggregates.
    """
    sym = Window.partitionBy("symbol")
    mean = F.avg("seq").over(sym)
    st = hist.select("symbol", "seq", "score", (F.col("seq") - mean).alias("u"), mean.alias("_ms"))
    st = st.withColumn("v", F.col("u") * F.col("u"))
    agg = st.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("appearances"), F.max("seq").alias("last_seq"), F.first("_ms").alias("_ms"),
        F.avg("score").alias("_my"), F.avg("v").alias("_mv"),
        F.regr_slope("score", "seq").alias("linear_slope"),
        F.regr_intercept("score", "seq").alias("linear_intercept"),
        F.regr_r2("score", "seq").alias("linear_r2"),
        F.covar_pop("score", "u").alias("_yu"), F.covar_pop("score", "v").alias("_yv"),
        F.covar_pop("u", "v").alias("_uv"), F.var_pop("u").alias("_uu"), F.var_pop("v").alias("_vv"),
        F.var_pop("score").alias("_yy"))
    b = F.try_divide(F.col("_uv"), F.col("_uu"))
    agg = agg.withColumn("_b", b).withColumn("_c1", F.try_divide(F.col("_yu"), F.col("_uu")))
    y_perp = F.col("_yv") - F.col("_b") * F.col("_yu")
    v_perp = F.col("_vv") - F.col("_b") * F.col("_uv")
    agg = agg.withColumn("_c2", F.when(v_perp > 1e-9, y_perp / v_perp).otherwise(0.0)).withColumn("_yp", y_perp)
    quad = F.try_divide(F.col("_c1") * F.col("_yu") + F.col("_c2") * F.col("_yp"), F.col("_yy"))
    return agg.withColumn("quadratic_r2", F.coalesce(quad, F.lit(1.0)))


REGRESSION_COLS = ("appearances", "linear_slope", "linear_intercept", "linear_r2", "quadratic_r2")


def extrapolate(reg: DataFrame, steps: int = 5) -> DataFrame:
    """Linear and quadratic predictions for the next ``steps`` sequence numbers."""
    ahead = reg.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x = F.col("last_seq") + F.col("step")
    u = x - F.col("_ms")
    quad = F.col("_my") + F.col("_c1") * u + F.col("_c2") * (u * u - F.col("_mv") - F.col("_b") * u)
    return ahead.select("symbol", "step", (F.col("linear_intercept") + F.col("linear_slope") * x).alias("linear_pred"),
                        quad.alias("quadratic_pred"))


def score_stability(hist: DataFrame) -> DataFrame:
    """Dispersion and direction of each symbol's scores and ranks (population deviations)."""
    w = by_symbol(order=("seq",))
    ds, dr = F.col("score") - F.lag("score").over(w), F.col("rank") - F.lag("rank").over(w)
    st = hist.select("symbol", "score", "rank", ds.alias("ds"), dr.alias("dr"))
    agg = st.groupBy("symbol").agg(
        F.avg("score").alias("avg_score"), F.avg("rank").alias("avg_rank"),
        F.stddev_pop("score").alias("score_std"), F.stddev_pop("rank").alias("rank_std"),
        F.coalesce(F.max(F.abs("ds")), F.lit(0.0)).alias("max_score_change"),
        F.coalesce(F.max(F.abs("dr")), F.lit(0)).alias("max_rank_change"),
        (F.max("score") - F.min("score")).alias("score_range"),
        F.sum(F.when(F.col("ds") > 0, 1).otherwise(0)).alias("_up"),
        F.sum(F.when(F.col("ds") < 0, 1).otherwise(0)).alias("_down"), F.count("ds").alias("_n"))
    inf = F.lit(float("inf"))
    return (agg.withColumn("score_cv", F.when(F.col("avg_score") > 0, F.col("score_std") / F.col("avg_score")).otherwise(inf))
            .withColumn("trend_consistency", F.coalesce(F.try_divide(F.abs(F.col("_up") - F.col("_down")), F.col("_n")),
                                                        F.lit(0.0))).drop("_up", "_down", "_n"))


def stability_table(hist: DataFrame, min_appearances: int = 5, sensitivity: float = 5.0) -> DataFrame:
    """Stability composites and recommendation for symbols with enough appearances."""
    st = (score_regressions(hist).where(F.col("appearances") >= min_appearances)
          .join(score_stability(hist), "symbol"))
    slope, r2 = F.col("linear_slope"), F.col("linear_r2")
    bonus = F.when((slope > 0) & (r2 > 0.5), F.least(slope * 1000, F.lit(20.0))).otherwise(0.0)
    comp = r2 * 30 + F.greatest(30 - F.col("score_cv") * 100, F.lit(0.0)) + F.col("trend_consistency") * 20 + bonus
    st = (st.withColumn("stability_score", clip(comp, 0, 100))
          .withColumn("r2_adjusted_score", F.col("avg_score") * r2)
          .withColumn("slope_adjusted_score", F.col("r2_adjusted_score") * (0.5 + sigmoid(sensitivity * slope)))
          .withColumn("stability_adjusted_score", F.col("slope_adjusted_score") / (1 + F.col("score_std"))))
    return st.withColumn("recommendation", stability_recommendation())


def stability_recommendation() -> Column:
    """First matching rule in order, over the stability columns."""
    adj, avg, r2 = F.col("stability_adjusted_score"), F.col("avg_score"), F.col("linear_r2")
    slope, std = F.col("linear_slope"), F.col("score_std")
    # fixed values: rule thresholds and labels
    return (F.when((adj >= 50) & (slope > 0.3) & (r2 > 0.7), "STRONG BUY - Elite performer")
            .when((adj >= 45) & (slope > 0.2) & (r2 > 0.6), "STRONG BUY - High conviction")
            .when((adj >= 40) & (slope > 0.4) & (r2 > 0.5), "STRONG BUY - Strong momentum")
            .when((adj >= 38) & (slope > 0.1) & (r2 > 0.5), "BUY - Quality growth")
            .when((adj >= 35) & (std < 5) & (avg > 55), "BUY - Stable quality")
            .when((avg >= 65) & (adj >= 32), "BUY - High score acceptable risk")
            .when((adj >= 33) & (slope > 0.05) & (r2 > 0.4), "BUY - Consistent performer")
            .when((slope > 0.5) & (adj >= 28), "SPECULATIVE BUY - Strong momentum")
            .when((slope > 0.3) & (adj >= 25) & (avg > 50), "SPECULATIVE BUY - Recovery candidate")
            .when((adj >= 30) & (F.abs(slope) < 0.1), "HOLD - Stable but flat")
            .when((adj >= 28) & (slope > 0), "HOLD - Modest potential")
            .when((avg >= 50) & (adj >= 25), "HOLD - Good fundamentals")
            .when((adj >= 25) & (adj < 28), "HOLD - Needs monitoring")
            .when((slope < -0.5) & (r2 > 0.7), "SELL - Reliable downtrend")
            .when((slope < -0.2) & (adj < 25), "REDUCE - Weakening position")
            .when((slope < -0.1) & (avg < 45), "REDUCE - Weak momentum")
            .when(std > 15, "AVOID - Too volatile")
            .when(adj < 20, "AVOID - Poor risk-adjusted score")
            .when(avg < 35, "AVOID - Weak fundamentals")
            .when((slope < -0.3) & (r2 > 0.5), "AVOID - Strong downtrend")
            .otherwise("WATCH - Monitor for opportunity"))


def with_company(stab: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach company attributes, 'Unknown' where the company is missing."""
    j = stab.join(companies.select("symbol", "company_name", "sector", "industry"), "symbol", "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("company_name", "sector", "industry")})


def forecast_horizon(n: Column) -> Column:
    return F.least(F.greatest(F.floor(n / 10), F.lit(1)), F.lit(30)).cast("int")


def holt_forecast(hist: DataFrame, grid: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9),
                  min_points: int = 10) -> DataFrame:
    """Additive-trend smoothing: best (alpha, beta) of a grid by squared error, then forecast.

    A series is one value per snapshot date, so the folded array is bounded by the calendar.
    """
    series = hist.groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "score"))), lambda s: s["score"]).alias("y"))
    series = series.where(F.size("y") >= min_points)
    pairs = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in grid for b in grid])
    g = series.withColumn("p", F.explode(pairs)).select("symbol", "y", "p.alpha", "p.beta")

    def step(acc, x):
        pred = acc["level"] + acc["trend"]
        level = F.col("alpha") * x + (1 - F.col("alpha")) * pred
        trend = F.col("beta") * (level - acc["level"]) + (1 - F.col("beta")) * acc["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"),
                        (acc["sse"] + (x - pred) * (x - pred)).alias("sse"))
    y = F.col("y")
    start = F.struct(y[0].alias("level"), (y[1] - y[0]).alias("trend"), F.lit(0.0).alias("sse"))
    fit = F.aggregate(F.slice(y, F.lit(2), F.size(y) - 1), start, step)
    g = g.select("symbol", "alpha", "beta", F.size(y).alias("n"), fit.alias("fit"))
    best = g.groupBy("symbol").agg(
        F.min_by(F.struct("alpha", "beta", "n", "fit"), F.struct("fit.sse", "alpha", "beta")).alias("b"))
    out = best.select("symbol", "b.alpha", "b.beta", "b.n", "b.fit.*")
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), forecast_horizon(F.col("n")))))
    return out.select("symbol", "alpha", "beta", "sse", "step",
                      (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"))


def ar_forecast(hist: DataFrame, min_points: int = 10) -> DataFrame:
    """Autoregression of order 0, 1 or 2 with a constant, chosen by AIC, then forecast.

    All three orders are fitted on the same rows (those with two lags) from covariances, so
    one grouped aggregate serves them.
    """
    w = by_symbol(order=("seq",))
    st = hist.select("symbol", "seq", F.col("score").alias("y"), F.lag("score", 1).over(w).alias("a"),
                     F.lag("score", 2).over(w).alias("b"))
    full = st.where(F.col("b").isNotNull())
    m = full.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("m"), F.max_by("y", "seq").alias("y1"), F.max_by("a", "seq").alias("y2"),
        F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.var_pop("y").alias("yy"), F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"),
        F.covar_pop("y", "a").alias("ya"), F.covar_pop("y", "b").alias("yb"), F.covar_pop("a", "b").alias("ab"))
    m = m.where(F.col("m") + 2 >= min_points)
    c = F.col
    det = c("aa") * c("bb") - c("ab") * c("ab")
    m = (m.withColumn("p1", F.try_divide(c("ya"), c("aa")))
         .withColumn("q1", F.try_divide(c("ya") * c("bb") - c("yb") * c("ab"), det))
         .withColumn("q2", F.try_divide(c("yb") * c("aa") - c("ya") * c("ab"), det)))

    def aic(sse, k):
        return F.when(sse > 0, c("m") * F.log(sse) + 2.0 * k)
    zero = F.lit(0.0)
    cand = F.array(
        F.struct(aic(c("yy"), 1).alias("aic"), F.lit(0).alias("order"), zero.alias("f1"), zero.alias("f2")),
        F.struct(aic(c("yy") - c("p1") * c("ya"), 2).alias("aic"), F.lit(1).alias("order"),
                 c("p1").alias("f1"), zero.alias("f2")),
        F.struct(aic(c("yy") - c("q1") * c("ya") - c("q2") * c("yb"), 3).alias("aic"), F.lit(2).alias("order"),
                 c("q1").alias("f1"), c("q2").alias("f2")))
    m = m.withColumn("best", F.array_min(F.filter(cand, lambda s: s["aic"].isNotNull())))
    m = m.where(F.col("best").isNotNull()).select(
        "symbol", "m", "y1", "y2", "best.*",
        (c("my") - c("best.f1") * c("ma") - c("best.f2") * c("mb")).alias("const"))
    h = forecast_horizon(c("m") + 2)

    def roll(acc, _):
        nxt = c("const") + c("f1") * acc["l1"] + c("f2") * acc["l2"]
        return F.struct(nxt.alias("l1"), acc["l1"].alias("l2"), F.array_append(acc["path"], nxt).alias("path"))
    path = F.aggregate(F.sequence(F.lit(1), h), F.struct(
        c("y1").alias("l1"), c("y2").alias("l2"), F.array().cast("array<double>").alias("path")), roll)["path"]
    return m.select("symbol", "order", "aic", F.posexplode(path).alias("step", "forecast")).withColumn(
        "step", F.col("step") + 1)


def scorecard_inputs(hist: DataFrame) -> DataFrame:
    """Latest indicator readings per symbol that the scorecard rules look at."""
    x = hist.select("symbol", "d", "score")
    st = ind.moving_averages(x, "score", (5, 10))
    st = ind.sma_cross(st.drop("sma_5", "sma_10"), "score")
    st = ind.macd(st, "score")
    st = ind.rsi(st, "score")
    st = ind.momentum_changes(st, "score", (10,)).withColumn("roc", F.col("chg_10") * 100).drop("chg_10")
    st = ind.bollinger(st, "score")
    st = ind.series_adx(st, "score")
    w = by_symbol()
    st = st.withColumn("hist_up", F.col("macd_hist") > F.lag("macd_hist").over(w))
    st = st.withColumn("velocity", F.col("score") - F.lag("score").over(w))
    st = st.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))
    st = st.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    st = last_rows(st, 5)
    rn = F.col("rn")

    def latest(c):
        return F.max(F.when(rn == 1, F.col(c)))

    def mean3(c):
        return F.avg(F.when(rn <= 3, F.col(c)))

    def slope5(c):
        return F.when(F.count(c) >= 3, -F.regr_slope(c, "rn"))
    return st.groupBy("symbol").agg(
        F.max("n").alias("n"), latest("score").alias("score"), latest("sma_5").alias("sma_5"),
        latest("sma_10").alias("sma_10"),
        F.max((F.col("cross_signal") == "bullish").cast("int")).alias("bull5"),
        F.max((F.col("cross_signal") == "bearish").cast("int")).alias("bear5"),
        latest("macd").alias("macd"), latest("macd_signal").alias("macd_signal"),
        latest("macd_hist").alias("macd_hist"), F.count("macd_hist").alias("n_hist"),
        F.min(F.when(rn <= 4, F.col("hist_up").cast("int"))).alias("hist_rising"),
        mean3("rsi").alias("rsi3"), slope5("rsi").alias("rsi_slope"), mean3("roc").alias("roc3"),
        mean3("percent_b").alias("pb3"), slope5("bandwidth").alias("bw_slope"),
        mean3("adx").alias("adx3"), F.avg("adx").alias("adx5"),
        mean3("plus_di").alias("pdi3"), mean3("minus_di").alias("mdi3"),
        mean3("velocity").alias("velocity"), mean3("acceleration").alias("acceleration"))


def technical_scorecard(inputs: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Rules as ``array<struct<rule, points, max_points>>``; rules without input drop out.

    ``optional`` names the extra columns present in ``inputs``: ``ar_next``, ``holt_next``
    (next forecasts), ``reversion_prob`` with ``cv_accuracy``, ``flow`` and ``insider``
    (0..1 sentiments).
    """
    c = F.col
    s = c("score")

    def pts(*cases, default=0.0):
        out = None
        for cond, p in cases:
            out = F.when(cond, float(p)) if out is None else out.when(cond, float(p))
        return out.otherwise(float(default))
    n10 = c("n") >= 10
    rules = [
        ("trend", c("linear_slope").isNotNull(), pts((c("linear_slope") > 0.5, 1), (c("linear_slope") > 0, 0.5)), 1.0),
        ("trend_quality", c("linear_r2").isNotNull(), pts((c("linear_r2") > 0.7, 1), (c("linear_r2") > 0.4, 0.5)), 1.0),
        ("sma_position", n10, pts(((s > c("sma_5")) & (c("sma_5") > c("sma_10")), 1),
                                  ((s > c("sma_5")) | (s > c("sma_10")), 0.5)), 1.0),
        ("recent_cross", n10, pts((c("bull5") == 1, 1), (c("bear5") == 1, 0), default=0.3), 1.0),
        ("macd", c("macd_signal").isNotNull(), pts((c("macd") > c("macd_signal"), 1)), 1.0),
        ("macd_histogram", c("n_hist") >= 3, pts((c("hist_rising") == 1, 1), (c("macd_hist") > 0, 0.5)), 1.0),
        ("rsi_level", c("rsi3").isNotNull(), pts((c("rsi3").between(40, 60), 0.5), (c("rsi3") > 60, 1)), 1.0),
        ("rsi_trend", c("rsi_slope").isNotNull(), pts((c("rsi_slope") > 2, 1), (c("rsi_slope") > -2, 0.5)), 1.0),
        ("rate_of_change", c("roc3").isNotNull(), pts((c("roc3") > 5, 1), (c("roc3") > 0, 0.5)), 1.0),
        ("band_position", c("pb3").isNotNull(), pts((c("pb3").between(0.5, 0.8), 1), (c("pb3").between(0.2, 0.9), 0.5)), 1.0),
        ("band_width", c("bw_slope").isNotNull(), pts((c("bw_slope") < 0, 0.5), default=0.3), 1.0),
        ("adx_strength", c("adx3").isNotNull(), pts((c("adx3") > 40, 1), (c("adx3") > 25, 0.5)), 1.0),
        ("direction", c("pdi3").isNotNull() & c("mdi3").isNotNull(), pts((c("pdi3") > c("mdi3"), 1)), 1.0),
    ]
    if "ar_next" in optional:
        rules.append(("ar_forecast", c("ar_next").isNotNull(), pts((c("ar_next") > s, 1)), 1.0))
    if "holt_next" in optional:
        rules.append(("smoothing_forecast", c("holt_next").isNotNull(), pts((c("holt_next") > s, 1)), 1.0))
    if "reversion_prob" in optional:
        p = c("reversion_prob")
        rules.append(("reversion_risk", p.isNotNull(), F.when(c("cv_accuracy") < 0.55, 0.3).otherwise(
            pts((p < 0.3, 1), (p < 0.5, 0.5), (p < 0.7, 0.3))), 1.0))
    v, a = c("velocity"), c("acceleration")
    rules.append(("acceleration", (c("n") >= 4), pts(
        ((v > 0.1) & (a > 0.05), 1.5), ((v > 0.1) & (a < -0.05), 0.5), ((v < -0.1) & (a > 0.05), 0.3),
        ((v < -0.1) & (a < -0.05), 0), default=0.7), 1.5))
    mood = []
    if "flow" in optional:
        f = c("flow")
        mood.append(("options_flow", f.isNotNull(), pts((f > 0.7, 1), (f > 0.55, 0.5), (f >= 0.45, 0), (f >= 0.3, -0.5),
                                                        default=-1), 1.0))
    if "insider" in optional:
        i = c("insider")
        mood.append(("insider", i.isNotNull(), pts((i > 0.6, 1), (i > 0.55, 0.5), (i >= 0.45, 0), (i >= 0.4, -0.5),
                                                   default=-1), 1.0))

    def pack(items):
        arr = F.array(*[F.when(ok, F.struct(F.lit(nm).alias("rule"), p.alias("points"), F.lit(mx).alias("max_points")))
                        for nm, ok, p, mx in items])
        return F.filter(arr, lambda z: z.isNotNull())
    empty = F.array().cast("array<struct<rule:string,points:double,max_points:double>>")
    out = inputs.withColumn("rules", pack(rules)).withColumn("mood", pack(mood) if mood else empty)

    def total(arr, field):
        return F.aggregate(F.col(arr), F.lit(0.0), lambda acc, z: acc + z[field])

    def percent(p, m):
        return F.when(m > 0, p / m * 100).otherwise(0.0)
    out = (out.withColumn("technical_points", total("rules", "points")).withColumn("technical_max", total("rules", "max_points"))
           .withColumn("sentiment_points", total("mood", "points")).withColumn("sentiment_max", total("mood", "max_points")))
    pct = percent(c("technical_points") + c("sentiment_points"), c("technical_max") + c("sentiment_max"))
    out = out.withColumn("percentage", pct).withColumn(
        "technical_percentage", percent(c("technical_points"), c("technical_max"))).withColumn(
        "sentiment_percentage", percent(c("sentiment_points"), c("sentiment_max")))
    tier = (F.when(c("percentage") >= 70, "STRONG BUY").when(c("percentage") >= 55, "BUY")
            .when(c("percentage") >= 45, "HOLD").when(c("percentage") >= 30, "SELL").otherwise("STRONG SELL"))
    return out.withColumn("recommendation", tier).withColumn("details", F.concat("rules", "mood"))


def scorecard_details(card: DataFrame) -> DataFrame:
    """One row per symbol and rule."""
    return card.select("symbol", F.inline("details"))


def market_signals(inputs: DataFrame) -> DataFrame:
    """Symbols with a recent bullish or bearish cross or a strong trend, one row per signal."""
    signal = F.array_compact(F.array(
        F.when(F.col("bull5") == 1, "bullish_cross").when(F.col("bear5") == 1, "bearish_cross"),
        F.when(F.col("adx5") > 40, "strong_trend")))
    return inputs.select("symbol", F.explode(signal).alias("signal"))
