"""Factor tables per symbol: growth, carry, insider, options, stability, composite ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions import scores as sc
from factorspark.functions.exprs import add_weighted_means, clip, sigmoid
from factorspark.functions.regime_tables import FACTOR_WEIGHTS, PRESETS, REGIMES, with_factor_weights, with_thresholds
from factorspark.functions.windows import by_symbol, last_rows, simple_return
from factorspark.operators.indicators import TRADING_DAYS, recovery_score


def for_each_regime(df: DataFrame) -> DataFrame:
    """Each row once per regime (three copies)."""
    return df.withColumn("regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))


def fundamental_scores(fund: DataFrame) -> DataFrame:
    """Value, quality and financial-health scores of rows that carry a ``regime``."""
    t = sc.with_ratios(with_thresholds(fund))
    out = add_weighted_means(t, {"value": sc.value_parts(), "quality": sc.quality_parts(),
                                 "financial_health": sc.health_parts()})
    return out.drop(*[x for x in out.columns if x.startswith("_r_")])


def pivot_estimates(est: DataFrame) -> DataFrame:
    """One row per ``(symbol, as_of)`` with the current-quarter and yearly estimates."""
    def pick(period: str, col: str) -> Column:
        return F.max(F.when(F.lower("period") == period, F.col(col)))
    return est.groupBy("symbol", "as_of").agg(
        pick("0q", "earnings.avg").alias("q0_avg"), pick("0q", "earnings.d30").alias("q0_d30"),
        pick("0q", "earnings.d60").alias("q0_d60"), pick("0q", "earnings.d90").alias("q0_d90"),
        pick("0q", "revenue_growth").alias("q0_rev_growth"),
        pick("0y", "earnings.avg").alias("y0_avg"), pick("+1y", "earnings.avg").alias("y1_avg"))


def growth_scores(fund: DataFrame, est: DataFrame) -> DataFrame:
    joined = fund.join(pivot_estimates(est), ["symbol", "as_of"], "left")
    return add_weighted_means(with_thresholds(joined), {"growth": sc.growth_parts()})


def sector_relative(df: DataFrame, x: str, keys: list[str], out: str) -> DataFrame:
    """Sigmoid of the z-score within each group, z clipped to +-2.

    Group statistics come from a plain aggregate joined back (not a window), so one large
    sector is combined map-side instead of being sorted in one task.
    """
    stats = df.groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    z = (F.col(x) - F.col("_mu")) / sd
    return (df.join(stats, keys).withColumn(f"{out}_z", z)
            .withColumn(out, sigmoid(clip(F.col(f"{out}_z"), -2, 2))).drop("_mu", "_sd"))


def dividend_history(divs: DataFrame) -> DataFrame:
    """Growth rate and paying streak of yearly dividends (years without a payment are absent)."""
    yearly = (divs.groupBy("symbol", F.year("ex_date").alias("yr")).agg(F.sum("amount").alias("amt"))
              .where(F.col("amt") > 0))
    st = yearly.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("streak"), F.min("yr").alias("_y0"), F.max("yr").alias("_y1"),
        F.min_by("amt", "yr").alias("_a0"), F.max_by("amt", "yr").alias("_a1"))
    span = F.col("_y1") - F.col("_y0")
    cagr = F.when(span >= 1, F.pow(F.col("_a1") / F.col("_a0"), 1 / span) - 1)
    return st.select("symbol", cagr.alias("dividend_cagr"), "streak")


def carry_scores(fund: DataFrame, history: DataFrame) -> DataFrame:
    j = fund.join(history, "symbol", "left")
    return j.withColumn("carry", sc.carry_score(F.col("dividend_yield"), F.col("payout_ratio"),
                                                F.col("dividend_cagr"), F.col("streak")))


def earnings_momentum(est: DataFrame, surprises: DataFrame | None = None,
                      strict_period: bool = False) -> DataFrame:
    """Half estimate revision over 90 days, half mean of the last four surprises.

    ``strict_period`` accepts only the spelling ``0Q``. ``surprises(symbol, d, surprise_pct)``
    adds the second half; without it the result is null, as is a missing estimate.
    """
    period = F.col("period") if strict_period else F.upper("period")
    rev = est.where(period == "0Q").select(
        "symbol", "as_of",
        F.try_divide(F.col("earnings.avg") - F.coalesce("earnings.d90", "earnings.avg"),
                     F.abs(F.coalesce("earnings.d90", F.lit(1.0)))).alias("revision"))
    if surprises is None:
        return rev.withColumn("earnings_momentum", F.lit(None).cast("double"))
    recent = last_rows(surprises.where(F.col("surprise_pct").isNotNull()), 4)
    mean = recent.groupBy("symbol").agg(F.avg("surprise_pct").alias("_s"))
    return rev.join(mean, "symbol", "left").withColumn(
        "earnings_momentum", 0.5 * F.col("revision") + 0.5 * F.col("_s") / 100).drop("_s")


def insider_scores(tx: DataFrame, keys: list[str], as_of: Column, lookback: int = 90,
                   buy: str = "buy|purchase", sell: str = "sell|sale") -> DataFrame:
    """Net buying pressure of insiders in the ``lookback`` days up to ``as_of``.

    ``as_of`` is a column of ``tx`` rows (their scoring date). Distinct filers are counted
    by a two-step aggregate so no task holds one symbol's raw rows.
    """
    age = F.datediff(as_of, F.col("d"))
    t = F.lower("text")
    rows = tx.where((age >= 0) & (age <= lookback)).select(
        *keys, "filer", age.alias("_age"), F.coalesce(F.col("value"), F.lit(0.0)).alias("_v"),
        t.rlike(buy).alias("_b"), t.rlike(sell).alias("_s"))
    per_filer = rows.groupBy(*keys, "filer").agg(
        F.sum(F.when(F.col("_b"), F.col("_v")).otherwise(0.0)).alias("_buy"),
        F.sum(F.when(F.col("_s"), F.col("_v")).otherwise(0.0)).alias("_sell"),
        F.sum("_age").alias("_age"), F.count(F.lit(1)).alias("_n"))
    st = per_filer.groupBy(*keys).agg(
        F.sum("_buy").alias("buys"), F.sum("_sell").alias("sells"), F.count("filer").alias("filers"),
        (F.sum("_age") / F.sum("_n")).alias("mean_age"))
    total = F.col("buys") + F.col("sells")
    magnitude = F.least(F.log(total + 1) / F.log(F.lit(1e7)), F.lit(1.0))
    breadth = F.least(F.col("filers") / 5, F.lit(1.0))
    recency = 1 - F.least(F.col("mean_age"), F.lit(float(lookback))) / lookback
    raw = (2 * F.try_divide(F.col("buys"), total) - 1) * (
        0.5 + 0.2 * magnitude + 0.2 * breadth + 0.1 * recency)
    score = F.when(total > 0, clip(raw, -1, 1)).otherwise(0.0)
    return (st.withColumn("insider", score)
            .withColumn("insider_sentiment", F.when(total > 0, clip((raw + 1) / 2, 0, 1)).otherwise(0.5)))


def insider_from_records(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Variant for typed records: log1p magnitude and no recency decay.

    ``tx`` has ``kind`` (free text), ``code`` (P or S), ``value`` and ``filer``.
    """
    kind, code = F.lower("kind"), F.upper("code")
    buy = kind.rlike("buy|purchase|acquire|exercise|grant") | (code == "P")
    sell = ~F.coalesce(buy, F.lit(False)) & (kind.rlike("sell|sale|dispose") | (code == "S"))
    return _insider_variant(tx, keys, buy, sell, lambda total, filers: (
        0.5 + 0.2 * F.least(F.log1p(total) / F.log1p(F.lit(1e7)), F.lit(1.0))
        + 0.2 * F.least(filers / 5, F.lit(1.0)) + 0.1))


def insider_from_filings(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Variant for filing texts: a missing value counts as 100,000; three filers are broad."""
    text = F.lower("kind")
    buy = text.rlike("acquisition|purchase")
    sell = ~buy & text.rlike("disposition|sale")
    filled = tx.withColumn("value", F.coalesce("value", F.lit(100000.0)))
    return _insider_variant(filled, keys, buy, sell, lambda total, filers: (
        0.6 + 0.4 * F.least(filers / 3, F.lit(1.0))))


def _insider_variant(tx: DataFrame, keys: list[str], buy: Column, sell: Column, scale) -> DataFrame:
    v = F.abs(F.coalesce(F.col("value"), F.lit(0.0)))
    per_filer = tx.groupBy(*keys, "filer").agg(
        F.sum(F.when(buy, v).otherwise(0.0)).alias("_buy"), F.sum(F.when(sell, v).otherwise(0.0)).alias("_sell"))
    st = per_filer.groupBy(*keys).agg(F.sum("_buy").alias("buys"), F.sum("_sell").alias("sells"),
                                      F.count("filer").alias("filers"))
    total = F.col("buys") + F.col("sells")
    raw = (2 * F.try_divide(F.col("buys"), total) - 1) * scale(total, F.col("filers"))
    return st.withColumn("insider", F.when(total > 0, clip(raw, -1, 1)).otherwise(0.0))


def tail_measures(bars: DataFrame) -> DataFrame:
    """Volatility, 95 percent expected shortfall, 30-day deviation and drawdown-at-risk."""
    w = by_symbol()
    r = bars.select("symbol", "d", simple_return(F.col("close"), w).alias("ret"),
                    F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))).alias("rn"))
    base = r.groupBy("symbol").agg(
        F.avg("ret").alias("_mu"), F.stddev_samp("ret").alias("_sd"),
        F.stddev_samp(F.when(F.col("rn") <= 30, F.col("ret"))).alias("std_30"),
        F.count("ret").alias("n_returns"))
    year = last_rows(bars.select("symbol", "d", "close"), TRADING_DAYS)
    dd = year.select("symbol", (1 - F.col("close") / F.max("close").over(
        w.rowsBetween(Window.unboundedPreceding, 0))).alias("dd"))
    cut = dd.groupBy("symbol").agg(F.percentile("dd", F.lit(0.95)).alias("_cut"))
    cdar = (dd.join(cut, "symbol").where(F.col("dd") >= F.col("_cut"))
            .groupBy("symbol").agg(F.avg("dd").alias("cdar")))
    volatility, cvar = tail_columns()
    return base.join(cdar, "symbol").select("symbol", "n_returns", "std_30", volatility, cvar, "cdar")


def tail_columns() -> tuple[Column, Column]:
    """Volatility and expected shortfall from the mean ``_mu`` and deviation ``_sd`` of daily returns."""
    return ((F.col("_sd") * TRADING_DAYS ** 0.5).alias("volatility"),
            F.abs(F.least(F.col("_mu") - 2.06 * F.col("_sd"), F.lit(0.0))).alias("cvar"))


def beta_scores(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Beta to the market on common dates; 1.0 as score with 60 common dates or fewer."""
    w = by_symbol()
    r = bars.select("symbol", "d", simple_return(F.col("close"), w).alias("ret")).where("ret is not null")
    m = market.select("symbol", "d", simple_return(F.col("close"), w).alias("mret")).where(
        "mret is not null").select("d", "mret")
    st = r.join(m, "d").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_common"), F.covar_samp("ret", "mret").alias("_c"),
        F.var_pop("mret").alias("_v"))
    beta, score = beta_columns()
    return st.withColumn("beta", beta).select("symbol", "n_common", "beta", score.alias("beta_score"))


def beta_columns() -> tuple[Column, Column]:
    """Beta from ``_c`` and ``_v``, and its score from ``beta`` and ``n_common``."""
    score = F.when(F.col("n_common") > 60, 1 - F.tanh(2 * F.greatest(F.col("beta") - 1, F.lit(0.0)))).otherwise(1.0)
    return F.coalesce(F.try_divide(F.col("_c"), F.col("_v")), F.lit(1.0)), score


def stability_factor(bars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """0.3 volatility + 0.3 tail + 0.2 recovery + 0.2 beta score; the penalty is score - 1."""
    st = tail_measures(bars).join(recovery_score(bars).select("symbol", "recovery"), "symbol")
    if market is None:
        st = st.withColumn("beta_score", F.lit(1.0))
    else:
        st = st.join(beta_scores(bars, market).select("symbol", "beta_score"), "symbol", "left").withColumn(
            "beta_score", F.coalesce("beta_score", F.lit(1.0)))
    return with_stability(st)


def with_stability(st: DataFrame) -> DataFrame:
    """Score and penalty from ``volatility``, ``cvar``, ``cdar``, ``recovery`` and ``beta_score``."""
    score = (0.3 * (1 - F.tanh(2 * F.col("volatility")))
             + 0.3 * (1 - F.tanh(4 * F.greatest("cvar", "cdar")))
             + 0.2 * F.col("recovery") + 0.2 * F.col("beta_score"))
    return st.withColumn("stability", score).withColumn("risk_penalty", -(1 - F.col("stability")))


def composite_score(df: DataFrame, weights: dict[str, tuple] | None = None, preset: str | None = None) -> DataFrame:
    """Weighted sum of the factor columns with the weights of each row's regime, or with those of a named preset.

    A preset's ``volatility_penalty`` comes from ``stability`` and its ``credit``, for which there is no data, is neutral.
    """
    if preset is not None:
        weights = PRESETS[preset]
        df = df.withColumns({"volatility_penalty": 1 - F.col("stability"), "credit": F.lit(0.0)})
    listed = weights or FACTOR_WEIGHTS
    t = with_factor_weights(df, weights)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0.0)) * F.col(f"w_{f}") for f in listed])
    return t.withColumn("score", total).drop(*[f"w_{f}" for f in listed])


def chain_score(contracts: DataFrame, keys: list[str], detail: bool = False) -> DataFrame:
    """Put/call positioning of one option-chain snapshot per key, 0.5 when too thin.

    ``contracts`` carries ``kind`` (C or P), ``strike``, ``oi``, ``volume`` and ``price`` (the
    underlying). Both passes are plain aggregates: per-key mean and deviation first, joined
    back for the large-position test. ``detail`` switches to volumes where open interest is
    too thin to judge.
    """
    rows = contracts.where((F.col("price") > 0) & F.col("strike").isNotNull() & F.col("oi").isNotNull()).select(
        *keys, "kind", F.col("oi").cast("double").alias("oi"),
        F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("vol"),
        (F.col("strike") / F.col("price")).between(0.90, 1.10).alias("near"))
    n_all = contracts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_contracts"))
    rows = rows.where((F.col("oi") > 0) | (F.col("vol") > 0))
    call, put, near = F.col("kind") == "C", F.col("kind") == "P", F.col("near")

    def total(cond, x):
        return F.sum(F.when(cond, F.col(x)).otherwise(0.0))
    base = rows.groupBy(*keys).agg(
        F.sum(call.cast("long")).alias("n_calls"), F.sum(put.cast("long")).alias("n_puts"),
        total(call, "oi").alias("call_oi"), total(put, "oi").alias("put_oi"),
        total(call, "vol").alias("call_vol"), total(put, "vol").alias("put_vol"),
        total(call & near, "oi").alias("near_call_oi"), total(put & near, "oi").alias("near_put_oi"),
        total(call & near, "vol").alias("near_call_vol"), total(put & near, "vol").alias("near_put_vol"),
        F.avg("oi").alias("_mo"), F.stddev_pop("oi").alias("_so"),
        F.avg("vol").alias("_mv"), F.stddev_pop("vol").alias("_sv"))
    by_vol = F.col("_mo") < 10 if detail else F.lit(False)
    cut = F.when(by_vol, F.when(F.col("_sv") > 0, F.col("_mv") + F.col("_sv")).otherwise(F.col("_mv") * 1.5)
                 ).otherwise(F.when(F.col("_so") > 0, F.col("_mo") + 2 * F.col("_so")).otherwise(F.col("_mo") * 2))
    base = base.withColumn("_cut", cut).withColumn("_by_vol", by_vol)
    big = F.when(F.col("_by_vol"), F.col("vol")).otherwise(F.col("oi"))
    large = (rows.join(base.select(*keys, "_cut", "_by_vol"), keys)
             .where(near & (big > F.col("_cut"))).groupBy(*keys).agg(
        F.sum(F.when(call, big).otherwise(0.0)).alias("large_calls"),
        F.sum(F.when(put, big).otherwise(0.0)).alias("large_puts")))
    st = n_all.join(base, keys, "left").join(large, keys, "left")
    pc_oi = F.when(F.col("call_oi") > 0, F.try_divide(F.col("put_oi"), F.col("call_oi"))).otherwise(1.0)
    pc_vol = F.when(F.col("call_vol") > 0, F.try_divide(F.col("put_vol"), F.col("call_vol"))).otherwise(1.0)
    pc_near = F.when(F.col("near_call_oi") > 0,
                     F.try_divide(F.col("near_put_oi"), F.col("near_call_oi"))).otherwise(pc_oi)
    if detail:
        no_oi = (F.col("near_call_oi") == 0) & (F.col("near_put_oi") == 0)
        pc_near = F.when(no_oi, F.when(F.col("near_call_vol") > 0, F.try_divide(
            F.col("near_put_vol"), F.col("near_call_vol"))).otherwise(pc_vol)).otherwise(pc_near)

    def signal(x):
        return 1 - clip((x - 0.7) / 0.6, 0, 1)
    lc, lp = F.coalesce("large_calls", F.lit(0.0)), F.coalesce("large_puts", F.lit(0.0))
    imbalance = F.when(lc + lp > 0, F.try_divide(lc, lc + lp)).otherwise(0.5)
    raw = 0.30 * signal(pc_oi) + 0.20 * signal(pc_vol) + 0.30 * signal(pc_near) + 0.20 * imbalance
    thin = ((F.col("n_contracts") < 10) | (F.coalesce("n_calls", F.lit(0)) < 5)
            | (F.coalesce("n_puts", F.lit(0)) < 5))
    return st.select(*keys, "n_contracts", pc_oi.alias("pc_oi"), pc_vol.alias("pc_vol"), pc_near.alias("pc_near"),
                     F.when(thin, 0.5).otherwise(clip(raw, 0, 1)).alias("options_flow"))
