"""Registered queries: fundamental, growth, carry, insider, options and composite scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.functions import scores as sc
from factorspark.functions.exprs import add_weighted_means, day_text, r6
from factorspark.functions.regime_tables import FACTOR_WEIGHTS, PRESETS, QUALITY_WEIGHTS, REGIMES, THRESHOLDS, VALUE_WEIGHTS
from factorspark.operators import asof
from factorspark.operators import factors as fa
from factorspark.operators import flow as fl
from factorspark.operators import indicators as ind
from factorspark.operators.selection import full_rank
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import MOM_SQL, RECOVERY_SQL, TECH_SQL, r
from factorspark.session import discard, shared_by, written
from factorspark.sources import adapters as ad
from factorspark.sources import lattice as lt

AS_OF = "strftime(as_of, '%Y-%m-%d') AS as_of"


def _values(table: dict[str, tuple], name: str, prefix: str) -> str:
    rows = ", ".join("('%s', %s)" % (g, ", ".join(
        "CAST(NULL AS DOUBLE)" if v[i] is None else f"CAST({v[i]} AS DOUBLE)" for v in table.values()))
        for i, g in enumerate(REGIMES))
    return f"{name}(regime, {', '.join(prefix + k for k in table)}) AS (VALUES {rows})"


TH_SQL = _values(THRESHOLDS, "th", "t_")
FW_SQL = _values(FACTOR_WEIGHTS, "fw", "w_")


def hi(v: str, thr: str, exc: float) -> str:
    return f"least(greatest(({v} - {thr} / 2) / ({exc} - {thr} / 2), 0), 1) + 0 * ({v}) * ({thr})"


def lo(v: str, thr: str, exc: float) -> str:
    return f"least(greatest((1.5 * {thr} - {v}) / nullif(1.5 * {thr} - {exc}, 0), 0), 1) + 0 * ({v}) * ({thr})"


def wmean(parts: list[tuple[str, float]]) -> str:
    num = " + ".join(f"coalesce(({e}) * {w}, 0)" for e, w in parts)
    den = " + ".join(f"CASE WHEN ({e}) IS NOT NULL THEN {w} ELSE 0 END" for e, w in parts)
    return f"coalesce(({num}) / nullif({den}, 0), 0)"


def pos(e: str) -> str:
    return f"(CASE WHEN {e} > 0 THEN {e} END)"


def gr(a: str, b: str) -> str:
    return f"(CASE WHEN {a} <> 0 AND ({b}) > 0 THEN {a} / ({b}) END)"


RATIOS = {
    "earnings_yield": "(CASE WHEN trailing_pe > 0 THEN 1 / trailing_pe END)",
    "fcf_yield": gr("free_cashflow", "market_cap"),
    "interest_coverage": gr("ebit", "interest_expense"),
    "cash_debt_ratio": gr("total_cash", "total_debt"),
    "asset_turnover": gr("total_revenue", "total_assets"),
    "roic": gr("ebit", "total_assets - total_current_liabilities"),
    "fcf_margin": gr("free_cashflow", "total_revenue"),
}
VALUE_E = wmean([
    (hi("(CASE WHEN trailing_pe > 0 THEN 1 / trailing_pe END)", "0.05", 0.10), VALUE_WEIGHTS["earnings_yield"]),
    (hi(pos(RATIOS["fcf_yield"]), "t_fcf_yield", 0.10), VALUE_WEIGHTS["fcf_yield"]),
    (lo(pos("ev_to_ebitda"), "t_ev_to_ebitda", 6), VALUE_WEIGHTS["ev_to_ebitda"]),
    (lo(pos("price_to_book"), "t_pb", 1), VALUE_WEIGHTS["pb"]),
    (lo(pos("ev_to_revenue"), "t_ev_to_sales", 1), VALUE_WEIGHTS["ev_to_sales"])])
GROSS = hi("gross_margins", "t_gross_margin", 0.6)
QUALITY_E = wmean([
    (hi("return_on_equity", "t_roe", 0.25), QUALITY_WEIGHTS["roe"]),
    (hi(RATIOS["roic"], "t_roic", 0.20), QUALITY_WEIGHTS["roic"]),
    (GROSS, QUALITY_WEIGHTS["gross_margin"]),
    (hi(RATIOS["fcf_margin"], "t_fcf_margin", 0.15), QUALITY_WEIGHTS["fcf_margin"]),
    (hi(pos(RATIOS["asset_turnover"]), "t_asset_turnover", 1.0), QUALITY_WEIGHTS["asset_turnover"]),
    (hi("operating_margins", "t_operating_margin", 0.2), QUALITY_WEIGHTS["operating_margin"]),
    (f"0.8 * coalesce({GROSS}, 0)", QUALITY_WEIGHTS["revenue_stability"])])
HEALTH_E = wmean([
    (hi(pos(RATIOS["cash_debt_ratio"]), "t_cash_debt_ratio", 0.6), 1),
    (hi(pos("current_ratio"), "t_current_ratio", 2.5), 1),
    (lo("(CASE WHEN debt_to_equity >= 0 THEN debt_to_equity END)", "t_de_ratio", 50), 1),
    (hi(pos(RATIOS["interest_coverage"]), "t_interest_coverage", 10), 1)])
FUND_SCORES = f"""fs AS (SELECT *, {VALUE_E} AS value, {QUALITY_E} AS quality, {HEALTH_E} AS financial_health
  FROM fund CROSS JOIN th)"""


def keyed(*cols: str):
    return ["symbol", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), *cols]


@query("guarded_ratios", with_(o.FUNDAMENTALS, body=f"""
SELECT symbol, {AS_OF}, {', '.join(r(e, k, 7) for k, e in RATIOS.items())} FROM fund"""))
def guarded_ratios(spark, sf):
    f = ad.fundamentals(spark, sf)
    return f.select(*keyed(), *[F.round(e, 7).alias(k) for k, e in sc.ratios().items()])


@query("fundamental_factor_scores", with_(o.FUNDAMENTALS, TH_SQL, FUND_SCORES, body=f"""
SELECT symbol, {AS_OF}, regime, {r('value', 'value')}, {r('quality', 'quality')},
  {r('financial_health', 'financial_health')} FROM fs"""))
def fundamental_factor_scores(spark, sf):
    return fa.fundamental_scores(fa.for_each_regime(ad.fundamentals(spark, sf))).select(
        *keyed("regime"), r6("value"), r6("quality"), r6("financial_health"))


def c01(e: str) -> str:
    return f"least(greatest({e}, 0), 1) + 0 * ({e})"


EST_PIVOT = """ep AS (SELECT symbol, as_of, max(e_avg) FILTER (period = '0q') AS q0_avg,
  max(e30) FILTER (period = '0q') AS q30, max(e60) FILTER (period = '0q') AS q60, max(e90) FILTER (period = '0q') AS q90,
  max(rev_growth) FILTER (period = '0q') AS qrg, max(e_avg) FILTER (period = '0y') AS y0,
  max(e_avg) FILTER (period = '+1y') AS y1 FROM est GROUP BY 1, 2)"""
GROWTH_E = wmean([
    (c01("(coalesce(revenue_growth, 0) - t_rev_growth) / 0.25"), 0.8),
    (c01(f"(t_peg_ratio - {pos('peg_ratio')}) / (t_peg_ratio - 1)"), 0.9),
    ("CASE WHEN q90 > 0 THEN (least(greatest(((q0_avg - q90) / q90 + CASE WHEN q30 > 0 THEN (q0_avg - q30) / q30 "
     "ELSE 0 END) / 0.1, -1), 1) + 1) / 2 END", 1.0),
    (c01("(CASE WHEN y0 > 0 THEN (y1 - y0) / y0 END - 0.05) / 0.25"), 0.9),
    (c01("(qrg - 0.05) / 0.25"), 0.8),
    (c01("(CASE WHEN price > 0 THEN target_mean_price / price - 1 END - 0.1) / 0.4"), 0.7),
    (c01("(CASE WHEN operating_margins > 0 AND profit_margins > 0 THEN (operating_margins - profit_margins) "
         "/ profit_margins END + 0.1) / 0.2"), 0.6)])
GROWTH_SQL = (o.FUNDAMENTALS, o.ESTIMATES, EST_PIVOT, TH_SQL, f"""
gs AS (SELECT fund.*, regime, {GROWTH_E} AS growth FROM fund LEFT JOIN ep USING (symbol, as_of) CROSS JOIN th)""")


@query("growth_factor_scores", with_(*GROWTH_SQL, body=f"""
SELECT symbol, {AS_OF}, regime, {r('growth', 'growth')} FROM gs"""))
def growth_factor_scores(spark, sf):
    f = fa.for_each_regime(ad.fundamentals(spark, sf))
    return fa.growth_scores(f, ad.estimates(spark, sf)).select(*keyed("regime"), r6("growth"))


@query("sector_relative_growth", with_(*GROWTH_SQL, """
st AS (SELECT sector, as_of, avg(growth) AS mu, stddev_samp(growth) AS sd FROM gs WHERE regime = 'Steady_Growth'
  GROUP BY 1, 2),
z AS (SELECT symbol, gs.as_of, sector, (growth - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z
  FROM gs JOIN st USING (sector, as_of) WHERE regime = 'Steady_Growth')""", body=f"""
SELECT symbol, {AS_OF}, sector, {r('z', 'growth_norm_z')}, {r('1 / (1 + exp(-least(greatest(z, -2), 2)))', 'growth_norm')}
FROM z"""))
def sector_relative_growth(spark, sf):
    f = ad.fundamentals(spark, sf).withColumn("regime", F.lit("Steady_Growth"))
    g = fa.growth_scores(f, ad.estimates(spark, sf))
    return fa.sector_relative(g, "growth", ["sector", "as_of"], "growth_norm").select(
        *keyed("sector"), r6("growth_norm_z"), r6("growth_norm"))


SIZE_E = """CASE WHEN market_cap > 0 THEN 0.8 * least(greatest((log10(5e11) - log10(market_cap)) / (log10(5e11) - log10(3e8)), 0), 1)
  + 0.2 * CASE WHEN price IS NULL THEN 0 WHEN price < 2 THEN price / 2 WHEN price <= 50 THEN 1
    ELSE greatest(1 - (price - 50) / 150, 0) END ELSE 0 END"""
LIQ_E = """0.30 * least(avg_volume_10d / 1e7, 1) + 0.25 * least(avg_volume_10d / shares_outstanding * 100, 1)
  + 0.20 * least(market_cap / 1e10, 1) + 0.15 * CASE WHEN price < 1 THEN price WHEN price < 5 THEN 0.8 + (price - 1) / 20 ELSE 1 END
  + 0.10 * least(institutions_pct / 0.7, 1)"""


@query("size_and_liquidity_scores", with_(o.FUNDAMENTALS, body=f"""
SELECT symbol, {AS_OF}, {r(SIZE_E, 'size')}, {r(LIQ_E, 'liquidity')} FROM fund"""))
def size_and_liquidity_scores(spark, sf):
    return ad.fundamentals(spark, sf).select(
        *keyed(), F.round(sc.size_score(F.col("market_cap"), F.col("price")), 6).alias("size"),
        F.round(sc.liquidity_score(), 6).alias("liquidity"))


CARRY_SQL = (o.dividends("supplier"), """
dy AS (SELECT symbol, year(ex_date) AS yr, sum(amount) AS amt FROM divs GROUP BY 1, 2 HAVING sum(amount) > 0),
dh AS (SELECT symbol, count(*) AS streak, CASE WHEN max(yr) > min(yr) THEN
  power(arg_max(amt, yr) / arg_min(amt, yr), 1.0 / (max(yr) - min(yr))) - 1 END AS cagr FROM dy GROUP BY 1),
ca AS (SELECT fund.*, cagr, streak, CASE WHEN dividend_yield IS NULL OR dividend_yield = 0 THEN 0 ELSE least(
  least(dividend_yield / 0.10, 1)
  + CASE WHEN payout_ratio <= 0.3 THEN 0.20 WHEN payout_ratio <= 0.5 THEN 0.15 WHEN payout_ratio <= 0.7 THEN 0.05 ELSE 0 END
  + CASE WHEN cagr >= 0.10 THEN 0.20 WHEN cagr >= 0.05 THEN 0.15 WHEN cagr >= 0.02 THEN 0.10 WHEN cagr >= 0 THEN 0.05 ELSE 0 END
  + CASE WHEN streak >= 10 THEN 0.20 WHEN streak >= 5 THEN 0.15 WHEN streak >= 3 THEN 0.10 WHEN streak >= 1 THEN 0.05 ELSE 0 END,
  1) END AS carry FROM fund LEFT JOIN dh USING (symbol))""")


@query("dividend_carry_scores", with_(o.FUNDAMENTALS, *CARRY_SQL, body=f"""
SELECT symbol, {AS_OF}, {r('cagr', 'dividend_cagr')}, streak, {r('carry', 'carry')} FROM ca"""))
def dividend_carry_scores(spark, sf):
    h = fa.dividend_history(ad.dividends(spark, sf, "supplier"))
    return fa.carry_scores(ad.fundamentals(spark, sf), h).select(
        *keyed(), r6("dividend_cagr"), "streak", r6("carry"))


def curve_sql(x: str, b: tuple) -> str:
    ys = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)
    seg = f"CASE WHEN {x} IS NULL THEN 0.5 WHEN {x} <= {b[0]} THEN 0.1"
    for i in range(5):
        seg += f" WHEN {x} <= {b[i + 1]} THEN {ys[i]} + ({x} - ({b[i]})) / ({b[i + 1]} - ({b[i]})) * ({ys[i + 1]} - {ys[i]})"
    return seg + " ELSE 1.0 END"


EARN_SQL = (o.ESTIMATES, o.SURPRISES, """
sm AS (SELECT symbol, avg(surprise_pct) AS s FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn
  FROM sur) WHERE rn <= 4 GROUP BY 1),
em AS (SELECT symbol, as_of, (e_avg - e90) / abs(e90) AS revision, 0.5 * (e_avg - e90) / abs(e90) + 0.5 * s / 100
  AS earnings_momentum FROM est LEFT JOIN sm USING (symbol) WHERE period = '0q')""")


@query("earnings_momentum", with_(*EARN_SQL, body=f"""
SELECT symbol, {AS_OF}, {r('revision', 'revision')}, {r('earnings_momentum', 'earnings_momentum')} FROM em"""))
def earnings_momentum(spark, sf):
    return fa.earnings_momentum(ad.estimates(spark, sf), ad.surprises(spark, sf)).select(
        *keyed(), r6("revision"), r6("earnings_momentum"))


MOMENTUM_SQL = f"""
ms AS (SELECT symbol, as_of, momentum_12m, {curve_sql('momentum_12m', (-0.5, -0.2, 0, 0.3, 1, 2))} AS price_part,
  {curve_sql('earnings_momentum', (-0.4, -0.15, 0, 0.2, 0.5, 1))} AS earnings_part
  FROM mom LEFT JOIN em USING (symbol))"""


def daily_bars(spark, sf):
    """Supplier bars kept partitioned by symbol and in date order for the branches that read them."""
    return shared_by(ad.bars(spark, sf), ["symbol"], ["d"])


def _momentum(prices, estimates, surprises):
    m = prices.join(fa.earnings_momentum(estimates, surprises), "symbol", "left")
    return m.withColumn("price_part", sc.price_momentum_score(F.col("momentum_12m"))).withColumn(
        "earnings_part", sc.earnings_momentum_score(F.col("earnings_momentum"))).withColumn(
        "momentum", sc.momentum_score(F.col("price_part"), F.col("earnings_part")))


@query("momentum_factor_scores", with_(o.bars(), MOM_SQL, *EARN_SQL, MOMENTUM_SQL, body=f"""
SELECT symbol, {AS_OF}, {r('price_part', 'price_part')}, {r('earnings_part', 'earnings_part')},
  {r('0.6 * price_part + 0.4 * earnings_part', 'momentum')} FROM ms"""))
def momentum_factor_scores(spark, sf):
    return _momentum(ind.year_momentum(ad.bars(spark, sf)), ad.estimates(spark, sf), ad.surprises(spark, sf)).select(*keyed(), r6("price_part"), r6("earnings_part"), r6("momentum"))


INS_SQL = f"""
i0 AS (SELECT symbol, make_date(year(d), 12, 31) AS as_of, datediff('day', d, make_date(year(d), 12, 31)) AS age, text, value,
  filer FROM ins WHERE datediff('day', d, make_date(year(d), 12, 31)) BETWEEN 0 AND 90),
i1 AS (SELECT symbol, as_of, sum(value) FILTER (lower(text) LIKE '%purchase%') AS b,
  sum(value) FILTER (lower(text) LIKE '%sale%') AS s, count(DISTINCT filer) AS filers, avg(age) AS age FROM i0 GROUP BY 1, 2),
i2 AS (SELECT symbol, as_of, coalesce(b, 0) AS buys, coalesce(s, 0) AS sells, filers, age, coalesce(b, 0) + coalesce(s, 0) AS tot
  FROM i1),
i3 AS (SELECT *, (2 * buys / nullif(tot, 0) - 1) * (0.5 + 0.2 * least(ln(tot + 1) / ln(1e7), 1) + 0.2 * least(filers / 5, 1)
  + 0.1 * (1 - least(age, 90) / 90)) AS raw FROM i2)"""


@query("insider_scores", with_(o.INSIDER, INS_SQL, body=f"""
SELECT symbol, {AS_OF}, filers, {r('buys', 'buys', 2)}, {r('sells', 'sells', 2)},
  {r('CASE WHEN tot > 0 THEN least(greatest(raw, -1), 1) ELSE 0 END', 'insider')},
  {r('CASE WHEN tot > 0 THEN least(greatest((raw + 1) / 2, 0), 1) ELSE 0.5 END', 'insider_sentiment')} FROM i3"""))
def insider_scores(spark, sf):
    tx = ad.insider(spark, sf).withColumn("as_of", F.make_date(F.year("d"), F.lit(12), F.lit(31)))
    return fa.insider_scores(tx, ["symbol", "as_of"], F.col("as_of")).select(
        *keyed("filers"), r6("buys", 2), r6("sells", 2), r6("insider"), r6("insider_sentiment"))


def _variant_sql(scale: str) -> str:
    return f"""
v AS (SELECT symbol, coalesce(sum(value) FILTER (lower(text) LIKE '%purchase%'), 0) AS buys,
  coalesce(sum(value) FILTER (lower(text) LIKE '%sale%'), 0) AS sells, count(DISTINCT filer) AS filers FROM ins GROUP BY 1),
vs AS (SELECT *, CASE WHEN buys + sells > 0 THEN least(greatest((2 * buys / (buys + sells) - 1) * ({scale}), -1), 1) ELSE 0
  END AS insider FROM v)"""


@query("insider_record_scores", with_(o.INSIDER, _variant_sql(
    "0.5 + 0.2 * least(ln(1 + buys + sells) / ln(1 + 1e7), 1) + 0.2 * least(filers / 5, 1) + 0.1"), body=f"""
SELECT symbol, filers, {r('buys', 'buys', 2)}, {r('sells', 'sells', 2)}, {r('insider', 'insider')} FROM vs"""))
def insider_record_scores(spark, sf):
    tx = ad.insider(spark, sf).select("symbol", F.col("text").alias("kind"), F.lit("").alias("code"), "value", "filer")
    return fa.insider_from_records(tx, ["symbol"]).select(
        "symbol", "filers", r6("buys", 2), r6("sells", 2), r6("insider"))


@query("insider_filing_scores", with_(o.INSIDER, _variant_sql("0.6 + 0.4 * least(filers / 3, 1)"), body=f"""
SELECT symbol, filers, {r('buys', 'buys', 2)}, {r('sells', 'sells', 2)}, {r('insider', 'insider')} FROM vs"""))
def insider_filing_scores(spark, sf):
    tx = ad.insider(spark, sf).select("symbol", F.col("text").alias("kind"), "value", "filer")
    return fa.insider_from_filings(tx, ["symbol"]).select(
        "symbol", "filers", r6("buys", 2), r6("sells", 2), r6("insider"))


TAIL_SQL = """
rt AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret,
  row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars),
tb AS (SELECT symbol, count(ret) AS n_returns, stddev_samp(ret) FILTER (rn <= 30) AS std_30,
  stddev_samp(ret) * sqrt(252) AS volatility, abs(least(avg(ret) - 2.06 * stddev_samp(ret), 0)) AS cvar FROM rt GROUP BY 1),
yr AS (SELECT symbol, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY d) AS dd FROM (SELECT *, row_number() OVER
  (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 252),
cd AS (SELECT symbol, avg(dd) AS cdar FROM yr JOIN (SELECT symbol, quantile_cont(dd, 0.95) AS cut FROM yr GROUP BY 1)
  USING (symbol) WHERE dd >= cut GROUP BY 1)"""
BETA_SQL = """
mk AS (SELECT d, close / lag(close) OVER (ORDER BY d) - 1 AS mret FROM (SELECT CAST(l_shipdate AS DATE) AS d,
  sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1)),
be AS (SELECT symbol, count(*) AS n_common, covar_samp(ret, mret) / var_pop(mret) AS beta FROM (SELECT symbol, d,
  close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM bars) JOIN mk USING (d)
  WHERE ret IS NOT NULL AND mret IS NOT NULL GROUP BY 1),
bs AS (SELECT *, CASE WHEN n_common > 60 THEN 1 - tanh(2 * greatest(beta - 1, 0)) ELSE 1 END AS beta_score FROM be)"""
STAB_SQL = (TAIL_SQL, BETA_SQL, RECOVERY_SQL, """
sb AS (SELECT symbol, 0.3 * (1 - tanh(2 * volatility)) + 0.3 * (1 - tanh(4 * greatest(cvar, cdar))) + 0.2 * recovery
  + 0.2 * coalesce(beta_score, 1) AS stability FROM tb JOIN cd USING (symbol) JOIN recv USING (symbol)
  LEFT JOIN bs USING (symbol))""")


@query("tail_risk_measures", with_(o.bars(), TAIL_SQL, body=f"""
SELECT symbol, n_returns, {r('std_30', 'std_30')}, {r('volatility', 'volatility')}, {r('cvar', 'cvar')}, {r('cdar', 'cdar')}
FROM tb JOIN cd USING (symbol)"""))
def tail_risk_measures(spark, sf):
    return fa.tail_measures(daily_bars(spark, sf)).select(
        "symbol", "n_returns", r6("std_30"), r6("volatility"), r6("cvar"), r6("cdar"))


@query("market_beta_scores", with_(o.bars(), BETA_SQL, body=f"""
SELECT symbol, n_common, {r('beta', 'beta')}, {r('beta_score', 'beta_score')} FROM bs"""))
def market_beta_scores(spark, sf):
    return fa.beta_scores(ad.bars(spark, sf), ad.bars(spark, sf, "market")).select(
        "symbol", "n_common", r6("beta"), r6("beta_score"))


@query("stability_factor", with_(o.bars(), *STAB_SQL, body=f"""
SELECT symbol, {r('stability', 'stability')}, {r('-(1 - stability)', 'risk_penalty')} FROM sb"""))
def stability_factor(spark, sf):
    return fa.stability_factor(daily_bars(spark, sf), ad.bars(spark, sf, "market")).select(
        "symbol", r6("stability"), r6("risk_penalty"))


# The ranking uses every factor the driver tables can feed, for the latest yearly snapshot.
RANK_SQL = (o.bars(), MOM_SQL, *EARN_SQL, MOMENTUM_SQL, *TECH_SQL, *STAB_SQL, o.FUNDAMENTALS, *CARRY_SQL, TH_SQL, FUND_SCORES,
            EST_PIVOT, FW_SQL, o.INSIDER, INS_SQL, f"""
ix AS (SELECT symbol, as_of, CASE WHEN tot > 0 THEN least(greatest(raw, -1), 1) ELSE 0 END AS insider FROM i3),
ls AS (SELECT symbol, max(as_of) AS as_of FROM fund GROUP BY 1),
g2 AS (SELECT symbol, as_of, regime, sector, {GROWTH_E} AS growth FROM fund JOIN ls USING (symbol, as_of)
  LEFT JOIN ep USING (symbol, as_of) CROSS JOIN th),
gst AS (SELECT sector, regime, avg(growth) AS mu, stddev_samp(growth) AS sd FROM g2 GROUP BY 1, 2),
gn AS (SELECT symbol, regime, 1 / (1 + exp(-least(greatest((growth - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, -2), 2)))
  AS growth FROM g2 JOIN gst USING (sector, regime)),
tot AS (SELECT fs.symbol, fs.regime, fs.sector,
  w_value * value + w_quality * quality + w_financial_health * financial_health + w_stability * coalesce(stability, 0)
  + w_liquidity * ({LIQ_E}) + w_size * ({SIZE_E}) + w_growth * gn.growth + w_carry * coalesce(ca.carry, 0)
  + w_momentum * coalesce(0.6 * price_part + 0.4 * earnings_part, 0) + w_technical * coalesce(technical, 0) + w_insider * coalesce(insider, 0) AS score
  FROM (SELECT fs.* FROM fs JOIN ls USING (symbol, as_of)) fs
  LEFT JOIN sb USING (symbol) LEFT JOIN tech USING (symbol) JOIN gn USING (symbol, regime)
  LEFT JOIN (SELECT symbol, as_of, carry FROM ca) ca ON ca.symbol = fs.symbol AND ca.as_of = fs.as_of
  LEFT JOIN (SELECT symbol, as_of, price_part, earnings_part FROM ms) ms ON ms.symbol = fs.symbol AND ms.as_of = fs.as_of
  LEFT JOIN ix ON ix.symbol = fs.symbol AND ix.as_of = fs.as_of JOIN fw ON fw.regime = fs.regime)""")


def with_states(fund, states, estimates):
    """Snapshots with their estimates and what is known from their history: ``states`` has one row for each snapshot (``asof``)."""
    key = ["symbol", "as_of"]
    return fund.join(fa.pivot_estimates(estimates), key, "left").join(states, key, "left")


def factors_of(st, groups=("sector", "regime")):
    """Snapshots (``with_states``) with their factor columns, one row per regime; option flow and insiders are joined by the caller."""
    revision = F.try_divide(F.col("q0_avg") - F.coalesce("q0_d90", "q0_avg"), F.abs(F.coalesce("q0_d90", F.lit(1.0))))
    earnings = 0.5 * revision + 0.5 * F.col("mean_surprise") / 100
    momentum = sc.momentum_score(sc.price_momentum_score(F.col("momentum_12m")), sc.earnings_momentum_score(earnings))
    st = (st.withColumn("momentum", F.when(F.col("n_bars") > 0, momentum))
          .withColumn("carry", sc.carry_score(F.col("dividend_yield"), F.col("payout_ratio"), F.col("dividend_cagr"), F.col("streak")))
          .withColumn("size", sc.size_score(F.col("market_cap"), F.col("price")))
          .withColumn("liquidity", sc.liquidity_score()))
    scored = add_weighted_means(fa.fundamental_scores(fa.for_each_regime(st)), {"growth_raw": sc.growth_parts()})
    return fa.sector_relative(scored, "growth_raw", list(groups), "growth")


def known_snapshots(spark, sf, market, among, tasks: int, latest: bool):
    """Snapshots of the suppliers of one slice with all that follows from their own lines, written; the cells go."""
    cells = lt.supplier_cells(spark, sf, among, tasks)
    fund = lt.fundamentals(cells, spark, sf)
    if latest:
        newest = Window.partitionBy("symbol").orderBy(F.desc("as_of"))
        fund = fund.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    fund = written(fund, "fundamentals")
    snaps = asof.with_until(fund, F.lit("9999-12-31").cast("date") if latest else None)
    told = asof.last_known([(asof.dividend_states(lt.dividends(cells)), "ex_date", ["dividend_cagr", "streak"]),
                            (asof.surprise_states(lt.surprises(cells)), "d", ["mean_surprise"])], snaps)
    states = asof.bar_states(lt.bars(cells), market, snaps, tasks).join(told, ["symbol", "as_of"], "left")
    known = written(with_states(fund, states, lt.estimates(cells)), "snapshots")
    discard(cells, fund)
    return known


def snapshot_factors(spark, sf, latest: bool, slice_lines: int | None = None):
    """Snapshots of the suppliers with all factors: the latest of each with all its history, or every one as of its date.

    The lines are scanned for the market, once for each slice of the suppliers, and joined to their orders for the insiders of each long
    slice; each of these steps leaves a short table and nothing else on disk. The suppliers have no listed options: that factor is neutral.
    """
    market = written(lt.market_bars(lt.line_cells(spark, sf)), "market")
    tx = ad.insider(spark, sf).withColumn("as_of", F.make_date(F.year("d"), F.lit(12), F.lit(31)))
    bought = [written(fa.insider_scores(tx.where(among), ["symbol", "as_of"], F.col("as_of")).select("symbol", "as_of", "insider"), "insiders")
              for among in lt.supplier_slices(spark, sf, lt.NARROW * (slice_lines or lt.SLICE_LINES), "symbol")[0]]
    slices, tasks = lt.supplier_slices(spark, sf, slice_lines)
    parts = [known_snapshots(spark, sf, market, among, tasks, latest) for among in slices]
    known, bought = (spark.read.schema(x[0].schema).parquet(*[y.written_in for y in x]) for x in (parts, bought))
    known = known.withColumn("options_flow", F.lit(0.0)).join(bought, ["symbol", "as_of"], "left")
    return factors_of(known, ("sector", "regime") if latest else ("sector", "as_of", "regime"))


def factor_table(spark, sf):
    """Latest snapshot of every symbol with all factor columns, one row per regime."""
    return snapshot_factors(spark, sf, True)


def factor_history(spark, sf):
    """Every snapshot with the factors of what was known at its date, one row per regime."""
    return snapshot_factors(spark, sf, False)


@query("regime_factor_ranking", with_(*RANK_SQL, body=f"""
SELECT regime, symbol, sector, {r('score', 'score', 5)},
  row_number() OVER (PARTITION BY regime ORDER BY round(score, 5) DESC, symbol) AS rank FROM tot"""))
def regime_factor_ranking(spark, sf):
    scored = fa.composite_score(factor_table(spark, sf)).select("regime", "symbol", "sector", r6("score", 5))
    return full_rank(scored, ["regime"], "score")


PRESET = "second"
_PRESET_ALL = {f: PRESETS[PRESET].get(f, (0.0, 0.0, 0.0)) for f in (*FACTOR_WEIGHTS, "volatility_penalty")}
PRESET_SQL = tuple(c if c is not FW_SQL else _values(_PRESET_ALL, "fw", "w_") for c in RANK_SQL[:-1]) + (
    RANK_SQL[-1].replace("coalesce(insider, 0) AS score", "coalesce(insider, 0) + w_volatility_penalty * coalesce(1 - stability, 0) AS score"),)


@query("preset_factor_ranking", with_(*PRESET_SQL, body=f"""
SELECT regime, symbol, {r('score', 'score', 5)}, row_number() OVER (PARTITION BY regime ORDER BY round(score, 5) DESC, symbol) AS rank FROM tot"""))
def preset_factor_ranking(spark, sf):
    """The ranking with the second set of weights."""
    scored = fa.composite_score(factor_table(spark, sf), preset=PRESET).select("regime", "symbol", r6("score", 5))
    return full_rank(scored, ["regime"], "score")


@query("option_chain_detail_scores", with_(o.CONTRACTS, """
pc AS (SELECT d, regexp_extract(contract, '^O:([A-Z0-9.]+?)(\\d{6})([CP])(\\d{8})$', 1) AS symbol,
  regexp_extract(contract, '([CP])\\d{8}$', 1) AS kind, CAST(right(contract, 8) AS DOUBLE) / 1000 AS strike,
  CASE WHEN volume % 3 = 0 THEN oi % 40 ELSE 0 END AS oi, volume FROM oc WHERE regexp_matches(contract, '^O:[A-Z0-9.]+?\\d{6}[CP]\\d{8}$')),
rw AS (SELECT d, symbol, kind, CAST(oi AS DOUBLE) AS oi, CAST(volume AS DOUBLE) AS vol, strike / 100 BETWEEN 0.90 AND 1.10 AS near
  FROM pc WHERE oi > 0 OR volume > 0),
na AS (SELECT d, symbol, count(*) AS n_contracts FROM pc GROUP BY 1, 2),
bs AS (SELECT d, symbol, count(*) FILTER (kind = 'C') AS nc, count(*) FILTER (kind = 'P') AS np,
  coalesce(sum(oi) FILTER (kind = 'C'), 0) AS co, coalesce(sum(oi) FILTER (kind = 'P'), 0) AS po,
  coalesce(sum(vol) FILTER (kind = 'C'), 0) AS cv, coalesce(sum(vol) FILTER (kind = 'P'), 0) AS pv,
  coalesce(sum(oi) FILTER (kind = 'C' AND near), 0) AS nco, coalesce(sum(oi) FILTER (kind = 'P' AND near), 0) AS npo,
  coalesce(sum(vol) FILTER (kind = 'C' AND near), 0) AS ncv, coalesce(sum(vol) FILTER (kind = 'P' AND near), 0) AS npv, avg(oi) < 10 AS byvol,
  CASE WHEN avg(oi) < 10 THEN CASE WHEN stddev_pop(vol) > 0 THEN avg(vol) + stddev_pop(vol) ELSE avg(vol) * 1.5 END
    WHEN stddev_pop(oi) > 0 THEN avg(oi) + 2 * stddev_pop(oi) ELSE avg(oi) * 2 END AS cut FROM rw GROUP BY 1, 2),
lg AS (SELECT d, symbol, coalesce(sum(CASE WHEN byvol THEN vol ELSE oi END) FILTER (kind = 'C'), 0) AS lc,
  coalesce(sum(CASE WHEN byvol THEN vol ELSE oi END) FILTER (kind = 'P'), 0) AS lp
  FROM rw JOIN bs USING (d, symbol) WHERE near AND CASE WHEN byvol THEN vol ELSE oi END > cut GROUP BY 1, 2),
s0 AS (SELECT *, CASE WHEN co > 0 THEN po / co ELSE 1 END AS pc_oi, CASE WHEN cv > 0 THEN pv / cv ELSE 1 END AS pc_vol,
  CASE WHEN lc + lp > 0 THEN lc / (lc + lp) ELSE 0.5 END AS imb FROM na LEFT JOIN bs USING (d, symbol) LEFT JOIN lg USING (d, symbol)),
sg AS (SELECT *, CASE WHEN nco = 0 AND npo = 0 THEN CASE WHEN ncv > 0 THEN npv / ncv ELSE pc_vol END WHEN nco > 0 THEN npo / nco ELSE pc_oi END AS pc_near FROM s0)""", body=f"""
SELECT symbol, strftime(d, '%Y-%m-%d') AS d, n_contracts, {r('pc_oi', 'pc_oi')}, {r('pc_vol', 'pc_vol')}, {r('pc_near', 'pc_near')},
  round(CASE WHEN n_contracts < 10 OR coalesce(nc, 0) < 5 OR coalesce(np, 0) < 5 THEN 0.5 ELSE
   0.30 * (1 - least(greatest((pc_oi - 0.7) / 0.6, 0), 1)) + 0.20 * (1 - least(greatest((pc_vol - 0.7) / 0.6, 0), 1))
   + 0.30 * (1 - least(greatest((pc_near - 0.7) / 0.6, 0), 1)) + 0.20 * imb END, 6) AS options_flow FROM sg"""))
def option_chain_detail_scores(spark, sf):
    """Chains with little open interest, judged by volumes where it is too thin."""
    thin = F.when(F.col("volume") % 3 == 0, F.col("oi") % 40).otherwise(0)
    c = fl.parse_contracts(ad.option_contracts(spark, sf)).select(
        F.col("root").alias("symbol"), "d", "kind", "strike", thin.alias("oi"), "volume", F.lit(100.0).alias("price"))
    return fa.chain_score(c, ["symbol", "d"], detail=True).select(
        "symbol", day_text(), "n_contracts", r6("pc_oi"), r6("pc_vol"), r6("pc_near"), r6("options_flow"))


@query("option_chain_scores", with_(o.CONTRACTS, """
pc AS (SELECT d, regexp_extract(contract, '^O:([A-Z0-9.]+?)(\\d{6})([CP])(\\d{8})$', 1) AS symbol,
  regexp_extract(contract, '([CP])\\d{8}$', 1) AS kind, CAST(right(contract, 8) AS DOUBLE) / 1000 AS strike,
  oi, volume FROM oc WHERE regexp_matches(contract, '^O:[A-Z0-9.]+?\\d{6}[CP]\\d{8}$')),
rw AS (SELECT d, symbol, kind, CAST(oi AS DOUBLE) AS oi, CAST(volume AS DOUBLE) AS vol, strike / 100 BETWEEN 0.90 AND 1.10 AS near
  FROM pc WHERE oi > 0 OR volume > 0),
na AS (SELECT d, symbol, count(*) AS n_contracts FROM pc GROUP BY 1, 2),
bs AS (SELECT d, symbol, count(*) FILTER (kind = 'C') AS nc, count(*) FILTER (kind = 'P') AS np,
  coalesce(sum(oi) FILTER (kind = 'C'), 0) AS co, coalesce(sum(oi) FILTER (kind = 'P'), 0) AS po,
  coalesce(sum(vol) FILTER (kind = 'C'), 0) AS cv, coalesce(sum(vol) FILTER (kind = 'P'), 0) AS pv,
  coalesce(sum(oi) FILTER (kind = 'C' AND near), 0) AS nco, coalesce(sum(oi) FILTER (kind = 'P' AND near), 0) AS npo,
  CASE WHEN stddev_pop(oi) > 0 THEN avg(oi) + 2 * stddev_pop(oi) ELSE avg(oi) * 2 END AS cut FROM rw GROUP BY 1, 2),
lg AS (SELECT d, symbol, coalesce(sum(oi) FILTER (kind = 'C'), 0) AS lc, coalesce(sum(oi) FILTER (kind = 'P'), 0) AS lp
  FROM rw JOIN bs USING (d, symbol) WHERE near AND oi > cut GROUP BY 1, 2),
sg AS (SELECT *, CASE WHEN co > 0 THEN po / co ELSE 1 END AS pc_oi, CASE WHEN cv > 0 THEN pv / cv ELSE 1 END AS pc_vol,
  CASE WHEN nco > 0 THEN npo / nco WHEN co > 0 THEN po / co ELSE 1 END AS pc_near,
  CASE WHEN lc + lp > 0 THEN lc / (lc + lp) ELSE 0.5 END AS imb
  FROM na LEFT JOIN bs USING (d, symbol) LEFT JOIN lg USING (d, symbol))""", body=f"""
SELECT symbol, strftime(d, '%Y-%m-%d') AS d, n_contracts, {r('pc_oi', 'pc_oi')}, {r('pc_vol', 'pc_vol')}, {r('pc_near', 'pc_near')},
  round(CASE WHEN n_contracts < 10 OR coalesce(nc, 0) < 5 OR coalesce(np, 0) < 5 THEN 0.5 ELSE
   0.30 * (1 - least(greatest((pc_oi - 0.7) / 0.6, 0), 1)) + 0.20 * (1 - least(greatest((pc_vol - 0.7) / 0.6, 0), 1))
   + 0.30 * (1 - least(greatest((pc_near - 0.7) / 0.6, 0), 1)) + 0.20 * imb END, 6) AS options_flow FROM sg"""))
def option_chain_scores(spark, sf):
    c = fl.parse_contracts(ad.option_contracts(spark, sf)).select(
        F.col("root").alias("symbol"), "d", "kind", "strike", "oi", "volume", F.lit(100.0).alias("price"))
    return fa.chain_score(c, ["symbol", "d"]).select(
        "symbol", day_text(), "n_contracts", r6("pc_oi"), r6("pc_vol"), r6("pc_near"), r6("options_flow"))


@query("economic_growth_buckets", """
SELECT strftime(q, '%Y-%m-%d') AS q, round(rate, 6) AS rate, CASE WHEN rate >= 0.04 THEN CAST(1 AS DOUBLE) WHEN rate >= 0.025 THEN 0.75
  WHEN rate >= 0.01 THEN 0.5 WHEN rate >= -0.01 THEN 0.25 WHEN rate IS NOT NULL THEN 0.0 END AS bucket FROM (
  SELECT q, v / lag(v) OVER (ORDER BY q) - 1 AS rate FROM (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
    sum(l_extendedprice) AS v FROM lineitem GROUP BY 1))""")
def economic_growth_buckets(spark, sf):
    q = (ad.table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q"))
         .agg(F.sum("l_extendedprice").alias("v")))
    rate = F.col("v") / F.lag("v").over(Window.orderBy("q")) - 1   # one row per quarter
    return q.withColumn("rate", rate).select(
        F.date_format("q", "yyyy-MM-dd").alias("q"), r6("rate"), sc.growth_bucket(F.col("rate")).alias("bucket"))


@query("property_exclusions", with_(o.FUNDAMENTALS, body=f"""
SELECT symbol, {AS_OF}, (regexp_matches(lower(sector) || '|' || lower(industry), '{"|".join(sc.PROPERTY_KEYWORDS)}')
  OR sector IN ('ASIA') OR industry IN ('FRANCE', 'NATION_3')) AS excluded FROM fund"""))
def property_exclusions(spark, sf):
    f = ad.fundamentals(spark, sf)
    return f.select(*keyed(), sc.property_related(
        F.col("sector"), F.col("industry"), ("ASIA",), ("FRANCE", "NATION_3")).alias("excluded"))


@query("company_fields", """
SELECT s_suppkey, coalesce(nullif(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END), ''), nullif(trim(n_name), ''), 'N/A')
  AS company_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def company_fields(spark, sf):
    s = ad.table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("long_name"))
    n = ad.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        "s_suppkey", sc.first_text("long_name", "n_name").alias("company_name"))


