"""Registered queries: returns, rolling windows, indicators, technical factor scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import indicators as ind
from factorspark.plans.oracle_ctes import bars as bars_sql
from factorspark.plans.oracle_ctes import score_history as hist_sql
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.session import shared_by
from factorspark.sources.adapters import bars, score_history

W = "WINDOW w AS (PARTITION BY symbol ORDER BY d)"
DT = "strftime(d, '%Y-%m-%d') AS d"


def roll(x: str, n: int, fn: str = "avg", out: str | None = None) -> str:
    fr = f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {fr} = {n} THEN {fn}({x}) OVER {fr} END" + (f" AS {out}" if out else "")


def r(x: str, out: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {out}"


RET = f"ret AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {W})"


@query("bars_by_supplier", with_(bars_sql("supplier"), body=f"""
SELECT symbol, {DT}, {r('high', 'high', 9)}, {r('low', 'low', 9)}, {r('close * volume', 'notional', 2)}, volume FROM bars"""))
def bars_by_supplier(spark, sf):
    return bars(spark, sf, "supplier").select(
        "symbol", day_text(), r6("high", 9), r6("low", 9),
        F.round(F.col("close") * F.col("volume"), 2).alias("notional"), "volume")


@query("bars_by_brand", with_(bars_sql("brand"), body=f"""
SELECT symbol, {DT}, {r('high', 'high', 9)}, {r('low', 'low', 9)}, {r('close * volume', 'notional', 2)}, volume FROM bars"""))
def bars_by_brand(spark, sf):
    return bars(spark, sf, "brand").select(
        "symbol", day_text(), r6("high", 9), r6("low", 9),
        F.round(F.col("close") * F.col("volume"), 2).alias("notional"), "volume")


@query("simple_returns", with_(bars_sql(), RET, body=f"SELECT symbol, {DT}, {r('ret', 'ret')} FROM ret"))
def simple_returns(spark, sf):
    return ind.returns(bars(spark, sf)).select("symbol", day_text(), r6("ret"))


@query("clean_clipped_returns", with_(bars_sql(), RET, body=f"""
SELECT symbol, {DT}, {r('f', 'filled_ret')}, {r('least(greatest(f, -0.5), 0.5)', 'clipped_ret')} FROM (
  SELECT symbol, d, coalesce(ret, first_value(ret IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS f FROM ret)"""))
def clean_clipped_returns(spark, sf):
    return ind.clean_returns(bars(spark, sf)).select(
        "symbol", day_text(), r6("filled_ret"), r6("clipped_ret"))


@query("simple_moving_averages", with_(bars_sql(), body=f"""
SELECT symbol, {DT}, {', '.join(r(roll('close', n), f'sma_{n}') for n in (5, 10, 20, 50, 200))} FROM bars"""))
def simple_moving_averages(spark, sf):
    return ind.moving_averages(bars(spark, sf)).select(
        "symbol", day_text(), *[r6(f"sma_{n}") for n in (5, 10, 20, 50, 200)])


@query("adaptive_rolling_stats", with_(bars_sql(), RET, body=f"""
SELECT symbol, {DT}, round(CASE WHEN cr >= 5 THEN ar WHEN cg >= 2 THEN ag END, 6) AS adaptive_mean,
  round(CASE WHEN cr >= 5 THEN sr WHEN cg >= 2 THEN sg END, 6) AS adaptive_std FROM (
 SELECT symbol, d, count(ret) OVER ro AS cr, avg(ret) OVER ro AS ar, stddev_samp(ret) OVER ro AS sr,
   count(ret) OVER gr AS cg, avg(ret) OVER gr AS ag, stddev_samp(ret) OVER gr AS sg FROM ret
 WINDOW ro AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        gr AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def adaptive_rolling_stats(spark, sf):
    return ind.adaptive_stats(ind.returns(bars(spark, sf)), "ret").select(
        "symbol", day_text(), r6("adaptive_mean"), r6("adaptive_std"))


@query("rolling_volatility", with_(bars_sql(), RET, body=f"""
SELECT symbol, {DT}, {', '.join(r(f'({roll("ret", n, "stddev_samp")}) * sqrt(252)', f'vol_{n}')
                                for n in (20, 21, 63))} FROM ret"""))
def rolling_volatility(spark, sf):
    return ind.rolling_volatility(ind.returns(bars(spark, sf))).select(
        "symbol", day_text(), r6("vol_20"), r6("vol_21"), r6("vol_63"))


@query("trailing_zscore", with_(bars_sql(), body=f"""
SELECT symbol, {DT}, round((close - ({roll('close', 252)})) / nullif({roll('close', 252, 'stddev_samp')}, 0), 6)
  AS zscore FROM bars"""))
def trailing_zscore(spark, sf):
    return ind.trailing_zscore(bars(spark, sf)).select("symbol", day_text(), r6("zscore"))


@query("momentum_changes", with_(bars_sql(), body=f"""
SELECT symbol, {DT}, {', '.join(r(f'close / lag(close, {k}) OVER w - 1', f'chg_{k}') for k in (10, 21, 63))}
FROM bars {W}"""))
def momentum_changes(spark, sf):
    return ind.momentum_changes(bars(spark, sf)).select(
        "symbol", day_text(), r6("chg_10"), r6("chg_21"), r6("chg_63"))


def ema_sql(src: str, x: str, outs: dict[str, float], name: str) -> str:
    """EMA as an explicit weighted sum over all earlier rows that still carry weight."""
    parts, reach = [], 0
    for out, a in outs.items():
        reach = max(reach, int(40 / a) + 1)
        parts.append(f"sum(p.{x} * CASE WHEN p.i = 0 THEN power({1 - a!r}, c.i) "
                     f"ELSE {a!r} * power({1 - a!r}, c.i - p.i) END) AS {out}")
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i FROM {src}),
{name} AS (SELECT c.symbol, c.d, c.i, c.{x}, {', '.join(parts)} FROM {name}_n c JOIN {name}_n p
  ON c.symbol = p.symbol AND p.i BETWEEN c.i - {reach} AND c.i GROUP BY ALL)"""


@query("exponential_averages", with_(bars_sql("brand"), ema_sql(
    "bars", "close", {f"ema_{n}": 2 / (n + 1) for n in (5, 10, 12, 26)}, "e"), body=f"""
SELECT symbol, {DT}, {', '.join(r(f'ema_{n}', f'ema_{n}', 5) for n in (5, 10, 12, 26))} FROM e"""))
def exponential_averages(spark, sf):
    return ind.exponential_averages(bars(spark, sf, "brand")).select(
        "symbol", day_text(), *[r6(f"ema_{n}", 5) for n in (5, 10, 12, 26)])


@query("macd_lines", with_(hist_sql(), ema_sql("hist", "score", {"e12": 2 / 13, "e26": 2 / 27}, "e"),
                           "l AS (SELECT symbol, d, e12 - e26 AS line FROM e)",
                           ema_sql("l", "line", {"sig": 0.2}, "s"), body=f"""
SELECT symbol, {DT}, round(CASE WHEN n >= 26 THEN line END, 6) AS macd,
  round(CASE WHEN n >= 26 THEN sig END, 6) AS macd_signal,
  round(CASE WHEN n >= 26 THEN line - sig END, 6) AS macd_hist
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM s)"""))
def macd_lines(spark, sf):
    return ind.macd(score_history(spark, sf), "score").select(
        "symbol", day_text(), r6("macd"), r6("macd_signal"), r6("macd_hist"))


@query("relative_strength_index", with_(bars_sql(), f"""g AS (SELECT symbol, d,
  coalesce(greatest(close - lag(close) OVER w, 0), 0) AS g, coalesce(greatest(lag(close) OVER w - close, 0), 0) AS l
  FROM bars {W}), m AS (SELECT symbol, d, {roll('g', 14, 'avg', 'g')}, {roll('l', 14, 'avg', 'l')} FROM g)""",
                                        body=f"""
SELECT symbol, {DT}, round(CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi
FROM m"""))
def relative_strength_index(spark, sf):
    return ind.rsi(bars(spark, sf)).select("symbol", day_text(), r6("rsi"))


@query("bollinger_bands", with_(bars_sql(), f"""b AS (SELECT symbol, d, close, {roll('close', 20, 'avg', 'm')},
  {roll('close', 20, 'stddev_samp', 's')} FROM bars)""", body=f"""
SELECT symbol, {DT}, {r('m', 'bb_mid')}, {r('m + 2 * s', 'bb_upper')}, {r('m - 2 * s', 'bb_lower')},
  {r('(close - (m - 2 * s)) / nullif(4 * s, 0)', 'percent_b')}, {r('4 * s / nullif(m, 0)', 'bandwidth')} FROM b"""))
def bollinger_bands(spark, sf):
    return ind.bollinger(bars(spark, sf)).select(
        "symbol", day_text(), *[r6(c) for c in ("bb_mid", "bb_upper", "bb_lower", "percent_b", "bandwidth")])


@query("series_directional_strength", with_(hist_sql(), f"""
a AS (SELECT symbol, d, {roll('score', 2, 'max', 'hi')}, {roll('score', 2, 'min', 'lo')} FROM hist),
b AS (SELECT symbol, d, hi - lo AS tr, CASE WHEN hi - lag(hi) OVER w < 0 THEN 0 ELSE hi - lag(hi) OVER w END AS up,
  CASE WHEN lag(lo) OVER w - lo < 0 THEN 0 ELSE lag(lo) OVER w - lo END AS dn FROM a {W}),
c AS (SELECT symbol, d, 100 * ({roll('up', 14)}) / nullif({roll('tr', 14)}, 0) AS p,
  100 * ({roll('dn', 14)}) / nullif({roll('tr', 14)}, 0) AS m FROM b),
e AS (SELECT symbol, d, p, m, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM c)""", body=f"""
SELECT symbol, {DT}, {r('p', 'plus_di')}, {r('m', 'minus_di')}, {r(roll('dx', 14), 'adx')} FROM e"""))
def series_directional_strength(spark, sf):
    return ind.series_adx(score_history(spark, sf), "score").select(
        "symbol", day_text(), r6("plus_di"), r6("minus_di"), r6("adx"))


ADX_SQL = (f"""
t0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 126),
t1 AS (SELECT symbol, d, high, low, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn
  FROM t0 {W}),
t2 AS (SELECT symbol, d, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS up, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS dn
  FROM t1 WHERE pc IS NOT NULL)""",
           ema_sql("t2", "tr", {"v": 1 / 14}, "etr"), ema_sql("t2", "up", {"v": 1 / 14}, "eup"),
           ema_sql("t2", "dn", {"v": 1 / 14}, "edn"), """
t3 AS (SELECT symbol, d, coalesce(100 * eup.v / nullif(etr.v, 0), 0) AS p, coalesce(100 * edn.v / nullif(etr.v, 0), 0) AS m
  FROM etr JOIN eup USING (symbol, d) JOIN edn USING (symbol, d)),
t4 AS (SELECT symbol, d, p, m, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM t3)""",
           ema_sql("t4", "dx", {"v": 1 / 14}, "edx"), """
adx AS (SELECT symbol, arg_max(v, d) AS adx, arg_max(p, d) AS plus_di, arg_max(m, d) AS minus_di
  FROM edx JOIN t4 USING (symbol, d) GROUP BY 1)""")


@query("directional_movement_index", with_(bars_sql(), *ADX_SQL, body=f"""
SELECT symbol, {r('adx', 'adx')}, {r('plus_di', 'plus_di')}, {r('minus_di', 'minus_di')} FROM adx"""))
def directional_movement_index(spark, sf):
    return ind.true_adx(bars(spark, sf)).select("symbol", r6("adx"), r6("plus_di"), r6("minus_di"))


@query("sma_cross_signals", with_(bars_sql(), f"""
a AS (SELECT symbol, d, {roll('close', 5, 'avg', 's5')}, {roll('close', 10, 'avg', 's10')},
  row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i FROM bars)""", body=f"""
SELECT symbol, {DT}, CASE WHEN i = 0 THEN NULL WHEN i < 10 THEN 'neutral'
  WHEN s5 > s10 AND lag(s5) OVER w <= lag(s10) OVER w THEN 'bullish'
  WHEN s5 < s10 AND lag(s5) OVER w >= lag(s10) OVER w THEN 'bearish' ELSE 'neutral' END AS cross_signal
FROM a {W}"""))
def sma_cross_signals(spark, sf):
    return ind.sma_cross(bars(spark, sf)).select("symbol", day_text(), "cross_signal")


PHASE = """CASE WHEN v > 0.1 AND a > 0.05 THEN 'accelerating_up' WHEN v > 0.1 AND a < -0.05 THEN 'decelerating_up'
  WHEN v < -0.1 AND a > 0.05 THEN 'decelerating_down' WHEN v < -0.1 AND a < -0.05 THEN 'accelerating_down'
  ELSE 'stable' END"""
ACC_SQL = f"""
v0 AS (SELECT symbol, d, score - lag(score) OVER w AS v FROM hist {W}),
v1 AS (SELECT symbol, d, v, v - lag(v) OVER w AS a, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn
  FROM v0 {W}),
acc AS (SELECT symbol, avg(v) AS v, avg(a) AS a FROM v1 WHERE rn <= 3 GROUP BY 1)"""


@query("score_acceleration_phase", with_(hist_sql(), ACC_SQL, body=f"""
SELECT symbol, {r('v', 'recent_velocity')}, {r('a', 'recent_acceleration')}, {PHASE} AS phase FROM acc"""))
def score_acceleration_phase(spark, sf):
    return ind.acceleration(score_history(spark, sf), "score").select(
        "symbol", r6("recent_velocity"), r6("recent_acceleration"), "phase")


@query("running_drawdowns", with_(bars_sql(), """
a AS (SELECT symbol, d, close, max(close) OVER (PARTITION BY symbol ORDER BY d) AS peak FROM bars)""", body=f"""
SELECT symbol, {DT}, {r('peak', 'peak', 7)}, {r('close / peak - 1', 'drawdown')},
  round(min(close / peak - 1) OVER (PARTITION BY symbol ORDER BY d), 6) AS max_drawdown FROM a"""))
def running_drawdowns(spark, sf):
    return ind.drawdowns(bars(spark, sf)).select(
        "symbol", day_text(), r6("peak", 7), r6("drawdown"), r6("max_drawdown"))


@query("cumulative_growth", with_(bars_sql("region"), RET, body=f"""
SELECT symbol, {DT}, round(product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY d), 5) AS growth
FROM ret"""))
def cumulative_growth(spark, sf):
    return ind.cumulative_growth(ind.returns(bars(spark, sf, "region"))).select(
        "symbol", day_text(), r6("growth", 5))


@query("volume_flow_slopes", with_(bars_sql(), f"""
a AS (SELECT symbol, d, row_number() OVER w AS i, CASE WHEN close < lag(close) OVER w THEN -volume ELSE volume END AS sv,
  CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS av FROM bars {W}),
b AS (SELECT symbol, i, sum(sv) OVER (PARTITION BY symbol ORDER BY i) AS obv,
  sum(av) OVER (PARTITION BY symbol ORDER BY i) AS adl FROM a)""", body="""
SELECT symbol, round(regr_slope(obv, i), 6) AS obv_slope, round(regr_slope(adl, i), 6) AS adl_slope FROM b GROUP BY 1"""))
def volume_flow_slopes(spark, sf):
    return ind.volume_flow(bars(spark, sf)).select("symbol", r6("obv_slope"), r6("adl_slope"))


PROX_SQL = """
prox AS (SELECT symbol, count(*) AS n_bars, max(close) AS high_close, arg_max(close, d) AS last_close,
  least(greatest((arg_max(close, d) / max(close) - 0.70) / 0.25, 0), 1) AS proximity FROM bars GROUP BY 1)"""
TREND_SQL = """
sl AS (SELECT symbol, -regr_slope(close, rn) / arg_max(close, d) AS slope_share FROM t0 GROUP BY 1),
trend AS (SELECT symbol, adx, slope_share, (tanh(CASE WHEN plus_di > minus_di THEN 1 ELSE -1 END * adx / 100
  * slope_share * 252) + 1) / 2 AS trend_score FROM sl JOIN adx USING (symbol))"""
MA_SQL = """
mas AS (SELECT symbol, CASE WHEN count(*) >= 200 THEN
  1 / (1 + exp(-20 * (avg(CASE WHEN rn <= 50 THEN close END) / avg(close) - 1))) END AS ma_score
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 200 GROUP BY 1)"""


@query("high_proximity", with_(bars_sql(), PROX_SQL, body=f"""
SELECT symbol, n_bars, {r('high_close', 'high_close', 7)}, {r('last_close', 'last_close', 7)}, {r('proximity', 'proximity')}
FROM prox"""))
def high_proximity(spark, sf):
    return ind.high_proximity(bars(spark, sf)).select(
        "symbol", "n_bars", r6("high_close", 7), r6("last_close", 7), r6("proximity"))


@query("trend_strength_score", with_(bars_sql(), *ADX_SQL, TREND_SQL, body=f"""
SELECT symbol, {r('adx', 'adx')}, {r('slope_share', 'slope_share')}, {r('trend_score', 'trend_score')} FROM trend"""))
def trend_strength_score(spark, sf):
    return ind.trend_strength(bars(spark, sf)).select(
        "symbol", r6("adx"), r6("slope_share"), r6("trend_score"))


@query("moving_average_score", with_(bars_sql(), MA_SQL, body=f"SELECT symbol, {r('ma_score', 'ma_score')} FROM mas"))
def moving_average_score(spark, sf):
    return ind.ma_score(bars(spark, sf)).select("symbol", r6("ma_score"))


TECH_SQL = (*ADX_SQL, PROX_SQL, TREND_SQL, MA_SQL, """
tech AS (SELECT symbol, n_bars, CASE WHEN n_bars < 200 THEN 0 ELSE 0.35 * proximity + 0.40 * coalesce(trend_score, 0)
  + 0.25 * coalesce(ma_score, 0.5) END AS technical FROM prox LEFT JOIN trend USING (symbol) LEFT JOIN mas USING (symbol))""")


@query("technical_factor", with_(bars_sql(), *TECH_SQL, body=f"""
SELECT symbol, n_bars, {r('technical', 'technical')} FROM tech"""))
def technical_factor(spark, sf):
    return ind.technical_score(bars(spark, sf)).select("symbol", "n_bars", r6("technical"))


MOM_SQL = """
mom AS (SELECT symbol, count(*) AS n_used, CASE WHEN count(*) >= 180 THEN arg_max(close, d) / arg_min(close, d) - 1 END
  AS momentum_12m FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars)
  WHERE rn <= 252 GROUP BY 1)"""


@query("year_price_momentum", with_(bars_sql(), MOM_SQL, body=f"""
SELECT symbol, n_used, {r('momentum_12m', 'momentum_12m')} FROM mom"""))
def year_price_momentum(spark, sf):
    return ind.year_momentum(bars(spark, sf)).select("symbol", "n_used", r6("momentum_12m"))


REV_COLS = ("z_10", "z_20", "momentum_decay", "rsi_proxy", "roc_5", "roc_10", "vol_10", "from_high", "from_low",
            "trend_r2", "reversion_speed")
REV_SQL = f"""
b0 AS (SELECT symbol, d, score AS x, row_number() OVER w AS i, score - lag(score) OVER w AS dx, lag(score) OVER w AS lx,
  lag(score, 4) OVER w AS x4, lag(score, 9) OVER w AS x9 FROM hist {W}),
b1 AS (SELECT *, list(dx) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS dl FROM b0),
b2 AS (SELECT symbol, d, i, x, dl,
  (x - avg(x) OVER f10) / CASE WHEN stddev_pop(x) OVER f10 > 0 THEN stddev_pop(x) OVER f10 ELSE 1 END AS z_10,
  (x - avg(x) OVER f21) / CASE WHEN stddev_pop(x) OVER f21 > 0 THEN stddev_pop(x) OVER f21 ELSE 1 END AS z_20,
  abs((x - x4) / x4) - abs((x4 - x9) / x9) AS momentum_decay,
  CASE WHEN avg(greatest(-dx, 0)) OVER f20 > 0 THEN 100 - 100 / (1 + avg(greatest(dx, 0)) OVER f20
    / avg(greatest(-dx, 0)) OVER f20) ELSE 50 END AS rsi_proxy,
  (x - x4) / x4 * 100 AS roc_5, (x - x9) / x9 * 100 AS roc_10, stddev_pop(x) OVER f10 AS vol_10,
  (max(x) OVER f20 - x) / max(x) OVER f20 AS from_high, (x - min(x) OVER f20) / min(x) OVER f20 AS from_low,
  power(corr(x, i) OVER f21, 2) AS trend_r2, -corr(lx, dx) OVER f20 AS reversion_speed
  FROM b1 WINDOW f10 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
   f20 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
   f21 AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
rev AS (SELECT *, CASE WHEN dl[9] > 0
  THEN (SELECT coalesce(max(j), 0) FROM (SELECT unnest(range(1, 10)) AS j) WHERE
        len(list_filter(dl[10 - j:9], lambda v: v > 0)) = j)
  ELSE -1 - (SELECT coalesce(max(j), 0) FROM (SELECT unnest(range(1, 9)) AS j) WHERE
        len(list_filter(dl[9 - j:8], lambda v: v < 0)) = j) END AS consecutive FROM b2 WHERE i > 20)"""


@query("reversion_features", with_(hist_sql(), REV_SQL, body=f"""
SELECT symbol, {DT}, {', '.join(r(c, c) for c in REV_COLS)}, consecutive FROM rev"""))
def reversion_features(spark, sf):
    return ind.reversion_features(score_history(spark, sf)).select(
        "symbol", day_text(), *[r6(c) for c in REV_COLS], "consecutive")


@query("reversion_labels", with_(hist_sql(), f"""
a AS (SELECT symbol, d, score AS x, row_number() OVER w AS i,
  avg(score) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m,
  min(score) OVER fo AS lo, max(score) OVER fo AS hi, count(*) OVER fo AS n FROM hist
  WINDOW w AS (PARTITION BY symbol ORDER BY d),
  fo AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))""", body=f"""
SELECT symbol, {DT}, CAST(CASE WHEN x > m THEN (x - lo) / x >= 0.05 ELSE (hi - x) / x >= 0.05 END AS INTEGER) AS reverted
FROM a WHERE i > 20 AND n = 10"""))
def reversion_labels(spark, sf):
    return ind.reversion_label(score_history(spark, sf)).select("symbol", day_text(), "reverted")


RECOVERY_SQL = """
q AS (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i,
  max(close) OVER (PARTITION BY symbol ORDER BY d) AS peak, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
deep AS (SELECT q.symbol, q.d, q.i, q.n, 1 - q.close / q.peak AS dd,
  min(f.i) - q.i AS t FROM q LEFT JOIN q f ON q.symbol = f.symbol AND f.i > q.i AND f.close >= 0.99 * q.peak
  WHERE 1 - q.close / q.peak > 0.05 GROUP BY q.symbol, q.d, q.i, q.n, q.close, q.peak),
rcv AS (SELECT symbol, n AS n_bars, count(deep.i) AS deep_bars,
  sum(dd * t) FILTER (deep.i <= deep.n - 19 AND t IS NOT NULL) / sum(dd) FILTER (deep.i <= deep.n - 19 AND t IS NOT NULL) AS mt
  FROM (SELECT DISTINCT symbol, n FROM q) u LEFT JOIN deep USING (symbol, n) GROUP BY 1, 2),
recv AS (SELECT symbol, n_bars, deep_bars, mt, CASE WHEN n_bars < 126 THEN 0.5 WHEN deep_bars = 0 THEN 0.8
  WHEN mt IS NULL THEN 0.3 ELSE least(greatest(1 - (mt - 10) / 50, 0), 1) END AS recovery FROM rcv)"""


@query("drawdown_recovery", with_(bars_sql(), RECOVERY_SQL, body=f"""
SELECT symbol, n_bars, deep_bars, {r('mt', 'mean_bars_to_recover')}, {r('recovery', 'recovery')} FROM recv"""))
def drawdown_recovery(spark, sf):
    return ind.recovery_score(shared_by(bars(spark, sf), ["symbol"], ["d"])).select(
        "symbol", "n_bars", "deep_bars", r6("mean_bars_to_recover"), r6("recovery"))
