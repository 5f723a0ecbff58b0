"""Registered queries: panels, covariance, weights, backtests, risk statistics."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import allocation as al
from factorspark.operators import backtest as bt
from factorspark.operators import cleaning as cl
from factorspark.operators import risk as rk
from factorspark.operators.indicators import returns
from factorspark.operators.selection import best_portfolios
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import DT, r
from factorspark.session import shared
from factorspark.sources import adapters as ad

# Region portfolios: three overlapping baskets of the five region series.
MEMBERS_SQL = """
mem(portfolio, symbol) AS (VALUES ('P0', 'R0'), ('P0', 'R1'), ('P0', 'R2'), ('P1', 'R1'), ('P1', 'R2'), ('P1', 'R3'), ('P1', 'R4'),
  ('P2', 'R0'), ('P2', 'R1'), ('P2', 'R2'), ('P2', 'R3'), ('P2', 'R4'))"""
BASKETS = {"P0": (0, 1, 2), "P1": (1, 2, 3, 4), "P2": (0, 1, 2, 3, 4)}
FILL_SQL = """
cal AS (SELECT d, row_number() OVER (ORDER BY d) AS session FROM (SELECT DISTINCT d FROM bars)),
fl0 AS (SELECT s.symbol, cal.d, cal.session, close, max(CASE WHEN close IS NOT NULL THEN session END) OVER (PARTITION BY s.symbol ORDER BY cal.d) AS own
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars ON bars.symbol = s.symbol AND bars.d = cal.d),
filled AS (SELECT symbol, d, session, coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d)) AS px, own <> session AS filled
  FROM fl0 WHERE own IS NOT NULL)"""
PANEL_SQL = (o.bars("region"), MEMBERS_SQL, FILL_SQL, """
fu AS (SELECT portfolio, mem.symbol, d, px FROM mem JOIN fl0 USING (symbol, ) JOIN filled USING (symbol, d) WHERE fl0.session - fl0.own <= 2),
pn AS (SELECT portfolio, symbol, d, px FROM fu QUALIFY count(*) OVER (PARTITION BY portfolio, d) = (SELECT count(*) FROM mem m WHERE m.portfolio = fu.portfolio)),
pi AS (SELECT *, dense_rank() OVER (PARTITION BY portfolio ORDER BY d) - 1 AS i FROM pn),
pr AS (SELECT *, px / lag(px) OVER (PARTITION BY portfolio, symbol ORDER BY d) - 1 AS ret FROM pi)""".replace("(symbol, )", "(symbol)"))


def members(bars):
    code = F.substring("symbol", 2, 4).cast("int")
    arr = F.array(*[F.when(code.isin(*v), F.lit(k)) for k, v in BASKETS.items()])
    return bars.select("symbol").distinct().select("symbol", F.explode(F.array_compact(arr)).alias("portfolio"))


def panel(spark, sf, lookbacks=(252,)):
    b = ad.closes(spark, sf, "region")
    return shared(al.price_panel(b, members(b), lookbacks))   # holdings x calendar, read several times


def brand_panel(spark, sf, lookbacks=(252,)):
    """Three baskets of brands (eight or nine names each)."""
    b = ad.closes(spark, sf, "brand")
    code = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    m = b.select("symbol").distinct().withColumn("portfolio", F.concat(F.lit("B"), (code % 3).cast("string")))
    return shared(al.price_panel(b, m, lookbacks))


def panel_returns(spark, sf):
    return bt.asset_returns(panel(spark, sf)).where("i > 0").select("portfolio", "d", "symbol", "ret")


@query("forward_filled_prices", with_(o.bars("region"), FILL_SQL, body=f"""
SELECT symbol, strftime(f.d, '%Y-%m-%d') AS d, round(px, 7) AS px, filled FROM filled f JOIN (SELECT symbol, d, session - own AS gap FROM fl0) g USING (symbol, d)
WHERE gap <= 2"""))
def forward_filled_prices(spark, sf):
    return cl.fill_forward(ad.closes(spark, sf, "region")).select("symbol", day_text(), F.round("close", 7).alias("px"), "filled")


@query("fully_filled_prices", with_(o.bars("brand"), FILL_SQL, body=f"""
SELECT s.symbol, strftime(cal.d, '%Y-%m-%d') AS d, round(coalesce(px, f1), 7) AS px FROM (SELECT symbol, arg_min(close, d) AS f1 FROM bars GROUP BY 1) s
CROSS JOIN cal LEFT JOIN filled ON filled.symbol = s.symbol AND filled.d = cal.d"""))
def fully_filled_prices(spark, sf):
    return cl.fill_forward(ad.closes(spark, sf, "brand"), limit=None, back=True).select(
        "symbol", day_text(), F.round("close", 7).alias("px"))


@query("complete_price_panel", with_(*PANEL_SQL, body=f"SELECT portfolio, symbol, {DT}, CAST(i AS INTEGER) AS i, round(px, 7) AS px FROM pi"))
def complete_price_panel(spark, sf):
    return panel(spark, sf).select("portfolio", "symbol", day_text(), "i", F.round("px", 7).alias("px"))


COV_SQL = """
rr AS (SELECT portfolio, symbol, d, ret, rank() OVER p + (count(*) OVER (PARTITION BY portfolio, symbol, ret) - 1) / 2.0 AS rk,
  ret - avg(ret) OVER (PARTITION BY portfolio, symbol) AS c FROM pr WHERE i > 0 WINDOW p AS (PARTITION BY portfolio, symbol ORDER BY ret)),
pq AS (SELECT a.portfolio, a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr, corr(a.rk, b.rk) AS spearman,
  count(*) AS n, sum(a.c * b.c) / count(*) AS s, sum(a.c * a.c * b.c * b.c) / count(*) AS q FROM rr a JOIN rr b
  ON a.portfolio = b.portfolio AND a.d = b.d AND a.symbol <= b.symbol GROUP BY 1, 2, 3),
lw AS (SELECT portfolio, count(*) FILTER (a = b) AS p, sum(s) FILTER (a = b) / count(*) FILTER (a = b) AS mu, max(n) AS n FROM pq GROUP BY 1),
ls AS (SELECT portfolio, mu, sum(CASE WHEN a = b THEN power(s - mu, 2) ELSE 2 * s * s END) AS d2,
  sum(CASE WHEN a = b THEN q - s * s ELSE 2 * (q - s * s) END) / max(lw.n) AS b2 FROM pq JOIN lw USING (portfolio) GROUP BY 1, 2),
lc AS (SELECT pq.*, (1 - least(b2, d2) / d2) * s + CASE WHEN a = b THEN least(b2, d2) / d2 * mu ELSE 0 END AS shrunk FROM pq JOIN ls USING (portfolio))"""


@query("covariance_matrices", with_(*PANEL_SQL, COV_SQL, body=f"""
SELECT portfolio, a, b, {r('cov', 'cov')}, {r('corr', 'corr')}, {r('spearman', 'spearman')}, {r('shrunk', 'shrunk')} FROM lc"""))
def covariance_matrices(spark, sf):
    return al.covariance_long(panel_returns(spark, sf)).select(
        "portfolio", "a", "b", r6("cov"), r6("corr"), r6("spearman"), r6("shrunk"))


@query("rolling_average_correlation", with_(*PANEL_SQL, """
pc AS (SELECT a.portfolio, a.d, a.symbol AS a, b.symbol AS b, CASE WHEN count(*) OVER w = 60 THEN corr(a.ret, b.ret) OVER w END AS c FROM pr a JOIN pr b
  ON a.portfolio = b.portfolio AND a.d = b.d AND a.symbol < b.symbol WHERE a.i > 0
  WINDOW w AS (PARTITION BY a.portfolio, a.symbol, b.symbol ORDER BY a.d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ac AS (SELECT portfolio, d, avg(c) AS avg_corr FROM pc WHERE c IS NOT NULL GROUP BY 1, 2)""", body=f"""
SELECT portfolio, {DT}, {r('avg_corr', 'avg_corr')}, round(CASE WHEN count(*) OVER h = 30 THEN stddev_samp(avg_corr) OVER h END, 6) AS corr_stability FROM ac
WINDOW h AS (PARTITION BY portfolio ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def rolling_average_correlation(spark, sf):
    return al.average_correlation(panel_returns(spark, sf)).select("portfolio", day_text(), r6("avg_corr"), r6("corr_stability"))


@query("correlation_spectrum")
def correlation_spectrum(spark, sf):
    return al.correlation_spectrum(panel_returns(spark, sf)).select("portfolio", "component", r6("eigenvalue"), r6("explained"))


@query("correlation_spectrum_moments", with_(*PANEL_SQL, """
lw AS (SELECT portfolio, symbol, d, ret FROM pr WHERE i > 0 AND i > (SELECT max(i) - 60 FROM pr q WHERE q.portfolio = pr.portfolio)),
lc AS (SELECT a.portfolio, a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS c FROM lw a JOIN lw b ON a.portfolio = b.portfolio AND a.d = b.d GROUP BY 1, 2, 3)""", body=f"""
SELECT portfolio, CAST(count(*) FILTER (a = b) AS BIGINT) AS names, {r('sum(c) FILTER (a = b)', 'trace')}, {r('sum(c * c)', 'squares')},
  {r('sum(c * c) / power(count(*) FILTER (a = b), 2)', 'concentration')} FROM lc GROUP BY 1"""))
def correlation_spectrum_moments(spark, sf):
    """Sums of the eigenvalues and of their squares: the trace of the correlation matrix and the sum of its squared entries."""
    ev = F.col("eigenvalue")
    return al.correlation_spectrum(panel_returns(spark, sf)).groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("names"), F.sum(ev).alias("trace"), F.sum(ev * ev).alias("squares"), F.sum(F.col("explained") ** 2).alias("concentration")).select(
        "portfolio", "names", r6("trace"), r6("squares"), r6("concentration"))


EQ_SQL = "eq AS (SELECT portfolio, d, avg(ret) AS ret FROM pr WHERE i > 0 GROUP BY 1, 2)"


def equal_weight(spark, sf):
    return panel_returns(spark, sf).groupBy("portfolio", "d").agg(F.avg("ret").alias("ret"))


PERF_SQL = """
pg AS (SELECT portfolio, d, ret, product(1 + ret) OVER w AS g FROM eq WINDOW w AS (PARTITION BY portfolio ORDER BY d)),
pd AS (SELECT *, max(g) OVER (PARTITION BY portfolio ORDER BY d) AS peak, g / max(g) OVER (PARTITION BY portfolio ORDER BY d) - 1 AS dd FROM pg),
pf AS (SELECT portfolio, count(*) AS n_days, arg_max(g, d) - 1 AS total_return, power(arg_max(g, d), 252.0 / count(*)) - 1 AS annual_return,
  stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
  avg(ret) / sqrt(avg(power(least(ret, 0), 2))) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM pd GROUP BY 1)"""


def sig(c, digits=8):
    """Nine significant digits: compounded growth can be very large."""
    return F.format_string("%.6e", F.col(c)).alias(c)


@query("performance_metrics", with_(*PANEL_SQL, EQ_SQL, PERF_SQL, body=f"""
SELECT portfolio, n_days, printf('%.6e', total_return) AS total_return, printf('%.6e', annual_return) AS annual_return, {r('volatility', 'volatility')},
  {r('sharpe', 'sharpe')}, {r('sortino', 'sortino')}, {r('max_drawdown', 'max_drawdown')}, printf('%.6e', annual_return / abs(max_drawdown)) AS calmar FROM pf"""))
def performance_metrics(spark, sf):
    return rk.performance(equal_weight(spark, sf), ["portfolio"]).select(
        "portfolio", "n_days", sig("total_return"), sig("annual_return"), r6("volatility"), r6("sharpe"), r6("sortino"),
        r6("max_drawdown"), sig("calmar"))


@query("quick_portfolio_metrics", with_(o.bars("region"), MEMBERS_SQL, """
rt AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM bars),
eq AS (SELECT portfolio, d, avg(ret) AS ret FROM rt JOIN mem USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2
  HAVING count(*) = CASE portfolio WHEN 'P0' THEN 3 WHEN 'P1' THEN 4 ELSE 5 END)""", PERF_SQL, body=f"""
SELECT portfolio, n_days, printf('%.6e', annual_return) AS annual_return, printf('%.6e', annual_return / volatility) AS quick_sharpe,
  {r('max_drawdown', 'max_drawdown')} FROM pf"""))
def quick_portfolio_metrics(spark, sf):
    b = ad.closes(spark, sf, "region")
    return rk.quick_metrics(returns(b), members(b)).select(
        "portfolio", "n_days", sig("annual_return"), sig("quick_sharpe"), r6("max_drawdown"))


@query("best_portfolios_by_sharpe", with_(*PANEL_SQL, EQ_SQL, PERF_SQL, body=f"SELECT portfolio, {r('sharpe', 'sharpe')} FROM pf ORDER BY sharpe DESC LIMIT 2"))
def best_portfolios_by_sharpe(spark, sf):
    return best_portfolios(rk.performance(equal_weight(spark, sf), ["portfolio"]), "sharpe", 2).select("portfolio", r6("sharpe"))


@query("best_portfolios_by_drawdown", with_(*PANEL_SQL, EQ_SQL, PERF_SQL, body=f"""
SELECT portfolio, {r('max_drawdown', 'max_drawdown')} FROM pf ORDER BY abs(max_drawdown) LIMIT 2"""))
def best_portfolios_by_drawdown(spark, sf):
    return best_portfolios(rk.performance(equal_weight(spark, sf), ["portfolio"]), "max_drawdown", 2).select(
        "portfolio", r6("max_drawdown"))


TAIL_SQL = """
m0 AS (SELECT portfolio, avg(ret) AS mu FROM eq GROUP BY 1),
m1 AS (SELECT portfolio, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5) AS skewness,
  avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) - 3 AS kurtosis, quantile_cont(ret, 0.05) AS var_95, quantile_cont(ret, 0.01) AS var_99,
  quantile_cont(ret, 0.95) FILTER (ret > 0) AS up, quantile_cont(ret, 0.05) FILTER (ret < 0) AS down FROM eq JOIN m0 USING (portfolio) GROUP BY 1),
m2 AS (SELECT portfolio, avg(ret) FILTER (ret <= var_95) AS cvar_95, avg(ret) FILTER (ret <= var_99) AS cvar_99 FROM eq JOIN m1 USING (portfolio) GROUP BY 1),
m3 AS (SELECT portfolio, quantile_cont(dd, 0.05) AS cdar_95, quantile_cont(dd, 0.01) AS cdar_99 FROM pd GROUP BY 1),
z(l, z) AS (VALUES (95, -1.6448536269514722::DOUBLE), (99, -2.3263478740408408::DOUBLE)),
m4 AS (SELECT portfolio, max(mean + std * z) FILTER (l = 95) AS vn95, max(mean + std * z) FILTER (l = 99) AS vn99,
  max(mean + std * (z + (z * z - 1) * skewness / 6 + (z * z * z - 3 * z) * kurtosis / 24 - (2 * z * z * z - 5 * z) * skewness * skewness / 36)) FILTER (l = 95) AS va95,
  max(mean + std * (z + (z * z - 1) * skewness / 6 + (z * z * z - 3 * z) * kurtosis / 24 - (2 * z * z * z - 5 * z) * skewness * skewness / 36)) FILTER (l = 99) AS va99
  FROM m1, z GROUP BY 1)"""


@query("tail_risk_report", with_(*PANEL_SQL, EQ_SQL, PERF_SQL, TAIL_SQL, body=f"""
SELECT portfolio, {', '.join(r(c, c, 5) for c in rk.TAIL_COLS[:10])}, {r('vn95', 'var_normal_95', 5)}, {r('vn99', 'var_normal_99', 5)},
  {r('va95', 'var_adjusted_95', 5)}, {r('va99', 'var_adjusted_99', 5)}, {r('up / abs(down)', 'tail_ratio', 5)},
  {r('n / 6 * (skewness * skewness + kurtosis * kurtosis / 4)', 'jarque_bera', 4)},
  {r('exp(-(n / 6 * (skewness * skewness + kurtosis * kurtosis / 4)) / 2)', 'jarque_bera_p', 5)}
FROM m1 JOIN m2 USING (portfolio) JOIN m3 USING (portfolio) JOIN m4 USING (portfolio)"""))
def tail_risk_report(spark, sf):
    return rk.tail_risk(equal_weight(spark, sf), ["portfolio"]).select(
        "portfolio", *[r6(c, 4 if c == "jarque_bera" else 5) for c in rk.TAIL_COLS])


@query("drawdown_durations", with_(*PANEL_SQL, EQ_SQL, PERF_SQL, """
lo AS (SELECT portfolio, arg_min(d, dd) AS trough, arg_min(peak, dd) AS pk, max(d) AS fin FROM pd GROUP BY 1),
du AS (SELECT portfolio, trough, fin, min(d) FILTER (d <= trough AND g >= pk) AS p0, min(d) FILTER (d >= trough AND g >= pk) AS r0 FROM pd JOIN lo USING (portfolio)
  GROUP BY 1, 2, 3)""", body="""
SELECT portfolio, strftime(trough, '%Y-%m-%d') AS trough, strftime(p0, '%Y-%m-%d') AS peak_day, strftime(r0, '%Y-%m-%d') AS recovered,
  CAST(datediff('day', p0, coalesce(r0, fin)) AS INTEGER) AS duration_days FROM du"""))
def drawdown_durations(spark, sf):
    return rk.drawdown_duration(equal_weight(spark, sf), ["portfolio"]).select(
        "portfolio", day_text("trough"), day_text("peak_day"), day_text("recovered"), "duration_days")


def _brand(sql: str) -> str:
    """The fill of the region series once more for the brands, under names of its own."""
    return re.sub(r"\b(bars|cal|fl0|filled(?= AS \())\b", r"b_\1", sql)


N_FACTORS = 10
ATTRIBUTION_SQL = (_brand(o.bars("brand")), _brand(FILL_SQL), f"""
fk AS (SELECT symbol, row_number() OVER (ORDER BY sum(volume) DESC, symbol) AS k FROM b_bars GROUP BY 1 QUALIFY k <= {N_FACTORS}),
fr AS (SELECT symbol, d, px / lag(px) OVER (PARTITION BY symbol ORDER BY d) - 1 AS x FROM b_filled JOIN b_fl0 USING (symbol, d, session)
  WHERE b_fl0.session - own <= 2),
fx AS (SELECT d, list(x ORDER BY k) AS x FROM fr JOIN fk USING (symbol) WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) = {N_FACTORS}),
yx AS (SELECT portfolio, d, avg(ret) AS y, any_value(x) AS x FROM pr JOIN fx USING (d) WHERE i > 0 GROUP BY 1, 2),
ux AS (SELECT portfolio, d, y, unnest(x) AS x, unnest(range(1, {N_FACTORS + 1})) AS k FROM yx),
mx AS (SELECT portfolio, k, avg(x) AS m, covar_pop(x, y) AS cy FROM ux GROUP BY 1, 2),
cx AS (SELECT a.portfolio, a.k AS i, b.k AS j, covar_pop(a.x, b.x) AS c FROM ux a JOIN ux b USING (portfolio, d) GROUP BY 1, 2, 3),
-- rows of the normal equations with the right side as the last column, solved by elimination, one unknown a step
eq0 AS (SELECT cx.portfolio, i, list_append(list(c ORDER BY j), any_value(cy)) AS eqn FROM cx JOIN mx ON mx.portfolio = cx.portfolio AND mx.k = cx.i GROUP BY 1, 2),
el(portfolio, step, m) AS (SELECT portfolio, 0, list(eqn ORDER BY i) FROM eq0 GROUP BY 1 UNION ALL
  SELECT portfolio, step + 1, list_transform(range(1, {N_FACTORS + 1}), lambda i: list_transform(range(1, {N_FACTORS + 2}), lambda j: CASE WHEN i = step + 1
    THEN m[step + 1][j] / m[step + 1][step + 1] ELSE m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] END)) FROM el WHERE step < {N_FACTORS}),
be AS (SELECT portfolio, unnest(range(1, {N_FACTORS + 1})) AS k, unnest(list_transform(m, lambda v: v[{N_FACTORS + 1}])) AS b FROM el WHERE step = {N_FACTORS}),
ay AS (SELECT portfolio, avg(y) AS my, var_pop(y) AS vy FROM yx GROUP BY 1),
ab AS (SELECT portfolio, sum(b * m) AS bm, sum(b * cy) AS bc FROM be JOIN mx USING (portfolio, k) GROUP BY 1)""")


@query("factor_attribution", with_(*PANEL_SQL, *ATTRIBUTION_SQL, recursive=True, body=f"""
SELECT portfolio, symbol AS factor, {r('b', 'exposure')}, {r('b * m * 252', 'contribution', 5)}, {r('(my - bm) * 252', 'alpha', 5)}, {r('bc / vy', 'r2')},
  {r('my * 252', 'total_return', 5)}, {r('(my - bm) * 252', 'residual_return', 5)}
FROM be JOIN mx USING (portfolio, k) JOIN fk USING (k) JOIN ay USING (portfolio) JOIN ab USING (portfolio)"""))
def factor_attribution(spark, sf):
    """The equal-weight return of every portfolio by the ten brands with the largest volume."""
    bars = shared(ad.bars(spark, sf, "brand"))
    first = Window.orderBy(F.desc("v"), F.asc("symbol"))        # one row for each brand
    listed = shared(bars.groupBy("symbol").agg(F.sum("volume").alias("v")).select("symbol", F.row_number().over(first).alias("k")).where(
        F.col("k") <= N_FACTORS).select("symbol", F.concat(F.lit("x"), "k").alias("factor")))
    filled = returns(cl.fill_forward(bars.select("symbol", "d", "close"))).join(listed, "symbol")
    names = [f"x{k}" for k in range(1, N_FACTORS + 1)]
    wide = filled.groupBy("d").agg(*[F.max(F.when(F.col("factor") == x, F.col("ret"))).alias(x) for x in names])
    found = rk.factor_attribution(equal_weight(spark, sf), wide, names, ["portfolio"]).join(listed, "factor")
    return found.select("portfolio", F.col("symbol").alias("factor"), r6("exposure"), r6("contribution", 5), r6("alpha", 5), r6("r2"),
                        r6("total_return", 5), r6("residual_return", 5))


PW_SQL = "pw AS (SELECT portfolio, d, sum(px) AS value FROM pi GROUP BY 1, 2)"


def index_value(spark, sf):
    return panel(spark, sf).groupBy("portfolio", "d").agg(F.sum("px").alias("value"))


@query("rebased_comparison", with_(*PANEL_SQL, PW_SQL, body=f"""
SELECT portfolio, {DT}, round((value / first_value(value) OVER (PARTITION BY portfolio ORDER BY d) - 1) * 100, 6) AS since_start FROM pw"""))
def rebased_comparison(spark, sf):
    return rk.rebased(index_value(spark, sf), ["portfolio"]).select("portfolio", day_text(), r6("since_start"))


@query("period_returns", with_(*PANEL_SQL, PW_SQL, """
le AS (SELECT portfolio, max(d) AS e, min(d) AS s FROM pw GROUP BY 1),
wn AS (SELECT portfolio, w.* FROM le, LATERAL (VALUES ('1W', e - 7), ('1M', CAST(e - INTERVAL 1 MONTH AS DATE)), ('3M', CAST(e - INTERVAL 3 MONTH AS DATE)),
  ('6M', CAST(e - INTERVAL 6 MONTH AS DATE)), ('YTD', CAST(date_trunc('year', e) AS DATE)), ('1Y', CAST(e - INTERVAL 12 MONTH AS DATE)), ('ALL', s)) w("window", cutoff))""",
                               body=f"""
SELECT portfolio, "window", count(*) AS points, round(arg_max(value, d) / arg_min(value, d) - 1, 6) AS period_return FROM pw JOIN wn USING (portfolio)
WHERE d >= cutoff GROUP BY 1, 2 HAVING count(*) >= 2"""))
def period_returns(spark, sf):
    return rk.period_returns(index_value(spark, sf), ["portfolio"]).select("portfolio", "window", "points", r6("period_return"))


WM_SQL = """
we AS (SELECT portfolio, symbol, row_number() OVER (PARTITION BY portfolio ORDER BY symbol) * 1.0 / sum(1) OVER (PARTITION BY portfolio) AS u FROM mem),
wt AS (SELECT portfolio, symbol, u / sum(u) OVER (PARTITION BY portfolio) AS w FROM we)"""


def graded_weights(p):
    w = Window.partitionBy("portfolio").orderBy("symbol")
    m = p.select("portfolio", "symbol").distinct().withColumn("u", F.row_number().over(w).cast("double"))
    return m.withColumn("w", F.col("u") / F.sum("u").over(Window.partitionBy("portfolio")))


@query("portfolio_weight_metrics", with_(*PANEL_SQL, COV_SQL, WM_SQL, """
rw AS (SELECT portfolio, avg(x) * 252 AS annual_return FROM (SELECT portfolio, d, sum(w * ret) AS x FROM pr JOIN wt USING (portfolio, symbol) WHERE i > 0 GROUP BY 1, 2) GROUP BY 1),
vw AS (SELECT lc.portfolio, sqrt(sum(CASE WHEN a = b THEN 1 ELSE 2 END * x.w * y.w * shrunk) * 252) AS vol FROM lc JOIN wt x ON x.portfolio = lc.portfolio AND x.symbol = a
  JOIN wt y ON y.portfolio = lc.portfolio AND y.symbol = b GROUP BY 1)""", body=f"""
SELECT portfolio, {r('annual_return', 'annual_return')}, {r('vol', 'annual_volatility')}, {r('annual_return / vol', 'sharpe')}, {r('max(w)', 'max_weight')},
  {r('min(w)', 'min_weight')}, {r('sum(w * w)', 'herfindahl')}, {r('1 / sum(w * w)', 'effective_n')} FROM rw JOIN vw USING (portfolio) JOIN wt USING (portfolio)
GROUP BY portfolio, annual_return, vol"""))
def portfolio_weight_metrics(spark, sf):
    p = panel_returns(spark, sf)
    cov = al.covariance_long(p).select("portfolio", "a", "b", F.col("shrunk").alias("cov"))
    return al.weight_metrics(graded_weights(p), p, cov).select(
        "portfolio", *[r6(c) for c in ("annual_return", "annual_volatility", "sharpe", "max_weight", "min_weight", "herfindahl", "effective_n")])


@query("view_adjusted_covariance")
def view_adjusted_covariance(spark, sf):
    p = panel_returns(spark, sf)
    views = p.select("portfolio", "symbol").distinct().where("symbol in ('R1', 'R3')")
    return al.posterior_covariance(al.covariance_long(p), views).select("portfolio", "a", "b", r6("cov"))


START = 300   # first backtest row: a look-back of history lies before it


def _quarter_weights(spark, sf, method):
    p = brand_panel(spark, sf)
    return al.weights_at(p, al.trailing_solves(p, F.col("i") % 63 == 0), method)


for _m in ("hrp", "mhrp", "mhrp_vol", "nco"):
    def _weights(spark, sf, m=_m):
        return _quarter_weights(spark, sf, m).select("portfolio", day_text(), "symbol", r6("w"))
    query({"hrp": "hierarchical_risk_parity_weights", "mhrp": "equal_volatility_bisection_weights",
           "mhrp_vol": "inverse_volatility_bisection_weights", "nco": "nested_cluster_weights"}[_m])(_weights)


def _bt(df):
    return df.select("portfolio", "lookback", day_text(), r6("ret"), "rebalanced", F.format_string("%.6e", "value").alias("value"))


# The relational part of a backtest with weights given: quarter-start weights graded by name.
@query("backtest_with_given_weights", with_(*PANEL_SQL, WM_SQL, """
b0 AS (SELECT portfolio, symbol, d, i, CASE WHEN i > 300 THEN ret ELSE 0 END AS ret FROM pr WHERE i >= 300),
b1 AS (SELECT b0.*, max(CASE WHEN i % 63 = 0 THEN i END) OVER (PARTITION BY portfolio, symbol ORDER BY i) AS li, wt.w, count(*) OVER (PARTITION BY portfolio, i) AS n
  FROM b0 JOIN wt USING (portfolio, symbol)),
b2 AS (SELECT portfolio, d, i, sum(CASE WHEN li IS NULL THEN 1.0 / n ELSE w END * ret) - CASE WHEN i % 63 = 0 AND i > 300 THEN 0.001 ELSE 0 END AS ret FROM b1 GROUP BY 1, 2, 3)""",
                                            body=f"""
SELECT portfolio, 252 AS lookback, {DT}, round(CASE WHEN i = 300 THEN 0 ELSE ret END, 6) AS ret, i % 63 = 0 AS rebalanced,
  printf('%.6e', product(1 + CASE WHEN i = 300 THEN 0 ELSE ret END) OVER (PARTITION BY portfolio ORDER BY i)) AS value FROM b2"""))
def backtest_with_given_weights(spark, sf):
    p = panel(spark, sf)
    marks = p.where("i % 63 = 0").select("portfolio", "lookback", "d", "symbol")
    w = marks.join(graded_weights(p).select("portfolio", "symbol", "w"), ["portfolio", "symbol"])
    return _bt(bt.backtest(p, w, START))


DAYS_SQL = "dy AS (SELECT DISTINCT portfolio, d, i FROM pi)"
SOLVES_SQL = f"""SELECT portfolio, 252 AS lookback, {DT}, CAST(greatest(i - 252, 0) AS INTEGER) AS w0, CAST(i AS INTEGER) AS w1"""
FIRST_SQL = f"""SELECT portfolio, 252 AS lookback, {DT}, 0 AS w0, 252 AS w1 FROM dy WHERE i = {START}"""


def _solves(df):
    return df.select("portfolio", "lookback", day_text(), F.col("w0").cast("int").alias("w0"), F.col("w1").cast("int").alias("w1"))


@query("monthly_rebalance_schedule", with_(*PANEL_SQL, DAYS_SQL, body=f"""
{SOLVES_SQL} FROM dy WHERE i >= {START} AND d = last_day(d) - CAST(greatest(isodow(last_day(d)) - 5, 0) AS INTEGER) AND i - greatest(i - 252, 0) >= 126"""))
def monthly_rebalance_schedule(spark, sf):
    """Business month ends among the panel's dates, with the rows each solve uses."""
    return _solves(bt.monthly_solves(panel(spark, sf), START))


DRIFT_SQL = f"""{SOLVES_SQL} FROM dy WHERE i > {START} + 21 AND (i - {START}) % 21 = 0 AND i - greatest(i - 252, 0) > 126 UNION ALL {FIRST_SQL}"""


@query("drift_rebalance_schedule", with_(*PANEL_SQL, DAYS_SQL, body=DRIFT_SQL))
def drift_rebalance_schedule(spark, sf):
    return _solves(bt.drift_solves(panel(spark, sf), START))


@query("drift_acceptance_with_given_weights", with_(*PANEL_SQL, DAYS_SQL, """
cd AS (SELECT dy.portfolio, d, dy.i, symbol, row_number() OVER (PARTITION BY dy.portfolio, dy.i ORDER BY symbol) AS j, count(*) OVER (PARTITION BY dy.portfolio, dy.i) AS n
  FROM dy JOIN pi USING (portfolio, d) WHERE dy.i = 300 OR (dy.i > 321 AND (dy.i - 300) % 21 = 0)),
cl AS (SELECT portfolio, d, i, list(u / s ORDER BY symbol) AS ws, list(symbol ORDER BY symbol) AS names, row_number() OVER (PARTITION BY portfolio ORDER BY i) AS k
  FROM (SELECT *, sum(u) OVER (PARTITION BY portfolio, i) AS s FROM (SELECT *, n + 2.0 + (j * (1 + (i // 63) % 3)) % n AS u FROM cd)) GROUP BY portfolio, d, i),
ac(portfolio, k, cur, took) AS (SELECT portfolio, k, ws, true FROM cl WHERE k = 1 UNION ALL
  SELECT cl.portfolio, cl.k, CASE WHEN list_max(list_transform(range(1, len(ws) + 1), lambda x: abs(ws[x] - cur[x]))) > 0.05 THEN ws ELSE cur END,
    list_max(list_transform(range(1, len(ws) + 1), lambda x: abs(ws[x] - cur[x]))) > 0.05 FROM ac JOIN cl ON cl.portfolio = ac.portfolio AND cl.k = ac.k + 1)""",
                                                     recursive=True, body=f"""
SELECT portfolio, {DT}, unnest(names) AS symbol, round(unnest(ws), 6) AS w FROM cl JOIN ac USING (portfolio, k) WHERE took"""))
def drift_acceptance_with_given_weights(spark, sf):
    """Candidates that turn round now and then, on the days of the drift schedule."""
    p = panel(spark, sf)
    k = F.col("i") - START
    n = p.groupBy("portfolio").agg(F.count_distinct("symbol").alias("n"))
    at = p.where((k == 0) | ((k > 21) & (k % 21 == 0))).join(n, "portfolio")
    j = F.row_number().over(Window.partitionBy("portfolio", "i").orderBy("symbol"))
    u = at.withColumn("u", F.col("n") + 2.0 + (j * (1 + F.floor(F.col("i") / 63) % 3)) % F.col("n"))
    w = F.col("u") / F.sum("u").over(Window.partitionBy("portfolio", "i"))
    given = u.select("portfolio", "lookback", "d", "symbol", w.alias("w"))
    return bt.accepted(given).select("portfolio", day_text(), "symbol", r6("w"))


@query("volatility_rebalance_schedule", with_(*PANEL_SQL, DAYS_SQL, f"""
ev AS (SELECT portfolio, d, i, avg(ret) AS r FROM pr WHERE i > {START} GROUP BY 1, 2, 3),
ew AS (SELECT *, CASE WHEN count(r) OVER f = 21 THEN stddev_samp(r) OVER f END AS vol, row_number() OVER (PARTITION BY portfolio ORDER BY i) - 1 AS j FROM ev
  WINDOW f AS (PARTITION BY portfolio ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
eh AS (SELECT *, lag(vol) OVER (PARTITION BY portfolio ORDER BY i) AS pv FROM ew)""", body=f"""
{SOLVES_SQL} FROM eh WHERE j > 21 AND abs((vol - pv) / pv) > 0.2 AND i - greatest(i - 252, 0) > 126 UNION ALL {FIRST_SQL}"""))
def volatility_rebalance_schedule(spark, sf):
    return _solves(bt.volatility_solves(panel(spark, sf), START))


@query("walk_forward_schedule", with_(*PANEL_SQL, DAYS_SQL, f"""
fo AS (SELECT dy.*, lead(dy.i) OVER (PARTITION BY portfolio ORDER BY dy.i) AS nx FROM dy JOIN (SELECT portfolio, d AS d0 FROM dy WHERE i = {START}) z USING (portfolio)
  WHERE d >= d0 AND datediff('day', d0, d) % 90 = 0)""", body=f"""
SELECT portfolio, 252 AS lookback, {DT}, CAST(greatest(i - 252, 0) AS INTEGER) AS w0, CAST(i AS INTEGER) AS w1, CAST(nx AS INTEGER) AS next_i FROM fo WHERE nx IS NOT NULL"""))
def walk_forward_schedule(spark, sf):
    f = bt.walk_forward_folds(panel(spark, sf), START)
    return f.select("portfolio", "lookback", day_text(), *[F.col(c).cast("int").alias(c) for c in ("w0", "w1", "next_i")])


@query("monthly_rebalance_backtest")
def monthly_rebalance_backtest(spark, sf):
    p = brand_panel(spark, sf)
    return _bt(bt.backtest(p, bt.monthly_weights(p, START), START))


@query("drift_rebalance_backtest")
def drift_rebalance_backtest(spark, sf):
    p = brand_panel(spark, sf)
    return _bt(bt.backtest(p, bt.drift_weights(p, START), START))


@query("volatility_rebalance_backtest")
def volatility_rebalance_backtest(spark, sf):
    p = brand_panel(spark, sf)
    return _bt(bt.backtest(p, bt.volatility_weights(p, START), START))


@query("walk_forward_summary")
def walk_forward_summary(spark, sf):
    daily = bt.walk_forward(brand_panel(spark, sf), START)
    out = bt.walk_forward_summary(daily)
    return out.select("portfolio", *[r6(c) for c in ("in_sharpe", "out_sharpe", "in_volatility", "out_volatility", "sharpe_degradation")])


@query("rebalance_suggestions", with_(*PANEL_SQL, WM_SQL, """
lp AS (SELECT symbol, arg_max(close, d) AS price FROM bars GROUP BY 1),
ho AS (SELECT portfolio, symbol, (CAST(substr(symbol, 2) AS INTEGER) + 1) * 10.0 AS shares FROM mem),
hv AS (SELECT portfolio, symbol, shares * price / sum(shares * price) OVER (PARTITION BY portfolio) AS cw FROM ho JOIN lp USING (symbol))""", body=f"""
SELECT portfolio, symbol, {r('w', 'target_weight')}, {r('cw', 'current_weight')}, {r('w - cw', 'difference')},
  CASE WHEN w - cw > 0.05 THEN 'Buy' WHEN w - cw < -0.05 THEN 'Sell' ELSE 'Keep' END AS action FROM wt JOIN hv USING (portfolio, symbol)"""))
def rebalance_suggestions(spark, sf):
    b = ad.closes(spark, sf, "region")
    m = members(b)
    hold = m.withColumn("shares", (F.substring("symbol", 2, 4).cast("int") + 1) * 10.0)
    return al.rebalance_suggestions(hold, b, graded_weights(m)).select(
        "portfolio", "symbol", r6("target_weight"), r6("current_weight"), r6("difference"), "action")
