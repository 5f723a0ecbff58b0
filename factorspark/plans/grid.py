"""Registered queries: backtests of the portfolios that selection makes, and the co-moments they share."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import grid_backtest as gb
from factorspark.operators import risk as rk
from factorspark.operators import selection as sel
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.selection import GRID_SQL, KEYS, pool
from factorspark.plans.technical import r
from factorspark.session import shared
from factorspark.sources import adapters as ad

LOOKBACKS = (252, 504, 756)
SCHEDULE = gb.Schedule(start=798, lookbacks=LOOKBACKS)


def grid_members(spark, sf):
    """Members of every strategy, size, pool and snapshot of the grid."""
    return sel.portfolio_grid(pool(spark, sf), KEYS).select("as_of", "portfolio", "symbol")


def setting(spark, sf):
    baskets, portfolios = gb.baskets_of(grid_members(spark, sf), ["as_of", "portfolio"])
    baskets = shared(baskets)
    return gb.universe(ad.closes(spark, sf), baskets), baskets, portfolios


UNIVERSE_SQL = ("bars AS (SELECT * FROM bars0 WHERE symbol IN (SELECT symbol FROM grid))", """
cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM bars)),
ux AS (SELECT s.symbol, cal.d, cal.i, last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY cal.i) AS px
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars ON bars.symbol = s.symbol AND bars.d = cal.d),
ur AS (SELECT symbol, d, i, px, px / lag(px) OVER (PARTITION BY symbol ORDER BY i) - 1 AS ret FROM ux WHERE px IS NOT NULL)""")
BARS0 = o.bars().replace("bars AS (", "bars0 AS (", 1)


@query("grid_comoments", with_(*GRID_SQL, BARS0, *UNIVERSE_SQL, f"""
lb(lookback) AS (VALUES {', '.join(f'({n})' for n in LOOKBACKS)}),
wr AS (SELECT lookback, symbol, i, ret, rank() OVER p + (count(*) OVER (PARTITION BY lookback, symbol, ret) - 1) / 2.0 AS rk
  FROM ur JOIN lb ON i > (SELECT max(i) FROM cal) - lookback + 1 WHERE ret IS NOT NULL WINDOW p AS (PARTITION BY lookback, symbol ORDER BY ret)),
pc AS (SELECT a.lookback, a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) AS cov, corr(a.rk, b.rk) AS spearman FROM wr a JOIN wr b
  ON a.lookback = b.lookback AND a.i = b.i AND a.symbol <= b.symbol GROUP BY 1, 2, 3 HAVING count(*) = a.lookback - 1)""", body=f"""
SELECT lookback, a, b, {r('cov', 'cov')}, round(CASE WHEN a = b THEN 1 WHEN isnan(spearman) THEN 0 ELSE coalesce(spearman, 0) END, 6) AS spearman FROM pc"""))
def grid_comoments(spark, sf):
    """Covariance and rank correlation of all pairs of names in the grid over the latest windows."""
    u, _, _ = setting(spark, sf)
    return gb.latest_moments(u, LOOKBACKS).select("lookback", "a", "b", r6("cov"), r6("spearman"))


def _scores(daily, portfolios):
    """Figures of each basket, back to all its portfolios."""
    found = rk.performance(daily.where(f"i > {SCHEDULE.start}"), ["basket", "lookback"])
    turns = daily.groupBy("basket", "lookback").agg(F.count_if("rebalanced").alias("rebalances"))
    out = portfolios.join(found.join(turns, ["basket", "lookback"]), "basket")
    return out.select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "portfolio", "lookback", "n_days", "rebalances",
                      *[r6(c) for c in ("volatility", "sharpe", "max_drawdown")])


@query("portfolio_grid_backtest")
def portfolio_grid_backtest(spark, sf):
    """Every portfolio of the grid and every look-back in one job, drift rebalanced."""
    daily, portfolios = gb.grid_backtest(ad.closes(spark, sf), grid_members(spark, sf), ["as_of", "portfolio"], SCHEDULE)
    return _scores(shared(daily), portfolios)


# The relational part with weights given: every quarter weights that fall with the place of a name, turned round each time.
@query("grid_backtest_with_given_weights", with_(*GRID_SQL, BARS0, *UNIVERSE_SQL, """
bk AS (SELECT as_of, portfolio, list_sort(list(DISTINCT symbol)) AS names FROM grid GROUP BY 1, 2),
bu AS (SELECT DISTINCT names FROM bk),
mb AS (SELECT names, unnest(names) AS symbol, unnest(range(1, len(names) + 1)) AS j, len(names) AS n FROM bu),
bg AS (SELECT names, greatest(max(f), 798) AS begin FROM mb JOIN (SELECT symbol, min(i) AS f FROM ur GROUP BY 1) USING (symbol) GROUP BY 1),
dy AS (SELECT names, i, begin, coalesce(sum(coalesce(ret, 0) * CASE WHEN i < 819 THEN 1.0 / n WHEN (i // 63) % 2 = 1 THEN j ELSE n + 1 - j END
    / CASE WHEN i < 819 THEN 1.0 ELSE n * (n + 1) / 2.0 END), 0) AS gross
  FROM mb JOIN bg USING (names) JOIN ur USING (symbol) WHERE i >= begin GROUP BY 1, 2, 3),
rt AS (SELECT names, i, CASE WHEN i = begin THEN 0 ELSE gross - CASE WHEN i % 63 = 0 AND i >= 819 THEN 0.001 ELSE 0 END END AS ret, i % 63 = 0 AND i >= 819 AS turn FROM dy),
gr AS (SELECT *, product(1 + ret) OVER (PARTITION BY names ORDER BY i) AS g FROM rt WHERE i > 798),
dd AS (SELECT *, g / max(g) OVER (PARTITION BY names ORDER BY i) - 1 AS fall FROM gr),
pf AS (SELECT names, count(*) AS n_days, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, min(fall) AS max_drawdown,
  count(*) FILTER (turn) AS rebalances FROM dd GROUP BY 1)""", body=f"""
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, portfolio, 252 AS lookback, n_days, rebalances, {r('volatility', 'volatility')}, {r('sharpe', 'sharpe')},
  {r('max_drawdown', 'max_drawdown')} FROM bk JOIN pf USING (names)"""))
def grid_backtest_with_given_weights(spark, sf):
    u, baskets, portfolios = setting(spark, sf)
    n, quarter = F.size("names"), 63
    at = F.explode(F.sequence(F.lit(819), F.lit(max(819, u.last)), F.lit(quarter)))
    j = F.sequence(F.lit(1), n)
    up = F.floor(F.col("i") / quarter) % 2 == 1
    w = F.transform(j, lambda k: F.when(up, k).otherwise(n + 1 - k) / (n * (n + 1) / 2))
    weights = baskets.select("basket", "names", F.lit(252).alias("lookback"), at.alias("i")).where(F.col("i") <= u.last).select("basket", "lookback", "i", w.alias("w"))
    return _scores(shared(gb.daily_returns(u, baskets, weights, SCHEDULE.start)), portfolios)
