"""Registered queries: positions, realized profit, dividends, daily value, holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import ledger as lg
from factorspark.operators.cleaning import fill_forward
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import DT, r
from factorspark.sources import adapters as ad

TX_SQL = o.TX.replace("p_brand AS symbol", "upper(p_brand) AS symbol")
LEDGER_SQL = (TX_SQL.replace("tx AS (", "tx AS MATERIALIZED ("), """
lw AS (SELECT portfolio, symbol, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS realized,
    CAST(0 AS DOUBLE) AS open_commission, CAST(0 AS DOUBLE) AS realized_commission, CAST(0 AS DOUBLE) AS dividends, CAST(0 AS DOUBLE) AS bought,
    CAST(0 AS DOUBLE) AS commission FROM (SELECT DISTINCT portfolio, symbol FROM tx)
  UNION ALL
  SELECT lw.portfolio, lw.symbol, tx.seq,
    CASE WHEN type = 'Buy' THEN s + shares WHEN type = 'Sell' AND s > 1e-9 THEN s - shares ELSE s END,
    CASE WHEN type = 'Buy' THEN c + shares * price WHEN type = 'Sell' AND s > 1e-9 THEN greatest((s - shares) * (c / s), 0) ELSE c END,
    realized + CASE WHEN type = 'Sell' AND s > 1e-9 THEN (price - c / s) * shares - tx.commission ELSE 0 END,
    open_commission + CASE WHEN type = 'Buy' OR (type = 'Sell' AND s > 1e-9) THEN tx.commission ELSE 0 END,
    realized_commission + CASE WHEN type = 'Dividend' OR (type = 'Sell' AND s > 1e-9) THEN tx.commission ELSE 0 END,
    dividends + CASE WHEN type = 'Dividend' THEN price * shares - tx.commission ELSE 0 END,
    bought + CASE WHEN type = 'Buy' THEN shares * price ELSE 0 END, lw.commission + tx.commission
  FROM lw JOIN tx ON tx.portfolio = lw.portfolio AND tx.symbol = lw.symbol AND tx.seq = lw.seq + 1),
po AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY portfolio, symbol) AS n FROM lw) WHERE seq = n)""")
POS_COLS = ("shares", "total_cost", "realized", "open_commission", "realized_commission", "dividends", "bought", "commission")
POS_E = ", ".join(r({"shares": "s", "total_cost": "c"}.get(c, c), c, 3) for c in POS_COLS)


def trades(spark, sf):
    return lg.normalise(ad.transactions(spark, sf))


@query("ledger_positions", with_(*LEDGER_SQL, recursive=True, body=f"SELECT portfolio, symbol, {POS_E} FROM po"))
def ledger_positions(spark, sf):
    return lg.positions(trades(spark, sf)).select("portfolio", "symbol", *[r6(c, 3) for c in POS_COLS])


@query("ledger_positions_in_blocks", with_(*LEDGER_SQL, recursive=True, body=f"SELECT portfolio, symbol, {POS_E} FROM po"))
def ledger_positions_in_blocks(spark, sf):
    """The same result with the block path that large positions take."""
    return lg.positions(trades(spark, sf), block_rows=64).select("portfolio", "symbol", *[r6(c, 3) for c in POS_COLS])


@query("open_positions", with_(*LEDGER_SQL, recursive=True, body=f"""
SELECT portfolio, symbol, {r('s', 'shares', 3)}, {r('c / s', 'avg_cost', 5)} FROM po WHERE s > 1e-9"""))
def open_positions(spark, sf):
    return lg.open_positions(lg.positions(trades(spark, sf))).select("portfolio", "symbol", r6("shares", 3), r6("avg_cost", 5))


@query("realized_positions", with_(*LEDGER_SQL, recursive=True, body=f"""
SELECT portfolio, symbol, {r('realized + dividends', 'realized_pnl', 3)}, {r('realized_commission', 'commission', 3)} FROM po
WHERE abs(realized + dividends) > 1e-6 OR realized_commission > 0"""))
def realized_positions(spark, sf):
    return lg.realized_positions(lg.positions(trades(spark, sf))).select("portfolio", "symbol", r6("realized_pnl", 3), r6("commission", 3))


HELD_SQL = """
sh AS (SELECT portfolio, symbol, d, seq, sum(q) OVER w AS rs FROM (SELECT *, CASE type WHEN 'Buy' THEN shares WHEN 'Sell' THEN -shares END AS q FROM tx)
  WHERE q IS NOT NULL WINDOW w AS (PARTITION BY portfolio, symbol ORDER BY seq)),
sf AS (SELECT *, rs - least(min(rs) OVER (PARTITION BY portfolio, symbol ORDER BY seq), 0) AS held FROM sh),
hd AS (SELECT portfolio, symbol, d, arg_max(held, seq) AS held FROM sf GROUP BY 1, 2, 3)"""


@query("daily_shares", with_(TX_SQL, HELD_SQL, body=f"SELECT portfolio, symbol, {DT}, {r('held', 'held', 4)} FROM hd"))
def daily_shares(spark, sf):
    return lg.daily_shares(trades(spark, sf)).select("portfolio", "symbol", day_text(), r6("held", 4))


DIV_SQL = o.dividends().replace("p_brand AS symbol", "upper(p_brand) AS symbol")


def dividends(spark, sf):
    return ad.dividends(spark, sf).withColumn("symbol", F.upper("symbol"))


@query("auto_dividends", with_(TX_SQL, HELD_SQL, DIV_SQL, """
op AS (SELECT DISTINCT portfolio, symbol FROM tx WHERE type <> 'Dividend' AND (portfolio, symbol) NOT IN (SELECT (portfolio, symbol) FROM tx WHERE type = 'Dividend')),
du AS (SELECT op.portfolio, op.symbol, ex_date, amount FROM op JOIN divs USING (symbol) WHERE amount > 0),
ah AS (SELECT du.*, hd.held FROM du ASOF JOIN hd ON du.portfolio = hd.portfolio AND du.symbol = hd.symbol AND du.ex_date >= hd.d)""", body=f"""
SELECT portfolio, symbol, {r('sum(held * amount)', 'dividend_income', 3)} FROM ah WHERE held > 1e-9 GROUP BY 1, 2"""))
def auto_dividends(spark, sf):
    return lg.auto_dividends(trades(spark, sf), dividends(spark, sf)).select("portfolio", "symbol", r6("dividend_income", 3))


BARS_SQL = o.bars("brand").replace("p_brand AS symbol", "upper(p_brand) AS symbol")


def prices(spark, sf):
    return ad.closes(spark, sf, "brand").withColumn("symbol", F.upper("symbol"))


VALUE_SQL = """
cal AS (SELECT DISTINCT d FROM bars),
fp AS (SELECT s.symbol, cal.d, last_value(close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY cal.d) AS px FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN cal LEFT JOIN bars ON bars.symbol = s.symbol AND bars.d = cal.d),
nm AS (SELECT DISTINCT portfolio, symbol FROM tx WHERE type IN ('Buy', 'Sell')),
pv AS (SELECT a.portfolio, a.d, sum(held * px) AS value FROM (SELECT portfolio, nm.symbol, d, px FROM nm JOIN fp ON nm.symbol = fp.symbol WHERE px IS NOT NULL) a
  ASOF JOIN hd ON a.portfolio = hd.portfolio AND a.symbol = hd.symbol AND a.d >= hd.d WHERE held > 1e-9 GROUP BY 1, 2)"""


@query("daily_portfolio_value", with_(TX_SQL, HELD_SQL, BARS_SQL, VALUE_SQL, body=f"SELECT portfolio, {DT}, {r('value', 'value', 2)} FROM pv WHERE value > 0"))
def daily_portfolio_value(spark, sf):
    filled = fill_forward(prices(spark, sf), limit=None)
    return lg.daily_value(trades(spark, sf), filled).select("portfolio", day_text(), r6("value", 2))


HOLD_SQL = """
lp AS (SELECT symbol, max(close) FILTER (rn = 1) AS p, max(close) FILTER (rn = 2) AS q FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars)
  WHERE rn <= 2 GROUP BY 1),
ho AS (SELECT portfolio, symbol, s AS shares, c AS total_cost, p AS price, p - q AS day_change, s * p AS market_value, s * p - c AS pnl,
  CASE WHEN c > 0 THEN (s * p - c) / c * 100 ELSE 0 END AS pnl_pct, s * p / sum(s * p) OVER (PARTITION BY portfolio) * 100 AS weight FROM po JOIN lp USING (symbol) WHERE s > 1e-9)"""


@query("holdings_dashboard", with_(*LEDGER_SQL, BARS_SQL, HOLD_SQL, recursive=True, body=f"""
SELECT portfolio, symbol, {r('market_value', 'market_value', 5)}, {r('day_change', 'day_change', 6)}, {r('pnl', 'pnl', 5)}, {r('pnl_pct', 'pnl_pct', 5)},
  {r('weight', 'weight')} FROM ho"""))
def holdings_dashboard(spark, sf):
    return lg.holdings(lg.positions(trades(spark, sf)), prices(spark, sf)).select(
        "portfolio", "symbol", r6("market_value", 5), r6("day_change", 6), r6("pnl", 5), r6("pnl_pct", 5), r6("weight"))


@query("portfolio_totals", with_(*LEDGER_SQL, BARS_SQL, HOLD_SQL, """
b AS (SELECT portfolio, sum(realized) AS realized, sum(dividends) AS dividends, sum(commission) AS commission, sum(bought) AS bought FROM po GROUP BY 1),
m AS (SELECT portfolio, sum(market_value) AS mv, sum(total_cost) AS oc, sum(day_change * shares) AS dc FROM ho GROUP BY 1),
f AS (SELECT portfolio, min(d) AS d0 FROM tx GROUP BY 1), e AS (SELECT max(d) AS d1 FROM bars),
t AS (SELECT *, realized + dividends + mv - oc AS pnl FROM b JOIN m USING (portfolio) JOIN f USING (portfolio), e)""", recursive=True, body=f"""
SELECT portfolio, {r('pnl', 'total_pnl', 2)}, {r('pnl / bought * 100', 'total_pnl_pct')}, {r('commission', 'commission', 3)}, {r('dc / mv * 100', 'day_change_pct')},
  {r('(power(greatest(1 + pnl / bought, 1e-9), 365.0 / date_diff(\'day\', d0, d1)) - 1) * 100', 'annualised_return')} FROM t"""))
def portfolio_totals(spark, sf):
    tx, px = trades(spark, sf), prices(spark, sf)
    pos = lg.positions(tx)
    end = px.agg(F.max("d")).scalar()
    return lg.portfolio_totals(pos, lg.holdings(pos, px), tx, end).select(
        "portfolio", r6("total_pnl", 2), r6("total_pnl_pct"), r6("commission", 3), r6("day_change_pct"), r6("annualised_return"))


@query("profit_contributions", with_(*LEDGER_SQL, BARS_SQL, HOLD_SQL, """
rz AS (SELECT portfolio, symbol, realized + dividends AS rp FROM po WHERE abs(realized + dividends) > 1e-6 OR realized_commission > 0)""", recursive=True, body=f"""
SELECT portfolio, symbol, {r('coalesce(pnl, 0)', 'unrealized', 2)}, {r('coalesce(rp, 0)', 'realized', 2)}, {r('coalesce(pnl, 0) + coalesce(rp, 0)', 'contribution', 2)}
FROM ho FULL JOIN rz USING (portfolio, symbol)"""))
def profit_contributions(spark, sf):
    pos = lg.positions(trades(spark, sf))
    return lg.contributions(lg.holdings(pos, prices(spark, sf)), lg.realized_positions(pos)).select(
        "portfolio", "symbol", r6("unrealized", 2), r6("realized", 2), r6("contribution", 2))


@query("industry_allocation", with_(*LEDGER_SQL, BARS_SQL, HOLD_SQL, """
ind AS (SELECT upper(p_brand) AS symbol, min(p_type) AS industry FROM part WHERE p_brand NOT LIKE '%7' GROUP BY 1)""", recursive=True, body=f"""
SELECT portfolio, coalesce(industry, 'Unknown') AS industry, {r('sum(market_value)', 'market_value', 2)},
  round(sum(market_value) / sum(sum(market_value)) OVER (PARTITION BY portfolio) * 100, 6) AS share FROM ho LEFT JOIN ind USING (symbol) GROUP BY 1, 2"""))
def industry_allocation(spark, sf):
    ind = ad.table(spark, sf, "part").where(~F.col("p_brand").endswith("7")).groupBy(F.upper("p_brand").alias("symbol")).agg(
        F.min("p_type").alias("industry"))
    return lg.allocation(lg.holdings(lg.positions(trades(spark, sf)), prices(spark, sf)), ind).select(
        "portfolio", "industry", r6("market_value", 2), r6("share"))
