"""Registered queries: cleaning, calendars, views, historical batches, classifier, ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import cleaning as cl
from factorspark.operators import history as hs
from factorspark.operators import reversion as rv
from factorspark.operators import views as vw
from factorspark.plans import flow as fp
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.regimes import GAP_SQL, LABEL_SQL, overlapping_periods
from factorspark.plans.registry import ORACLES, query
from factorspark.plans.scoring import (
    CARRY_SQL, EARN_SQL, EST_PIVOT, FUND_SCORES, FW_SQL, INS_SQL, MOMENTUM_SQL, RANK_SQL, STAB_SQL, TH_SQL, factor_history, keyed)
from factorspark.plans.technical import DT, MOM_SQL, TECH_SQL, r
from factorspark.session import ensure_checkpoint_dir, written
from factorspark.sources import adapters as ad
from factorspark.sources import lattice as lt
from factorspark.sources.sinks import write_ranked
from factorspark.streaming import alerts, ingest

PROFILE = ("trailing_pe", "ev_to_ebitda", "gross_margins", "revenue_growth", "dividend_yield", "current_ratio")


@query("null_profile", with_(o.FUNDAMENTALS, "w AS (SELECT *, " + " OR ".join(f"{c} IS NULL" for c in PROFILE) + " AS bad FROM fund)", body=" UNION ALL ".join(
    f"SELECT strftime(as_of, '%Y-%m-%d') AS as_of, count(*) AS rows, count(*) FILTER (bad) AS rows_affected, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls "
    "FROM w GROUP BY 1" for c in PROFILE)))
def null_profile(spark, sf):
    return cl.null_profile(ad.fundamentals(spark, sf), "as_of", PROFILE).select(
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "rows", "rows_affected", "column", "nulls")


@query("cleaned_bars", with_("""
raw AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice / l_quantity) AS hi,
  min(l_extendedprice / l_quantity) AS lo, CASE WHEN min(l_discount) > 0.02 THEN max(l_extendedprice / l_quantity) END AS adj, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
r2 AS (SELECT symbol, d, coalesce(adj, CASE WHEN v > 10 THEN hi END) AS close, CASE WHEN v > 20 THEN lo END AS low, CASE WHEN v > 30 THEN v END AS volume FROM raw)""",
                            body=f"""
SELECT symbol, {DT}, round(close, 9) AS open, round(coalesce(low, close), 9) AS low, round(close, 9) AS close, coalesce(volume, 0) AS volume
FROM r2 WHERE close IS NOT NULL"""))
def cleaned_bars(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    u = F.col("l_extendedprice") / F.col("l_quantity")
    raw = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(
        F.max(u).alias("hi"), F.min(u).alias("lo"), F.min("l_discount").alias("disc"), F.sum("l_quantity").alias("v"))
    raw = raw.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "d",
                     F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("high"),
                     F.when(F.col("v") > 20, F.col("lo")).alias("low"), F.when(F.col("v") > 10, F.col("hi")).alias("close"),
                     F.when(F.col("disc") > 0.02, F.col("hi")).alias("adjclose"), F.when(F.col("v") > 30, F.col("v")).alias("volume"))
    return cl.fill_bars(raw).select("symbol", day_text(), *[F.round(c, 9).alias(c) for c in ("open", "low", "close")], "volume")


@query("price_availability", with_(o.bars(), body="""
SELECT symbol, count(d) AS n_bars, count(d) >= 0.8 * 252 AS available FROM (SELECT DISTINCT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier)
LEFT JOIN (SELECT * FROM bars WHERE d BETWEEN DATE '1998-06-30' - 282 AND DATE '1998-06-30') USING (symbol) GROUP BY 1"""))
def price_availability(spark, sf):
    u = ad.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return cl.availability(ad.closes(spark, sf), u, F.lit("1998-06-30").cast("date"))


@query("minimum_history", with_(o.bars("brand"), body=f"""
SELECT symbol, {DT} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 1500)"""))
def minimum_history(spark, sf):
    return cl.min_history(ad.closes(spark, sf, "brand"), 1500).select("symbol", day_text())


@query("scorable_history", with_(o.bars(), body=f"""
SELECT symbol, {DT} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 200)
  AND symbol IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)"""))
def scorable_history(spark, sf):
    """Bars of the suppliers with 200 bars and a market cap; a balance that isn't positive stands for a missing one."""
    caps = ad.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
                                                  F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("market_cap"))
    return cl.min_history(ad.closes(spark, sf), 200, caps).select("symbol", day_text())


@query("stepped_trading_days", """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) < 6)
SELECT strftime(d, '%Y-%m-%d') AS d FROM cal WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND datediff('day', DATE '1996-01-01', d) % 5 = 0""")
def stepped_trading_days(spark, sf):
    cal = ad.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().where(F.weekday("d") < 5)
    return cl.trading_days(cal, F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"), 5).select(day_text())


@query("last_trading_days", """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS t FROM lineitem WHERE isodow(l_shipdate) < 6),
q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS d, strftime(max(t), '%Y-%m-%d') AS trading_day FROM q LEFT JOIN cal ON t BETWEEN d - 10 AND d GROUP BY 1""")
def last_trading_days(spark, sf):
    cal = ad.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().where(F.weekday("d") < 5)
    q = ad.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return cl.last_trading_day(q, cal).select(day_text(), day_text("trading_day"))


@query("weekday_calendar", """
SELECT strftime(d, '%Y-%m-%d') AS d FROM (SELECT CAST(unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS d FROM lineitem)
WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN ('1996-12-25', '1997-01-01')""")
def weekday_calendar(spark, sf):
    d = ad.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return cl.weekday_calendar(d, ("1996-12-25", "1997-01-01")).select(day_text())


@query("data_summary", with_(o.bars(), body="""
SELECT strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day, count(DISTINCT d) AS days, count(DISTINCT symbol) AS symbols FROM bars"""))
def data_summary(spark, sf):
    return cl.data_summary(ad.closes(spark, sf)).select(day_text("first_day"), day_text("last_day"), "days", "symbols")


# ---- views ---------------------------------------------------------------------------

ATTR_SQL = """
at1 AS (SELECT *, CASE nl % 5 WHEN 0 THEN 'Software - Cloud Computing' WHEN 1 THEN 'Biotechnology' ELSE 'Retail' END AS ind2,
  CASE nl % 4 WHEN 0 THEN 'China' WHEN 1 THEN 'Japan' WHEN 2 THEN 'United States' ELSE 'Norway' END AS cty, CASE nl % 6 WHEN 0 THEN 'Technology' WHEN 1 THEN
  'Energy' WHEN 2 THEN 'Financial Services' ELSE 'Other' END AS sec FROM (SELECT *, CAST(shares_outstanding / 1000000 AS BIGINT) AS nl FROM fund)),
pxy AS (SELECT *, CASE WHEN ind2 LIKE 'Software%' THEN 'IGV' WHEN ind2 = 'Biotechnology' THEN 'IBB' WHEN cty = 'China' AND sec = 'Technology' THEN 'CQQQ'
  WHEN cty = 'China' AND sec = 'Financial Services' THEN 'KWEB' WHEN cty = 'China' THEN 'FXI' WHEN cty = 'Japan' THEN 'EWJ' WHEN sec = 'Technology' THEN 'XLK'
  WHEN sec = 'Energy' THEN 'XLE' WHEN sec = 'Financial Services' THEN 'XLF' WHEN cty <> 'United States' THEN 'EEM' END AS proxy FROM at1)"""


def attributes(spark, sf):
    nl = (F.col("shares_outstanding") / 1000000).cast("long")
    return ad.fundamentals(spark, sf).withColumn("nl", nl).withColumn(
        "ind2", F.when(F.col("nl") % 5 == 0, "Software - Cloud Computing").when(F.col("nl") % 5 == 1, "Biotechnology").otherwise("Retail")).withColumn(
        "cty", F.when(F.col("nl") % 4 == 0, "China").when(F.col("nl") % 4 == 1, "Japan").when(F.col("nl") % 4 == 2, "United States").otherwise("Norway")).withColumn(
        "sec", F.when(F.col("nl") % 6 == 0, "Technology").when(F.col("nl") % 6 == 1, "Energy").when(F.col("nl") % 6 == 2, "Financial Services").otherwise("Other"))


@query("sector_proxies", with_(o.FUNDAMENTALS, ATTR_SQL, body="SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, proxy FROM pxy"))
def sector_proxies(spark, sf):
    return attributes(spark, sf).select(*keyed(), vw.proxy_symbol(F.col("ind2"), F.col("cty"), F.col("sec")).alias("proxy"))


ANALYST_SQL = """
an AS (SELECT symbol, as_of, n_name_, CASE WHEN target_mean_price > 0 AND price > 0 THEN least(greatest((target_mean_price - price) / price, -0.3), 0.3) END AS ar,
  CASE WHEN num_analysts >= 10 THEN 0.8 WHEN num_analysts >= 5 THEN 0.6 WHEN num_analysts >= 2 THEN 0.4 ELSE 0.2 END AS ac
  FROM (SELECT *, 'R' || CAST(r_regionkey AS VARCHAR) AS n_name_ FROM fund JOIN region ON r_name = sector))"""
SINCE = "DATE '2000-06-01'"
RELATIVE_SQL = f"""
pr AS (SELECT symbol, arg_max(close, d) / arg_min(close, d) - 1 AS proxy_return FROM bars WHERE d >= {SINCE} GROUP BY 1),
mr AS (SELECT arg_max(close, d) / arg_min(close, d) - 1 AS market_return FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem GROUP BY 1) WHERE d >= {SINCE}),
rm AS (SELECT symbol, proxy_return, market_return, least(greatest(0.5 * (proxy_return - market_return), -0.2), 0.2) AS rr,
  CASE WHEN abs(proxy_return - market_return) > 0.10 THEN 0.7 WHEN abs(proxy_return - market_return) > 0.05 THEN 0.5 ELSE 0.3 END AS rc FROM pr, mr)"""


def relative(spark, sf):
    return vw.relative_momentum(ad.closes(spark, sf, "region"), ad.closes(spark, sf, "market"), F.lit("2000-06-01").cast("date"))


@query("relative_momentum_views", with_(o.bars("region"), RELATIVE_SQL, body=f"""
SELECT symbol, {r('proxy_return', 'proxy_return')}, {r('market_return', 'market_return')}, {r('rr', 'ret')}, CAST(rc AS DOUBLE) AS conf FROM rm"""))
def relative_momentum_views(spark, sf):
    return relative(spark, sf).select("symbol", r6("proxy_return"), r6("market_return"), r6("ret"), "conf")


@query("commodity_trend_views", with_(o.bars("region"), """
tv AS (SELECT symbol, count(*) AS n, arg_max(close, d) AS p, avg(close) FILTER (rn <= 50) AS a, avg(close) AS b FROM (SELECT *, row_number() OVER
  (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars) WHERE rn <= 200 GROUP BY 1)""", body=f"""
SELECT symbol, CAST(CASE WHEN p < a AND a < b THEN -0.15 WHEN p < a THEN -0.08 WHEN p > a AND a > b THEN 0.12 WHEN p > a THEN 0.06 ELSE 0 END AS DOUBLE) AS ret,
  CAST(CASE WHEN p < a AND a < b THEN 0.7 WHEN p < a THEN 0.5 WHEN p > a AND a > b THEN 0.7 WHEN p > a THEN 0.5 ELSE 0.3 END AS DOUBLE) AS conf, {r('(a - b) / b', 'trend_strength')} FROM tv"""))
def commodity_trend_views(spark, sf):
    return vw.trend_view(ad.closes(spark, sf, "region")).select("symbol", "ret", "conf", r6("trend_strength"))


@query("basket_views", with_(o.bars("brand"), """
bv AS (SELECT symbol, arg_max(close, d) / arg_min(close, d) - 1 AS br FROM bars GROUP BY 1)""", body=f"""
SELECT symbol, {r('br', 'basket_return')}, {r('least(greatest(0.5 * br, -0.15), 0.15)', 'ret')}, {r('least(0.4 + 2 * abs(br), 0.7)', 'conf')} FROM bv"""))
def basket_views(spark, sf):
    return vw.basket_view(ad.closes(spark, sf, "brand")).select("symbol", r6("basket_return"), r6("ret"), r6("conf"))


@query("combined_views", with_(o.FUNDAMENTALS, ANALYST_SQL, o.bars("region"), RELATIVE_SQL, body=f"""
SELECT an.symbol, strftime(as_of, '%Y-%m-%d') AS as_of, {r('(coalesce(ar * ac, 0) + coalesce(rr * rc, 0)) / (CASE WHEN ar IS NULL THEN 0 ELSE ac END + coalesce(rc, 0))', 'expected_return')},
  {r('least((CASE WHEN ar IS NULL THEN 0 ELSE ac END + coalesce(rc, 0)) / (CASE WHEN ar IS NULL THEN 0 ELSE 1 END + CASE WHEN rc IS NULL THEN 0 ELSE 1 END) * 0.85, 0.95)', 'confidence')}
FROM an LEFT JOIN rm ON rm.symbol = n_name_"""))
def combined_views(spark, sf):
    reg = ad.table(spark, sf, "region").select(F.col("r_name").alias("sector"), F.concat(
        F.lit("R"), F.col("r_regionkey").cast("string")).alias("proxy"))
    mom = relative(spark, sf).select(F.col("symbol").alias("proxy"), F.struct("ret", "conf").alias("momentum"))
    f = ad.fundamentals(spark, sf).join(reg, "sector").join(mom, "proxy", "left").withColumn(
        "analyst", vw.analyst_view(F.col("target_mean_price"), F.col("price"), F.col("num_analysts")))
    return vw.combine_views(f, ["analyst", "momentum"], F.lit(25.0)).select(*keyed(), r6("expected_return"), r6("confidence"))


# ---- history -------------------------------------------------------------------------

REG = {"Strong Bull": "Strong_Bull", "Steady Growth": "Steady_Growth", "Crisis/Bear": "Crisis_Bear"}
PERIOD_SQL = """
hp AS (SELECT CASE regime WHEN 0 THEN 'Strong_Bull' WHEN 1 THEN 'Steady_Growth' ELSE 'Crisis_Bear' END AS regime, start_date, end_date,
  row_number() OVER (ORDER BY regime, symbol, start_date) AS period_seq FROM gp),
hd AS (SELECT d, arg_min(regime, period_seq) AS regime FROM (SELECT DISTINCT as_of AS d FROM fund) JOIN hp ON d BETWEEN start_date AND end_date GROUP BY 1)"""


def periods(spark, sf, bars=None):
    return overlapping_periods(spark, sf, bars).replace(REG, subset=["regime_name"])


def _base(cte: str, name: str) -> str:
    return cte.replace(f"{name} AS (", f"{name}0 AS (", 1)


TAG = "symbol || '@' || strftime(as_of, '%Y-%m-%d')"


def _known(name: str, date: str) -> str:
    """What each snapshot could know, under the snapshot's own symbol."""
    return f"{name} AS (SELECT tag AS symbol, x.* EXCLUDE (symbol) FROM {name}0 x JOIN snap ON s0 = x.symbol AND x.{date} <= snap.as_of)"


HISTORY_TAIL = (RANK_SQL[-1].replace("gst AS (SELECT sector, regime,", "gst AS (SELECT sector, as_of, regime,")
                .replace("FROM g2 GROUP BY 1, 2)", "FROM g2 GROUP BY 1, 2, 3)").replace("USING (sector, regime))", "USING (sector, as_of, regime))")
                .replace("SELECT fs.symbol, fs.regime, fs.sector,", "SELECT fs.symbol, fs.as_of, fs.regime, fs.sector,"))
BATCH_SQL = (
    f"hdays AS ({with_(*LABEL_SQL, GAP_SQL, o.FUNDAMENTALS, PERIOD_SQL, body='SELECT d, regime FROM hd')})",
    _base(o.FUNDAMENTALS, "fund"), f"snap AS (SELECT symbol AS s0, as_of, {TAG} AS tag FROM fund0)",
    f"fund AS (SELECT {TAG} AS symbol, * EXCLUDE (symbol) FROM fund0)", _base(o.bars(), "bars"), _known("bars", "d"),
    _base(o.ESTIMATES, "est"), f"est AS (SELECT {TAG} AS symbol, * EXCLUDE (symbol) FROM est0)", _base(o.SURPRISES, "sur"), _known("sur", "d"),
    _base(o.dividends("supplier"), "divs"), _known("divs", "ex_date"), MOM_SQL, EARN_SQL[2], MOMENTUM_SQL, *TECH_SQL, *STAB_SQL, CARRY_SQL[1],
    TH_SQL, FUND_SCORES, EST_PIVOT, FW_SQL, _base(o.INSIDER, "ins"), f"ins AS (SELECT symbol || '@' || year(d) || '-12-31' AS symbol, * EXCLUDE (symbol) FROM ins0)", INS_SQL,
    HISTORY_TAIL, """
sc AS (SELECT tot.regime, as_of, split_part(symbol, '@', 1) AS symbol, round(score, 6) AS score FROM tot JOIN hdays ON hdays.d = as_of AND hdays.regime = tot.regime)""")


def batch(spark, sf):
    when = written(periods(spark, sf, lt.region_bars(spark, sf)), "periods")
    return hs.batch_scores(factor_history(spark, sf), when)


@query("historical_batch_scores", with_(*BATCH_SQL, body="""
SELECT regime, strftime(as_of, '%Y-%m-%d') AS snapshot_date, symbol, score, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS rank FROM sc"""))
def historical_batch_scores(spark, sf):
    return batch(spark, sf).select("regime", day_text("snapshot_date"), "symbol", "score", "rank")


@query("batch_status_counts", with_(*LABEL_SQL, GAP_SQL, o.FUNDAMENTALS, PERIOD_SQL.replace("SELECT DISTINCT as_of AS d FROM fund", "SELECT d FROM rq"), body="""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN day(rq.d) = 1 THEN 'exists' WHEN regime IS NULL THEN 'no_regime' WHEN isodow(rq.d) < 6 THEN 'success' ELSE 'error' END AS status
  FROM rq LEFT JOIN hd ON hd.d = rq.d) GROUP BY 1""").replace("WITH bars AS", "WITH rq AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),\nbars AS"))
def batch_status_counts(spark, sf):
    dates = ad.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return hs.batch_status(dates, periods(spark, sf), dates.where(F.dayofmonth("d") == 1), F.weekday("d") < 5)


def run_folder(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@query("ranked_partition_table", ORACLES["historical_batch_scores"])
def ranked_partition_table(spark, sf):
    """The batch written by regime and date twice (the second write finds nothing to do), read back."""
    path = f"{run_folder(spark)}/ranked"
    rows = batch(spark, sf)
    write_ranked(rows, path)
    write_ranked(rows, path)
    return spark.read.parquet(path).select("regime", day_text("snapshot_date"), "symbol", "score", "rank")


@query("reversion_risk")
def reversion_risk(spark, sf):
    """Classifier over all brands."""
    h = ad.score_history(spark, sf)
    model, accuracy = rv.fit_reversion(rv.training_rows(h))
    return rv.reversion_probability(model, h, accuracy)


@query("incremental_session_ingest", ORACLES["session_dedupe_last_wins"])
def incremental_session_ingest(spark, sf):
    """Sessions of four sources arrive as files, later dates before earlier ones, are streamed in and merged; read back."""
    root = run_folder(spark)
    fp._sources(fp.sessions(spark, sf)).write.partitionBy("source_seq").parquet(f"{root}/in")
    # the source number must be a file column for the stream's declared schema
    staged = spark.read.parquet(f"{root}/in")
    late = F.dayofmonth("d") > 15
    for half in (staged.where(late), staged.where(~late)):
        half.repartition("source_seq").write.mode("append").parquet(f"{root}/arrived")
        stream = ingest.session_stream(spark, f"{root}/arrived", files_per_trigger=1)
        ingest.start_ingest(stream, f"{root}/table", f"{root}/progress").awaitTermination()
    return ingest.sessions_table(spark, f"{root}/table").select("symbol", day_text(), "source_seq", "total_volume", "call_oi")


@query("streamed_flow_alerts", ORACLES["flow_alert_report"])
def streamed_flow_alerts(spark, sf):
    """Sessions arrive in three parts; each part is judged from the states that the parts before have left."""
    root = run_folder(spark)
    flow = fp.numbered(spark, sf)
    part = F.ntile(3).over(Window.orderBy("d"))                 # one row for each session
    days = flow.select("d").distinct().withColumn("part", part)
    flow = flow.join(days, "d").select("symbol", "d", "score", "total_volume", "call_oi", "put_oi", "status", "has_oi", "part")
    for k in (1, 2, 3):
        flow.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{root}/arrived")
        stream = spark.readStream.schema(flow.drop("part").schema).parquet(f"{root}/arrived")
        alerts.start_alerts(stream, f"{root}/events", f"{root}/progress", **fp.LOOSE).awaitTermination()
    u = ad.option_universe(spark, sf)
    found = spark.read.schema(alerts.EVENTS).parquet(f"{root}/events")
    rep = alerts.report(found, u.where("symbol <= 'SYJ'"), u.where("symbol between 'SYE' and 'SYP'"))
    return rep.select("section", "symbol", day_text(), "label", r6("score"), "volume", r6("rvol"))
