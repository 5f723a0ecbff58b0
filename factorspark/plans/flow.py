"""Registered queries: option contracts, session scores, events, positioning, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import flow as fl
from factorspark.operators.selection import full_rank
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import DT, r
from factorspark.plans.trends import STABLE_SQL, hist_sql, stability
from factorspark.session import shared
from factorspark.sources import adapters as ad

PARSED = """pc AS (SELECT d, regexp_extract(contract, '^O:([A-Z0-9.]+?)(\\d{6})([CP])(\\d{8})$', 1) AS symbol,
  CAST(strptime('20' || regexp_extract(contract, '(\\d{6})[CP]\\d{8}$', 1), '%Y%m%d') AS DATE) AS expiry,
  regexp_extract(contract, '([CP])\\d{8}$', 1) AS kind, CAST(right(contract, 8) AS DOUBLE) / 1000 AS strike, volume, close, oi
  FROM oc WHERE regexp_matches(contract, '^O:[A-Z0-9.]+?\\d{6}[CP]\\d{8}$'))"""
PRICES = """px AS (SELECT 'SY' || chr(CAST(65 + user_id % 25 AS INTEGER)) AS symbol, CAST(ts AS DATE) AS d,
  100 + (avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) - 50) / 10 AS underlying FROM events
  WHERE NOT (user_id % 25 = 3 AND day(ts) % 7 = 0) GROUP BY 1, 2)"""
FLOW_SQL = (o.CONTRACTS, PARSED, PRICES, """
un AS (SELECT 'SY' || chr(CAST(65 + n_nationkey AS INTEGER)) AS symbol FROM nation)""", """
fa AS (SELECT symbol, d, coalesce(sum(volume) FILTER (kind = 'C'), 0) AS cv, coalesce(sum(volume) FILTER (kind = 'P'), 0) AS pv,
  coalesce(sum(volume * close * 100) FILTER (kind = 'C'), 0) AS cn, coalesce(sum(volume * close * 100) FILTER (kind = 'P'), 0) AS pn,
  coalesce(sum(oi) FILTER (kind = 'C'), 0) AS co, coalesce(sum(oi) FILTER (kind = 'P'), 0) AS po, count(*) AS n
  FROM pc JOIN px USING (symbol, d) WHERE symbol IN (SELECT symbol FROM un) AND expiry BETWEEN d AND d + 60 AND underlying > 0
  AND strike / underlying BETWEEN 0.90 AND 1.10 GROUP BY 1, 2),
fg AS (SELECT un.symbol, s.d, underlying, cv, pv, cn, pn, co, po, n, CASE WHEN underlying IS NULL OR underlying <= 0 THEN 'NO_PRICE'
  WHEN n IS NULL THEN 'NO_OPTIONS' WHEN cv + pv < 100 THEN 'LOW_VOLUME' ELSE 'OK' END AS status
  FROM un CROSS JOIN (SELECT DISTINCT d FROM pc) s LEFT JOIN px USING (symbol, d) LEFT JOIN fa USING (symbol, d)),
flow AS (SELECT symbol, d, CASE WHEN status = 'OK' THEN (cv - pv) / (cv + pv) END AS score,
  CASE WHEN status = 'OK' THEN (cn - pn) / nullif(cn + pn, 0) END AS imbalance_notional,
  CASE WHEN status = 'OK' THEN (co - po) / nullif(co + po, 0) END AS imbalance_oi,
  CAST(coalesce(cv, 0) AS BIGINT) AS call_volume, CAST(coalesce(pv, 0) AS BIGINT) AS put_volume,
  CAST(coalesce(cv + pv, 0) AS BIGINT) AS total_volume, CAST(co AS BIGINT) AS call_oi, CAST(po AS BIGINT) AS put_oi,
  underlying AS underlying_price, CAST(coalesce(n, 0) AS BIGINT) AS contracts, status FROM fg)""")


def sessions(spark, sf):
    return fl.score_sessions(fl.parse_contracts(ad.option_contracts(spark, sf)), ad.option_prices(spark, sf),
                             ad.option_universe(spark, sf))


@query("option_contract_parts", with_(o.CONTRACTS, PARSED, body=f"""
SELECT {DT}, symbol AS root, strftime(expiry, '%Y-%m-%d') AS expiry, kind, strike, volume FROM pc"""))
def option_contract_parts(spark, sf):
    return fl.parse_contracts(ad.option_contracts(spark, sf)).select(
        day_text(), "root", day_text("expiry"), "kind", "strike", "volume")


@query("option_session_scores", with_(*FLOW_SQL, body=f"""
SELECT symbol, {DT}, {r('score', 'score')}, {r('imbalance_notional', 'imbalance_notional')}, {r('imbalance_oi', 'imbalance_oi')},
  call_volume, put_volume, total_volume, call_oi, put_oi, {r('underlying_price', 'underlying_price')}, contracts, status FROM flow"""))
def option_session_scores(spark, sf):
    return sessions(spark, sf).select(
        "symbol", day_text(), r6("score"), r6("imbalance_notional"), r6("imbalance_oi"), "call_volume", "put_volume",
        "total_volume", "call_oi", "put_oi", r6("underlying_price"), "contracts", "status")


SOURCES_SQL = """
src AS (SELECT symbol, d, total_volume, CASE WHEN source_seq = 1 OR (source_seq = 2 AND day(d) % 4 = 0) THEN call_oi END AS call_oi, source_seq
  FROM flow, (VALUES (0), (1), (2), (3)) s(source_seq)
  WHERE source_seq = 0 OR (source_seq IN (1, 2) AND day(d) % 2 = 0) OR (source_seq = 3 AND day(d) % 3 = 0)),
sf AS (SELECT d, source_seq, count(call_oi) > 0 AS oi FROM src GROUP BY 1, 2)"""


def _sources(flow):
    s = flow.withColumn("source_seq", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    day = F.dayofmonth("d")
    q = F.col("source_seq")
    s = s.where((q == 0) | (q.isin(1, 2) & (day % 2 == 0)) | ((q == 3) & (day % 3 == 0)))
    return s.withColumn("call_oi", F.when((q == 1) | ((q == 2) & (day % 4 == 0)), F.col("call_oi")))


for _mode, _dir in (("last", "DESC"), ("first", "ASC")):
    def _dedupe(spark, sf, mode=_mode):
        return fl.dedupe_sessions(_sources(sessions(spark, sf)), mode).select(
            "symbol", day_text(), "source_seq", "total_volume", "call_oi")
    query(f"session_dedupe_{_mode}_wins", with_(*FLOW_SQL, SOURCES_SQL, f"""
pk AS (SELECT d, source_seq FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY oi DESC, CASE WHEN oi THEN source_seq END {_dir},
  source_seq) AS rn FROM sf) WHERE rn = 1)""", body=f"""
SELECT symbol, {DT}, source_seq, total_volume, call_oi FROM src JOIN pk USING (d, source_seq)"""))(_dedupe)


NUM_SQL = (*FLOW_SQL, """
sn AS (SELECT *, dense_rank() OVER (ORDER BY d) AS sno FROM flow),
rv AS (SELECT *, avg(total_volume) OVER (PARTITION BY symbol ORDER BY sno RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS tm FROM sn),
rvo AS (SELECT *, CASE WHEN tm > 0 THEN total_volume / tm END AS rvol FROM rv)""")


def numbered(spark, sf):
    return shared(fl.session_numbers(sessions(spark, sf)))   # symbols x sessions, read by several branches


@query("relative_option_volume", with_(*NUM_SQL, body=f"""
SELECT symbol, {DT}, {r('tm', 'trail_mean')}, {r('rvol', 'rvol')} FROM rvo"""))
def relative_option_volume(spark, sf):
    return fl.relative_volume(numbered(spark, sf)).select("symbol", day_text(), r6("trail_mean"), r6("rvol"))


EMA3_SQL = """
em AS (SELECT c.symbol, c.d, sum(p.score * power(0.5, c.sno - p.sno)) / sum(power(0.5, c.sno - p.sno)) FILTER (p.score IS NOT NULL)
  AS score_ema3 FROM sn c JOIN sn p ON c.symbol = p.symbol AND p.sno <= c.sno GROUP BY 1, 2)"""


@query("weighted_flow_score", with_(*NUM_SQL, EMA3_SQL, body=f"SELECT symbol, {DT}, {r('score_ema3', 'score_ema3')} FROM em"))
def weighted_flow_score(spark, sf):
    return fl.weighted_score(numbered(spark, sf)).select("symbol", day_text(), r6("score_ema3"))


OI_SQL = """
os AS (SELECT *, dense_rank() OVER (ORDER BY d) AS ono FROM sn WHERE d IN (SELECT d FROM flow GROUP BY d HAVING count(call_oi) > 0)),
oc2 AS (SELECT a.*, a.call_oi - b.call_oi AS d_call_1, a.put_oi - b.put_oi AS d_put_1, b.call_oi + b.put_oi AS base_1,
  ((a.call_oi - b.call_oi) - (a.put_oi - b.put_oi)) / (b.call_oi + b.put_oi + 1) AS rel_1,
  ((a.call_oi - e.call_oi) - (a.put_oi - e.put_oi)) / (e.call_oi + e.put_oi + 1) AS rel_5, e.call_oi + e.put_oi AS base_5,
  f.call_oi + f.put_oi AS base_f, ((a.call_oi - f.call_oi) - (a.put_oi - f.put_oi)) / (f.call_oi + f.put_oi + 1) AS rel_f
  FROM os a LEFT JOIN os b ON a.symbol = b.symbol AND b.ono = a.ono - 1 LEFT JOIN os e ON a.symbol = e.symbol AND e.ono = a.ono - 5
  LEFT JOIN os f ON a.symbol = f.symbol AND f.ono = 1)"""


@query("open_interest_changes", with_(*NUM_SQL, OI_SQL, body=f"""
SELECT symbol, {DT}, d_call_1, d_put_1, base_1, {r('rel_1', 'rel_1')}, {r('rel_5', 'rel_5')} FROM oc2"""))
def open_interest_changes(spark, sf):
    return fl.oi_changes(numbered(spark, sf)).select(
        "symbol", day_text(), "d_call_1", "d_put_1", "base_1", r6("rel_1"), r6("rel_5"))


LOOSE = {"min_score": 0.2, "min_volume": 100, "min_rvol": 1.2}   # the driver events are too even for the defaults
SPIKES_SQL = """
sp AS (SELECT *, CASE WHEN score > 0 THEN 'BULL FLOW' ELSE 'BEAR FLOW' END AS direction FROM rvo WHERE status = 'OK' AND abs(score) >= 0.2
  AND total_volume >= 100 AND tm > 0 AND rvol >= 1.2)"""
BUILDS_SQL = """
bl AS (SELECT *, CASE WHEN abs(rel_1) >= 0.25 THEN '1-session' ELSE '5-session' END AS trigger,
  CASE WHEN rel_1 > 0 THEN 'CALL BUILD' ELSE 'PUT BUILD' END AS label FROM oc2
  WHERE base_1 >= 5000 AND (abs(rel_1) >= 0.25 OR abs(rel_5) >= 0.50))"""


@query("volume_spike_events", with_(*NUM_SQL, SPIKES_SQL, body=f"""
SELECT symbol, {DT}, direction, {r('score', 'score')}, total_volume, {r('rvol', 'rvol')} FROM sp"""))
def volume_spike_events(spark, sf):
    return fl.volume_spikes(fl.relative_volume(numbered(spark, sf)), **LOOSE).select(
        "symbol", day_text(), "direction", r6("score"), "total_volume", r6("rvol"))


@query("open_interest_builds", with_(*NUM_SQL, OI_SQL, BUILDS_SQL, body=f"""
SELECT symbol, {DT}, label, trigger, {r('rel_1', 'rel_1')} FROM bl"""))
def open_interest_builds(spark, sf):
    return fl.oi_builds(fl.oi_changes(numbered(spark, sf))).select("symbol", day_text(), "label", "trigger", r6("rel_1"))


TREND_SQL = """
ot AS (SELECT symbol, d, CASE WHEN ono > 5 THEN rel_5 WHEN ono > 1 THEN rel_f END AS oi_rel,
  CASE WHEN ono > 5 THEN base_5 ELSE base_f END AS bs, CASE WHEN ono > 5 THEN 0.15 ELSE 0.25 END AS cut FROM oc2),
trd AS (SELECT symbol, d, oi_rel, CASE WHEN bs >= 5000 AND oi_rel >= cut THEN 'CALL BUILD' WHEN bs >= 5000 AND oi_rel <= -cut
  THEN 'PUT BUILD' ELSE '' END AS oi_trend FROM ot)"""


@query("open_interest_trends", with_(*NUM_SQL, OI_SQL, TREND_SQL, body=f"""
SELECT symbol, {DT}, {r('oi_rel', 'oi_rel')}, oi_trend FROM trd"""))
def open_interest_trends(spark, sf):
    return fl.oi_trends(numbered(spark, sf)).select("symbol", day_text(), r6("oi_rel"), "oi_trend")


@query("flow_confluence_table", with_(*NUM_SQL, EMA3_SQL, OI_SQL, TREND_SQL, *hist_sql("nation"), *(c.replace("sm AS", "stm AS").replace("JOIN sm ", "JOIN stm ")
                                                                                                     for c in STABLE_SQL), """
stb AS (SELECT symbol, row_number() OVER (ORDER BY round(adj, 9) DESC, symbol) AS stability_rank FROM stable),
tgt AS (SELECT max(d) AS d FROM flow),
nw AS (SELECT symbol, score AS flow_score, score_ema3, rvol, status = 'OK' AS has_flow, CASE WHEN status = 'OK' AND abs(score) >= 0.2
  AND total_volume >= 100 AND tm > 0 AND rvol >= 1.2 THEN CASE WHEN score > 0 THEN 'BULL' WHEN score < 0 THEN 'BEAR' ELSE '' END ELSE '' END AS event
  FROM rvo JOIN em USING (symbol, d) JOIN tgt USING (d)),
cf AS (SELECT stb.*, flow_score, score_ema3, rvol, coalesce(has_flow, false) AS has_flow, coalesce(event, '') AS event,
  coalesce(oi_trend, '') AS oi_trend, oi_rel FROM stb LEFT JOIN nw USING (symbol) LEFT JOIN (SELECT trd.* FROM trd JOIN tgt USING (d)) t USING (symbol)),
rc AS (SELECT *, CASE WHEN oi_trend = 'PUT BUILD' AND event = 'BEAR' THEN 'STRONG SELL - Exit signal: put positioning plus bear flow event'
  WHEN oi_trend = 'PUT BUILD' AND coalesce(score_ema3, 0) < -0.2 THEN 'SELL - Protect: sustained put positioning with negative flow'
  WHEN oi_trend = 'PUT BUILD' THEN 'HOLD - Caution: put OI building against quality rank, watch closely'
  WHEN event = 'BEAR' THEN 'HOLD - Delay entry: bear flow event, reassess in 2-3 sessions'
  WHEN oi_trend = 'CALL BUILD' AND event = 'BULL' AND stability_rank <= 10 THEN 'STRONG BUY - Enter now: OI build and flow event aligned'
  WHEN oi_trend = 'CALL BUILD' AND stability_rank <= 10 THEN 'STRONG BUY - Enter: call OI building on top-quality name'
  WHEN oi_trend = 'CALL BUILD' THEN 'BUY - Accumulate: call OI building'
  WHEN event = 'BULL' THEN 'BUY - Enter: bull flow event (no OI confirmation yet)'
  WHEN NOT has_flow THEN 'AMBIGUOUS - Not enough options data to judge (thin or no options market)'
  WHEN coalesce(score_ema3, 0) >= 0.3 THEN 'BUY - Accumulate: positive flow tilt'
  WHEN coalesce(score_ema3, 0) <= -0.3 THEN 'HOLD - Wait: negative flow tilt' ELSE 'HOLD - Wait: neutral flow' END AS recommendation FROM cf)""",
                                      body=f"""
SELECT symbol, stability_rank, event, oi_trend, {r('score_ema3', 'score_ema3')}, recommendation, split_part(recommendation, ' - ', 1) AS tier,
  CAST(list_position(['STRONG BUY', 'BUY', 'HOLD', 'SELL', 'STRONG SELL', 'AMBIGUOUS'], split_part(recommendation, ' - ', 1)) AS INTEGER) AS tier_order
FROM rc"""))
def flow_confluence_table(spark, sf):
    """Flow of the symbols of the stability table, which ranks the price history of the nations' suppliers."""
    table = stability(spark, sf, "nation").select(F.lit(1).alias("k"), "symbol", F.round("stability_adjusted_score", 9).alias("adjusted"))
    stab = full_rank(table, ["k"], "adjusted", out="stability_rank").select("symbol", "stability_rank")
    flow = numbered(spark, sf)
    target = flow.agg(F.max("d")).scalar()
    return fl.confluence(stab, flow, target, 10, **LOOSE).select(
        "symbol", "stability_rank", "event", "oi_trend", r6("score_ema3"), "recommendation", "tier", "tier_order")


@query("flow_alert_report", with_(*NUM_SQL, SPIKES_SQL, OI_SQL, BUILDS_SQL, """
wl AS (SELECT symbol FROM un WHERE symbol <= 'SYJ'), hd AS (SELECT symbol FROM un WHERE symbol BETWEEN 'SYE' AND 'SYP')""", body=f"""
SELECT section, symbol, {DT}, label, {r('score', 'score')}, volume, {r('rvol', 'rvol')} FROM (
 SELECT 'VOLUME_SPIKE' AS section, symbol, d, direction AS label, score, CAST(total_volume AS DOUBLE) AS volume, rvol FROM sp
 UNION ALL SELECT 'OI_BUILD', symbol, d, label, score, NULL, NULL FROM bl
 UNION ALL SELECT 'WATCHLIST', symbol, d, direction, score, CAST(total_volume AS DOUBLE), rvol FROM sp WHERE symbol IN (FROM wl)
 UNION ALL SELECT 'WATCHLIST', symbol, d, label, score, NULL, NULL FROM bl WHERE symbol IN (FROM wl)
 UNION ALL SELECT 'EXIT_ALERT', symbol, d, CASE WHEN score < 0 THEN 'EXIT REVIEW' ELSE 'VOLATILITY NOTE' END, NULL, NULL, NULL FROM sp
   WHERE symbol IN (FROM hd)
 UNION ALL SELECT 'EXIT_ALERT', symbol, d, 'EXIT REVIEW', NULL, NULL, NULL FROM bl WHERE symbol IN (FROM hd) AND label = 'PUT BUILD')"""))
def flow_alert_report(spark, sf):
    flow = numbered(spark, sf)
    u = ad.option_universe(spark, sf)
    rep = fl.alert_report(fl.volume_spikes(fl.relative_volume(flow), **LOOSE), fl.oi_builds(fl.oi_changes(flow)),
                          u.where("symbol <= 'SYJ'"), u.where("symbol between 'SYE' and 'SYP'"))
    return rep.select("section", "symbol", day_text(), "label", r6("score"), "volume", r6("rvol"))


@query("latest_option_session", with_(*FLOW_SQL, body=f"""
SELECT symbol, {DT}, total_volume FROM (SELECT *, row_number() OVER (ORDER BY total_volume DESC, symbol) AS rn FROM flow
  WHERE d = (SELECT max(d) FROM flow)) WHERE rn <= 10"""))
def latest_option_session(spark, sf):
    return fl.latest_snapshot(sessions(spark, sf), n=10, by=[F.desc("total_volume"), F.asc("symbol")]).select(
        "symbol", day_text(), "total_volume")
