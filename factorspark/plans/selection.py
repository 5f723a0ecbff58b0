"""Registered queries: ranking, portfolio selection, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import r6
from factorspark.operators import selection as sel
from factorspark.operators import trends as tr
from factorspark.operators.factors import sector_relative
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import r
from factorspark.plans.trends import COMPANY_SQL, STABLE_SQL, companies, hist_sql, stability
from factorspark.session import shared
from factorspark.sources import adapters as ad

RANKED_SQL = """
rk AS (SELECT as_of, symbol, sector, industry, price / 100 AS score, price_to_book AS value, return_on_equity AS quality,
  ev_to_revenue AS technical, trailing_pe AS momentum, revenue_growth AS growth, current_ratio AS stability,
  row_number() OVER (PARTITION BY as_of ORDER BY price DESC, symbol) AS rank FROM fund)"""
RANKED = (o.FUNDAMENTALS, RANKED_SQL)
DAY = "strftime(as_of, '%Y-%m-%d') AS as_of"
KEYS = ["as_of"]


def ranked(spark, sf):
    return sel.full_rank(ad.ranked(spark, sf), KEYS, "score")


def pool(spark, sf, n=100):
    return shared(sel.top_pool(ad.ranked(spark, sf), KEYS, n, [F.desc("score"), F.asc("symbol")]))


def out(df, *cols):
    return df.select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "symbol", *cols)


@query("snapshot_ranks", with_(*RANKED, body=f"SELECT {DAY}, symbol, rank FROM rk"))
def snapshot_ranks(spark, sf):
    return out(ranked(spark, sf), "rank")


@query("snapshot_ranks_by_ranges", with_(*RANKED, body=f"SELECT {DAY}, symbol, rank FROM rk"))
def snapshot_ranks_by_ranges(spark, sf):
    return out(sel.full_rank(ad.ranked(spark, sf), KEYS, "score", ranges=8), "rank")


@query("top_factor_lists", with_(*RANKED, body=" UNION ALL ".join(
    f"SELECT {DAY}, symbol, '{c}' AS list, pick FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY {c} DESC NULLS LAST, "
    f"rank) AS pick FROM rk WHERE rank <= 100) WHERE pick <= 20" for c in ("value", "quality", "momentum"))))
def top_factor_lists(spark, sf):
    p = pool(spark, sf)
    parts = [out(sel.top_pool(p, KEYS, 20, [F.desc_nulls_last(c), F.asc("rank")], "pick"), F.lit(c).alias("list"), "pick")
             for c in ("value", "quality", "momentum")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GREEDY = """g1 AS (SELECT *, row_number() OVER (PARTITION BY as_of, {grp} ORDER BY rank) AS ig FROM rk WHERE rank <= {pool}),
g2 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY rank) AS pick FROM g1 WHERE ig <= {cap})"""


@query("sector_capped_portfolio", with_(*RANKED, GREEDY.format(grp="sector", pool=100, cap=3), body=f"""
SELECT {DAY}, symbol, pick FROM g2 WHERE pick <= 20"""))
def sector_capped_portfolio(spark, sf):
    return out(sel.capped_greedy(pool(spark, sf), KEYS, "sector", 3, 20), "pick")


@query("industry_capped_portfolio", with_(*RANKED, GREEDY.format(grp="industry", pool=100, cap=2), body=f"""
SELECT {DAY}, symbol, pick FROM g2 WHERE pick <= 20 QUALIFY count(*) OVER (PARTITION BY as_of) = 20"""))
def industry_capped_portfolio(spark, sf):
    return out(sel.capped_greedy(pool(spark, sf), KEYS, "industry", max(2, 20 // 10), 20, whole_only=True), "pick")


FB = "".join(f" + {w} * CASE WHEN v_{c} IS NULL THEN 0 WHEN max(v_{c}) OVER p > min(v_{c}) OVER p THEN (v_{c} - min(v_{c}) OVER p) / "
             f"(max(v_{c}) OVER p - min(v_{c}) OVER p) ELSE 0.5 END" for c, w in sel.BALANCE.items())
IMPUTE = """im AS (SELECT rk.*, {cols} FROM rk JOIN (SELECT as_of, {meds} FROM rk WHERE rank <= 100 GROUP BY 1) USING (as_of)
  WHERE rank <= 100)"""


@query("factor_balanced_portfolio", with_(*RANKED, IMPUTE.format(
    cols=", ".join(f"coalesce({c}, m_{c}) AS v_{c}" for c in sel.BALANCE),
    meds=", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in sel.BALANCE)), f"""
fb AS (SELECT as_of, symbol, rank, 0{FB} AS mix FROM im WINDOW p AS (PARTITION BY as_of))""", body=f"""
SELECT {DAY}, symbol, {r('mix', 'factor_mix')}, pick FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY mix DESC, rank)
  AS pick FROM fb) WHERE pick <= 20"""))
def factor_balanced_portfolio(spark, sf):
    return out(sel.factor_balanced(pool(spark, sf), KEYS, 20), r6("factor_mix"), "pick")


@query("risk_adjusted_portfolio", with_(*RANKED, IMPUTE.format(
    cols="coalesce(stability, m_s) AS v_s", meds="quantile_cont(stability, 0.5) AS m_s"), """
ra AS (SELECT as_of, symbol, rank, score + 0.3 * CASE WHEN max(v_s) OVER p > min(v_s) OVER p THEN
  (v_s - min(v_s) OVER p) / (max(v_s) OVER p - min(v_s) OVER p) ELSE 0.5 END AS adj FROM im WINDOW p AS (PARTITION BY as_of))""",
                                        body=f"""
SELECT {DAY}, symbol, {r('adj', 'risk_adjusted')}, pick FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY adj DESC, rank)
  AS pick FROM ra) WHERE pick <= 20"""))
def risk_adjusted_portfolio(spark, sf):
    return out(sel.risk_adjusted(pool(spark, sf), KEYS, 20), r6("risk_adjusted"), "pick")


@query("diversified_portfolio", with_(*RANKED, """
sc AS (SELECT as_of, sector, row_number() OVER (PARTITION BY as_of ORDER BY count(*) DESC, min(rank)) AS sr FROM rk WHERE rank <= 100
  GROUP BY as_of, sector),
d1 AS (SELECT rk.*, sr, row_number() OVER (PARTITION BY as_of, sector ORDER BY rank) AS ig FROM rk JOIN sc USING (as_of, sector)
  WHERE rank <= 100 AND sr <= 5),
d2 AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY sr, rank) AS pick FROM d1 WHERE ig <= 4)""", body=f"""
SELECT {DAY}, symbol, pick FROM d2 WHERE pick <= 20 QUALIFY count(*) OVER (PARTITION BY as_of) >= 10"""))
def diversified_portfolio(spark, sf):
    return out(sel.diversified(pool(spark, sf), KEYS), "pick")


COMMON_SQL = (*hist_sql(), *STABLE_SQL, COMPANY_SQL, """
cm AS (SELECT 1 AS k, symbol, coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry, slope AS linear_slope,
  r2 AS linear_r2, adj AS score, recommendation, row_number() OVER (ORDER BY round(adj, 9) DESC, symbol) AS rank
  FROM stable LEFT JOIN co USING (symbol))""")


def common(spark, sf, n=100):
    """The stability table ranked by adjusted score: the first ``n`` names."""
    st = tr.with_company(stability(spark, sf), companies(spark, sf)).withColumn("k", F.lit(1)).withColumn(
        "score", F.col("stability_adjusted_score"))
    return sel.top_pool(st, ["k"], n, [F.desc(F.round("score", 9)), F.asc("symbol")])


@query("stability_threshold_portfolio", with_(*COMMON_SQL, """
q AS (SELECT *, count(*) FILTER (linear_r2 >= 0.5) OVER () >= 20 AS enough FROM cm WHERE rank <= 100)""", body="""
SELECT symbol, pick FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN enough THEN NULL ELSE linear_r2 END DESC NULLS LAST, rank) AS pick
  FROM q WHERE NOT enough OR linear_r2 >= 0.5) WHERE pick <= 20"""))
def stability_threshold_portfolio(spark, sf):
    return sel.threshold_or_best(common(spark, sf), ["k"], 20, "linear_r2", F.col("linear_r2") >= 0.5).select("symbol", "pick")


@query("positive_slope_portfolio", with_(*COMMON_SQL, """
q AS (SELECT *, count(*) FILTER (linear_slope > 0) OVER () >= 5 AS enough FROM cm WHERE rank <= 100)""", body="""
SELECT symbol, pick FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN enough THEN NULL ELSE linear_slope END DESC NULLS LAST, rank) AS pick
  FROM q WHERE NOT enough OR linear_slope > 0) WHERE pick <= 5"""))
def positive_slope_portfolio(spark, sf):
    return sel.threshold_or_best(common(spark, sf), ["k"], 5, "linear_slope", F.col("linear_slope") > 0).select("symbol", "pick")


@query("recommended_portfolio", with_(*COMMON_SQL, body=f"""
SELECT symbol, recommendation, pick FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN recommendation IN
  ({', '.join("'" + x + "'" for x in sel.RECOMMENDED)}) THEN 0 ELSE 1 END, rank) AS pick FROM cm WHERE rank <= 100) WHERE pick <= 20"""))
def recommended_portfolio(spark, sf):
    return sel.recommended_first(common(spark, sf), ["k"], 20).select("symbol", "recommendation", "pick")


@query("hybrid_stability_portfolio", with_(*COMMON_SQL, """
hb AS (SELECT *, 0.6 * (linear_r2 - min(linear_r2) OVER ()) / (max(linear_r2) OVER () - min(linear_r2) OVER ())
  + 0.4 * (1 - (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ())) AS blend FROM cm WHERE rank <= 100),
h1 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY blend DESC, rank) AS ig FROM hb)""", body=f"""
SELECT symbol, {r('blend', 'blend')}, pick FROM (SELECT *, row_number() OVER (ORDER BY blend DESC, rank) AS pick FROM h1 WHERE ig <= 3)
WHERE pick <= 15"""))
def hybrid_stability_portfolio(spark, sf):
    return sel.hybrid_stability(common(spark, sf), ["k"], 15).select("symbol", r6("blend"), "pick")


SIZES, POOLS = (10, 15, 20, 25, 30), (40, 50, 75, 100)
GRID_CELLS = ", ".join(f"({s}, {p})" for s in SIZES for p in POOLS if p >= s)


def _greedy_grid(name: str, grp: str, cap: int) -> str:
    return f"""SELECT as_of, '{name}_S' || size || '_P' || pool AS portfolio, symbol, sector, industry, rank, score, pick FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of, size, pool ORDER BY rank) AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY as_of, size, pool, {grp} ORDER BY rank) AS ig FROM cl) WHERE ig <= {cap}) WHERE pick <= size"""


FBG = FB.replace("OVER p", "OVER p")
GRID_SQL = (*RANKED, f"gd(size, pool) AS (VALUES {GRID_CELLS})",
            "cl AS (SELECT rk.*, size, pool FROM rk JOIN gd ON rank <= pool)",
            f"""ci AS (SELECT cl.*, {', '.join(f'coalesce({c}, m_{c}) AS v_{c}' for c in sel.BALANCE)} FROM cl JOIN (SELECT as_of, size, pool,
  {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in sel.BALANCE)} FROM cl GROUP BY 1, 2, 3) USING (as_of, size, pool)),
cf AS (SELECT *, 0{FBG} AS mix, score + 0.3 * CASE WHEN max(v_stability) OVER p > min(v_stability) OVER p THEN (v_stability
  - min(v_stability) OVER p) / (max(v_stability) OVER p - min(v_stability) OVER p) ELSE 0.5 END AS adj FROM ci
  WINDOW p AS (PARTITION BY as_of, size, pool))""", f"""
grid AS (
  {_greedy_grid('TopRank', 'symbol', 1)} UNION ALL {_greedy_grid('SectorBal2', 'sector', 2)}
  UNION ALL {_greedy_grid('SectorBal3', 'sector', 3)} UNION ALL {_greedy_grid('IndustryBal', 'industry', 2)}
  UNION ALL SELECT as_of, 'FactorBal_S' || size || '_P' || pool, symbol, sector, industry, rank, score, pick FROM (SELECT *,
    row_number() OVER (PARTITION BY as_of, size, pool ORDER BY mix DESC, rank) AS pick FROM cf) WHERE pick <= size
  UNION ALL SELECT as_of, 'RiskAdj_S' || size || '_P' || pool, symbol, sector, industry, rank, score, pick FROM (SELECT *,
    row_number() OVER (PARTITION BY as_of, size, pool ORDER BY adj DESC, rank) AS pick FROM cf) WHERE pick <= size)""")


@query("portfolio_grid", with_(*GRID_SQL, body=f"SELECT {DAY}, portfolio, symbol, pick FROM grid"))
def portfolio_grid(spark, sf):
    return out(sel.portfolio_grid(pool(spark, sf), KEYS), "portfolio", "pick")


@query("stability_portfolio_grid")
def stability_portfolio_grid(spark, sf):
    return sel.portfolio_grid(common(spark, sf), ["k"], "stability").select("portfolio", "symbol", "pick")


DIV_COLS = ("avg_rank", "avg_score", "score_std", "sector_diversity", "max_sector_concentration", "industry_diversity",
            "max_industry_concentration")


def _entropy(c: str) -> str:
    return f"""e_{c} AS (SELECT as_of, portfolio, count(*) AS num_{c}, max(c) / sum(c) AS max_{c}_concentration,
  CASE WHEN count(*) > 1 THEN -sum(c / t * ln(c / t)) / ln(count(*)) ELSE 0 END AS {c}_diversity FROM (SELECT as_of, portfolio, {c}, count(*) AS c,
  sum(count(*)) OVER (PARTITION BY as_of, portfolio) AS t FROM grid GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("portfolio_diversity", with_(*GRID_SQL, _entropy("sector"), _entropy("industry"), body=f"""
SELECT {DAY}, portfolio, num_stocks, num_sector, num_industry, {', '.join(r(c, c) for c in DIV_COLS)} FROM (SELECT as_of, portfolio,
  count(*) AS num_stocks, avg(rank) AS avg_rank, avg(score) AS avg_score, stddev_samp(score) AS score_std FROM grid GROUP BY 1, 2)
  JOIN e_sector USING (as_of, portfolio) JOIN e_industry USING (as_of, portfolio)"""))
def portfolio_diversity(spark, sf):
    g = shared(sel.portfolio_grid(pool(spark, sf), KEYS))   # bounded by snapshots x grid x size
    return sel.diversity(g, ["as_of", "portfolio"]).select(
        F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "portfolio", "num_stocks", "num_sector", "num_industry",
        *[r6(c) for c in DIV_COLS])


@query("portfolio_symbols", with_(*GRID_SQL, body="SELECT DISTINCT symbol FROM grid"))
def portfolio_symbols(spark, sf):
    return sel.portfolio_grid(pool(spark, sf), KEYS).select("symbol").distinct()


@query("listed_exclusions", with_(*RANKED, body=f"""
SELECT {DAY}, symbol, rank FROM rk WHERE sector <> 'ASIA' AND industry <> 'FRANCE' AND symbol NOT IN
  (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)"""))
def listed_exclusions(spark, sf):
    bad = ad.table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return out(sel.exclude_listed(ranked(spark, sf), bad, ("ASIA",), ("FRANCE",)), "rank")


@query("sector_relative_scores", with_(*RANKED, """
ss AS (SELECT as_of, sector, avg(score) AS mu, stddev_samp(score) AS sd FROM rk GROUP BY 1, 2)""", body=f"""
SELECT {DAY}, symbol, round((score - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS rel_z,
  round(1 / (1 + exp(-least(greatest((score - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, -2), 2))), 6) AS rel
FROM rk JOIN ss USING (as_of, sector)"""))
def sector_relative_scores(spark, sf):
    return out(sector_relative(ad.ranked(spark, sf), "score", ["as_of", "sector"], "rel"), r6("rel_z"), r6("rel"))
