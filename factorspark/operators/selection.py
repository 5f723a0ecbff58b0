"""Ranking and portfolio selection over ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import min_max
from factorspark.session import checkpointed, shared


RANGE_ROWS = 1_000_000


def full_rank(df: DataFrame, keys: Sequence[str], by: str, tie: str = "symbol", out: str = "rank", ranges: int | None = None) -> DataFrame:
    """Rank 1..n by ``by`` descending within each key, ties by ``tie``; every row is ranked.

    The rows are range-partitioned on (keys, score, tie), which splits a large group over many tasks; each
    range numbers its own rows and adds the counts of the ranges before it. There is a range for every RANGE_ROWS rows, and one for each
    shuffle partition at least. The rows are computed once, for their number, the borders' sample and the exchange.
    """
    keys = list(keys)
    order = [F.desc_nulls_last(by), F.asc(tie)]
    kept = shared(df)
    n = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // RANGE_ROWS))
    spread = kept.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    # the tag must not change between its two uses, so it is written once
    tagged = checkpointed(spread.withColumn("_range", F.spark_partition_id()))
    counts = tagged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys).orderBy("_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return (local.join(offsets, [*keys, "_range"])
            .withColumn(out, F.col("_rn") + F.col("_before")).drop("_range", "_rn", "_before"))


def top_pool(df: DataFrame, keys: Sequence[str], n: int, by: Sequence[Column], out: str = "rank") -> DataFrame:
    """First ``n`` rows per key; each map task keeps only its own first ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def _first(df: DataFrame, keys: Sequence[str], size, by: Sequence[Column]) -> DataFrame:
    limit = size if isinstance(size, Column) else F.lit(size)
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit)


def top_rank(pool: DataFrame, keys: Sequence[str], size) -> DataFrame:
    """The first ``size`` names of each pool. ``pool`` has ``rank`` and ``symbol``."""
    return _first(pool, keys, size, [F.asc("rank"), F.asc("symbol")])


def capped_greedy(pool: DataFrame, keys: Sequence[str], group: str, cap, size,
                  by: Sequence[Column] | None = None, whole_only: bool = False) -> DataFrame:
    """Walk the pool in order, at most ``cap`` names per group, until ``size`` are taken.

    Taking a name never depends on later ones, so numbering inside the group and then over
    the survivors gives exactly the walk's result. ``whole_only`` drops portfolios that
    cannot be filled.
    """
    order = list(by or [F.asc("rank"), F.asc("symbol")])
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    inner = Window.partitionBy(*keys, group).orderBy(*order)
    kept = pool.withColumn("_in_group", F.row_number().over(inner)).where(F.col("_in_group") <= limit)
    out = _first(kept.drop("_in_group"), keys, size, order)
    if whole_only:
        need = size if isinstance(size, Column) else F.lit(size)
        out = out.withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(
            F.col("_have") == need).drop("_have")
    return out


def threshold_or_best(pool: DataFrame, keys: Sequence[str], size, x: str, passes: Column) -> DataFrame:
    """Names that pass, in rank order; if too few pass, the pool's best by ``x`` instead."""
    need = size if isinstance(size, Column) else F.lit(size)
    ok = F.coalesce(passes, F.lit(False))
    n_ok = F.sum(ok.cast("int")).over(Window.partitionBy(*keys))
    st = pool.withColumn("_ok", ok).withColumn("_enough", n_ok >= need)
    st = st.where(~F.col("_enough") | F.col("_ok"))
    by = [F.desc_nulls_last(F.when(~F.col("_enough"), F.col(x))), F.asc("rank"), F.asc("symbol")]
    return _first(st, keys, size, by).drop("_ok", "_enough")


# Recommendations that qualify for the recommendation portfolio.
RECOMMENDED = ("STRONG BUY - Elite performer", "STRONG BUY - High conviction", "BUY - Quality growth",
               "BUY - Stable quality", "BUY - High score acceptable risk", "SPECULATIVE BUY - Strong momentum",
               "HOLD - Stable but flat", "HOLD - Needs monitoring")


def recommended_first(pool: DataFrame, keys: Sequence[str], size, wanted: Sequence[str] = RECOMMENDED) -> DataFrame:
    """Recommended names by rank, padded with the best-ranked others."""
    return _first(pool, keys, size, [F.desc(F.col("recommendation").isin(*wanted)), F.asc("rank"), F.asc("symbol")])


def _pool_range(pool: DataFrame, keys: Sequence[str], cols: Sequence[str], median: bool = False) -> DataFrame:
    """Each column's range (and median) over its pool, joined back. A pool is at most its size."""
    w = Window.partitionBy(*keys)
    if median:
        med = pool.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_med_{c}") for c in cols])
        pool = pool.join(med, list(keys))
        pool = pool.withColumns({f"_v_{c}": F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols})
        pool = pool.drop(*[f"_med_{c}" for c in cols])
    else:
        pool = pool.withColumns({f"_v_{c}": F.col(c).cast("double") for c in cols})
    return pool.withColumns({f"_lo_{c}": F.min(f"_v_{c}").over(w) for c in cols} | {
        f"_hi_{c}": F.max(f"_v_{c}").over(w) for c in cols})


def _norm(c: str, constant: float) -> Column:
    return min_max(F.col(f"_v_{c}"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), constant)


def _drop_range(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_v_", "_lo_", "_hi_"))])


def hybrid_stability(pool: DataFrame, keys: Sequence[str], size, cap: int = 3, weight: float = 0.6) -> DataFrame:
    """Sector-capped walk ordered by 0.6 normalised R2 plus 0.4 inverted normalised rank."""
    st = _pool_range(pool, keys, ["linear_r2", "rank"])
    st = st.withColumn("blend", weight * _norm("linear_r2", 0.0) + (1 - weight) * (1 - _norm("rank", 0.0)))
    return capped_greedy(_drop_range(st), keys, "sector", cap, size,
                         [F.desc_nulls_last("blend"), F.asc("rank"), F.asc("symbol")])


# Default factor mix of the balanced portfolio.
BALANCE = {"value": 0.2, "quality": 0.2, "technical": 0.15, "momentum": 0.15, "growth": 0.15, "stability": 0.15}


def factor_balanced(pool: DataFrame, keys: Sequence[str], size, mix: dict[str, float] | None = None) -> DataFrame:
    """Median-imputed, min-max normalised factors summed with ``mix``; the top ``size``."""
    mix = mix or BALANCE
    st = _pool_range(pool, keys, list(mix), median=True)
    score = None
    for c, w in mix.items():
        part = w * F.coalesce(_norm(c, 0.5), F.lit(0.0))
        score = part if score is None else score + part
    st = _drop_range(st.withColumn("factor_mix", score))
    return _first(st, keys, size, [F.desc("factor_mix"), F.asc("rank"), F.asc("symbol")])


def risk_adjusted(pool: DataFrame, keys: Sequence[str], size, weight: float = 0.3) -> DataFrame:
    """Score plus 0.3 times the normalised stability factor."""
    st = _pool_range(pool, keys, ["stability"], median=True)
    st = _drop_range(st.withColumn("risk_adjusted", F.col("score") + weight * F.coalesce(_norm("stability", 0.5), F.lit(0.0))))
    return _first(st, keys, size, [F.desc("risk_adjusted"), F.asc("rank"), F.asc("symbol")])


def diversified(pool: DataFrame, keys: Sequence[str], sectors: int = 5, each: int = 4, cap: int = 20,
                minimum: int = 10) -> DataFrame:
    """The most frequent sectors, a few names of each; nothing below the minimum."""
    counts = pool.groupBy(*keys, "sector").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_best"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.asc("_best"))
    counts = counts.withColumn("_sr", F.row_number().over(w)).where(F.col("_sr") <= sectors).drop("_n", "_best")
    st = pool.join(counts, [*keys, "sector"])
    st = capped_greedy(st, keys, "sector", each, cap, [F.asc("_sr"), F.asc("rank"), F.asc("symbol")])
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return st.withColumn("_n", n).where(F.col("_n") >= minimum).drop("_n", "_sr")


def expand_grid(ranked: DataFrame, sizes: Sequence[int], pools: Sequence[int]) -> DataFrame:
    """Every (size, pool) combination with pool >= size as copies of the pool's rows."""
    grid = [(s, p) for s in sizes for p in pools if p >= s]
    cells = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(p).alias("pool")) for s, p in grid])
    top = ranked.where(F.col("rank") <= max(pools))
    return top.withColumn("_g", F.explode(cells)).select("*", "_g.size", "_g.pool").drop("_g").where(
        F.col("rank") <= F.col("pool"))


def portfolio_grid(ranked: DataFrame, keys: Sequence[str], kind: str = "ranked",
                   sizes: Sequence[int] = (10, 15, 20, 25, 30), pools: Sequence[int] = (40, 50, 75, 100)) -> DataFrame:
    """All strategies over all sizes and pools, one row per portfolio member."""
    cells = expand_grid(ranked, sizes, pools)
    k = [*keys, "size", "pool"]
    size = F.col("size")
    made = {
        "TopRank": top_rank(cells, k, size),
        "SectorBal2": capped_greedy(cells, k, "sector", 2, size),
        "SectorBal3": capped_greedy(cells, k, "sector", 3, size),
        "IndustryBal": capped_greedy(cells, k, "industry", 2, size),
    }
    if kind == "ranked":
        made["FactorBal"] = factor_balanced(cells, k, size)
        made["RiskAdj"] = risk_adjusted(cells, k, size)
    else:
        made["Stability"] = threshold_or_best(cells, k, size, "linear_r2", F.col("linear_r2") >= 0.5)
        made["PosMomentum"] = threshold_or_best(cells, k, size, "linear_slope", F.col("linear_slope") > 0)
        made["Recommended"] = recommended_first(cells, k, size)
        made["HybridStability"] = hybrid_stability(cells.where(size.isin(15, 20, 25)), k, size)
    out = None
    for name, df in made.items():
        part = df.select(*keys, F.concat(F.lit(f"{name}_S"), size.cast("string"), F.lit("_P"),
                                         F.col("pool").cast("string")).alias("portfolio"),
                         "symbol", "sector", "industry", "rank", "score", "pick")
        out = part if out is None else out.unionByName(part)
    return out


def diversity(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normalised entropy and concentration of sectors and industries, rank and score means."""
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_stocks"), F.avg("rank").alias("avg_rank"), F.avg("score").alias("avg_score"),
        F.stddev_samp("score").alias("score_std"))
    for col, name in (("sector", "sector"), ("industry", "industry")):
        c = members.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
        # sum(-p ln p) = ln n - sum(c ln c) / n
        e = c.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"num_{name}"), F.max("_c").alias("_m"), F.sum("_c").alias("_n"),
                                 F.sum(F.col("_c") * F.log("_c")).alias("_cl"))
        ent = F.log("_n") - F.col("_cl") / F.col("_n")
        k = F.col(f"num_{name}")
        e = e.select(*keys, f"num_{name}", F.when(k > 1, ent / F.log(k)).otherwise(0.0).alias(f"{name}_diversity"),
                     (F.col("_m") / F.col("_n")).alias(f"max_{name}_concentration"))
        base = base.join(e, list(keys))
    return base


def best_portfolios(metrics: DataFrame, criterion: str, n: int = 5) -> DataFrame:
    """Top ``n`` by a criterion; drawdown and volatility are better when smaller in size."""
    col = F.abs(F.col(criterion)) if criterion == "max_drawdown" else F.col(criterion)
    order = F.asc_nulls_last(col) if criterion in ("max_drawdown", "volatility") else F.desc_nulls_last(col)
    return metrics.orderBy(order, F.asc("portfolio")).limit(n)


def exclude_listed(df: DataFrame, symbols: DataFrame | None = None, sectors: Sequence[str] = (),
                   industries: Sequence[str] = ()) -> DataFrame:
    """Drop listed symbols (anti join), sectors and industries."""
    out = df if symbols is None else df.join(symbols.select("symbol").distinct(), "symbol", "left_anti")
    if sectors:
        out = out.where(~F.coalesce(F.col("sector").isin(*sectors), F.lit(False)))
    if industries:
        out = out.where(~F.coalesce(F.col("industry").isin(*industries), F.lit(False)))
    return out


# Spellings of input columns and the names used here.
ALIASES = {"Ticker": "symbol", "ticker": "symbol", "Symbol": "symbol", "CompanyName": "company_name",
           "Country": "country", "Score": "score", "Rank": "rank", "Sector": "sector", "Industry": "industry",
           "Value": "value", "Quality": "quality", "FinancialHealth": "financial_health", "Technical": "technical",
           "Insider": "insider", "Momentum": "momentum", "Stability": "stability", "Size": "size",
           "OptionsFlow": "options_flow", "Liquidity": "liquidity", "Carry": "carry", "Growth": "growth",
           "Linear_R2": "linear_r2", "Linear_Slope": "linear_slope", "Avg_Score": "avg_score",
           "Stability_Adjusted_Score": "stability_adjusted_score", "Recommendation": "recommendation",
           "Appearances": "appearances", "Avg_Rank": "avg_rank", "Stability_Score": "stability_score",
           "R2_Adjusted_Score": "r2_adjusted_score", "Slope_Adjusted_Score": "slope_adjusted_score",
           "Trend_Consistency": "trend_consistency", "Score_Std": "score_std", "Score_CV": "score_cv",
           "Combined_Rank": "combined_rank"}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename known spellings to the library's names."""
    return df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in df.columns})


def table_kind(df: DataFrame) -> str:
    """'stability', 'ranked' or 'unknown', decided by the columns present."""
    cols = set(normalise_columns(df).columns)
    if cols & {"stability_adjusted_score", "linear_r2", "linear_slope"}:
        return "stability"
    return "ranked" if {"value", "quality"} <= cols or "score" in cols else "unknown"
