"""Expected-return views: analyst targets, proxy momentum, commodity trends, combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.exprs import clip, step_score
from factorspark.functions.windows import last_rows

# Proxy symbols by industry word, by country and sector, by country, by sector.
INDUSTRY_PROXY = {"Fintech": "FINX", "Semiconductors": "SOXX", "Software": "IGV", "Biotechnology": "IBB",
                  "Cloud Computing": "SKYY", "Cybersecurity": "HACK", "Renewable Energy": "ICLN",
                  "Battery Technology": "LIT"}
COUNTRY_SECTOR_PROXY = {("China", "Financial Services"): "KWEB", ("China", "Technology"): "CQQQ",
                        ("China", "Consumer Cyclical"): "CHIQ", ("China", "Consumer Defensive"): "CHIQ"}
COUNTRY_PROXY = {"China": "FXI", "India": "INDA", "Brazil": "EWZ", "Japan": "EWJ", "United Kingdom": "EWU",
                 "Germany": "EWG", "South Korea": "EWY", "Taiwan": "EWT", "Hong Kong": "EWH"}
SECTOR_PROXY = {"Energy": "XLE", "Technology": "XLK", "Financial Services": "XLF", "Healthcare": "XLV",
                "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP", "Industrials": "XLI", "Real Estate": "XLRE",
                "Utilities": "XLU", "Basic Materials": "XLB", "Communication Services": "XLC"}
OTHER_PROXY = "EEM"


def analyst_view(target: Column, price: Column, analysts: Column) -> Column:
    """Struct of clipped target upside and a confidence by number of analysts."""
    ok = (target > 0) & (price > 0)
    conf = step_score(F.coalesce(analysts, F.lit(0)), [(10, 0.8), (5, 0.6), (2, 0.4)], 0.2)
    return F.when(ok, F.struct(clip((target - price) / price, -0.3, 0.3).alias("ret"), conf.alias("conf")))


def proxy_symbol(industry: Column, country: Column, sector: Column) -> Column:
    """Industry word, then country and sector, country, sector, and the non-US default."""
    def lookup(table, key):
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.try_element_at(m, key)
    word = reduce(lambda acc, kv: acc.when(F.contains(F.lower(industry), F.lit(kv[0].lower())), kv[1]),
                  list(INDUSTRY_PROXY.items())[1:],
                  F.when(F.contains(F.lower(industry), F.lit(next(iter(INDUSTRY_PROXY)).lower())), INDUSTRY_PROXY["Fintech"]))
    pair = lookup({f"{a}|{b}": v for (a, b), v in COUNTRY_SECTOR_PROXY.items()}, F.concat_ws("|", country, sector))
    other = F.when(country.isNotNull() & (country != "") & (country != "United States"), OTHER_PROXY)
    return F.coalesce(word, pair, lookup(COUNTRY_PROXY, country), lookup(SECTOR_PROXY, sector), other)


def relative_momentum(closes: DataFrame, market: DataFrame, since: Column) -> DataFrame:
    """View per proxy: half its return over the market's, clipped to +-20 percent."""
    growth = F.max_by("close", "d") / F.min_by("close", "d") - 1
    whole = market.where(F.col("d") >= since).agg(growth).scalar()
    st = closes.where(F.col("d") >= since).groupBy("symbol").agg(growth.alias("proxy_return")).withColumn("market_return", whole)
    rel = F.col("proxy_return") - F.col("market_return")
    conf = F.when(F.abs(rel) > 0.10, 0.7).when(F.abs(rel) > 0.05, 0.5).otherwise(0.3)
    return st.select("symbol", "proxy_return", "market_return", clip(0.5 * rel, -0.2, 0.2).alias("ret"), conf.alias("conf"))


def trend_view(closes: DataFrame) -> DataFrame:
    """Five cases of the last close against SMA 50 and SMA 200 (SMA 50 under 200 bars)."""
    st = last_rows(closes.select("symbol", "d", "close"), 200).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("close", "d").alias("p"), F.avg(F.when(F.col("rn") <= 50, F.col("close"))).alias("s50"),
        F.avg("close").alias("_s200")).where("n >= 50")
    st = st.withColumn("s200", F.when(F.col("n") >= 200, F.col("_s200")).otherwise(F.col("s50"))).drop("_s200")
    p, a, b = F.col("p"), F.col("s50"), F.col("s200")

    def case(down_strong, down, up_strong, up, flat):
        return (F.when((p < a) & (a < b), down_strong).when(p < a, down).when((p > a) & (a > b), up_strong)
                .when(p > a, up).otherwise(flat))
    return st.select("symbol", case(-0.15, -0.08, 0.12, 0.06, 0.0).alias("ret"), case(0.7, 0.5, 0.7, 0.5, 0.3).alias("conf"),
                     F.when(b > 0, (a - b) / b).otherwise(0.0).alias("trend_strength"))


def basket_view(closes: DataFrame) -> DataFrame:
    """Half the basket's return over the data, clipped to +-15 percent."""
    st = closes.groupBy("symbol").agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("basket_return"))
    r = F.col("basket_return")
    return st.select("symbol", "basket_return", clip(0.5 * r, -0.15, 0.15).alias("ret"),
                     F.least(0.4 + 2 * F.abs(r), F.lit(0.7)).alias("conf"))


def combine_views(df: DataFrame, views: list[str], level: Column | None = None) -> DataFrame:
    """Confidence-weighted mean of the present views; mean confidence scaled by the volatility level.

    ``views`` name struct columns ``(ret, conf)``. Rows without any view are dropped.
    """
    zero = F.lit(0.0)
    conf = [F.col(f"{v}.conf") for v in views]
    ret = [F.col(f"{v}.ret") for v in views]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c in conf])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in conf])
    weighted = reduce(lambda a, b: a + b, [F.coalesce(r * c, zero) for r, c in zip(ret, conf)])
    plain = reduce(lambda a, b: a + b, [F.coalesce(r, zero) for r in ret])
    st = df.withColumn("_n", n).where("_n > 0").withColumn(
        "expected_return", F.when(total > 0, weighted / total).otherwise(plain / F.col("_n")))
    scale = F.lit(1.0)
    if level is not None:
        scale = F.when(level > 30, 0.7).when(level > 20, 0.85).when(level < 12, 1.15).otherwise(1.0)
    return st.withColumn("confidence", F.least(total / F.col("_n") * scale, F.lit(0.95))).drop("_n")
