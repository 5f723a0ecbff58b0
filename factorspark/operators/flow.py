"""Option-flow sessions: parsing, scoring, events, positioning trends, recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.windows import decayed_mean, span_alpha

CONTRACT = r"^O:([A-Z0-9.]+?)(\d{6})([CP])(\d{8})$"   # fixed value: option symbol format

# Session filters and event thresholds.
NEAR_BAND = (0.90, 1.10)
MAX_DAYS_TO_EXPIRY = 60
MIN_TOTAL_VOLUME = 100
TRAIL_SESSIONS = 10
SPIKE_RVOL = 3.0
SPIKE_VOLUME = 500
SPIKE_SCORE = 0.5
OI_MIN_BASE = 5000
OI_REL_1D, OI_REL_5D = 0.25, 0.50
OI_TREND_5D, OI_TREND_1D = 0.15, 0.25


def parse_contracts(df: DataFrame, col: str = "contract") -> DataFrame:
    """Split ``O:ROOTyymmddC00123000`` into root, expiry, kind and strike; drop other rows."""
    c = F.col(col)
    hit = df.where(c.rlike(CONTRACT))
    expiry = F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(c, CONTRACT, 2)), F.lit("yyyyMMdd"))
    return (hit.withColumn("root", F.regexp_extract(c, CONTRACT, 1))
            .withColumn("expiry", expiry.cast("date"))
            .withColumn("kind", F.regexp_extract(c, CONTRACT, 3))
            .withColumn("strike", F.regexp_extract(c, CONTRACT, 4).cast("double") / 1000)
            .where(F.col("expiry").isNotNull()))


def session_grid(universe: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per wanted symbol and session; the session list is one array of dates."""
    days = sessions.agg(F.array_sort(F.collect_set("d"))).scalar()
    return universe.select("symbol").distinct().withColumn("_days", days).select(
        "symbol", F.explode("_days").alias("d"))


def score_sessions(contracts: DataFrame, prices: DataFrame, universe: DataFrame) -> DataFrame:
    """Call/put balance of near-the-money contracts per symbol and session, with a status.

    ``contracts`` are parsed rows ``(root, d, expiry, kind, strike, volume, close, oi)``;
    ``prices(symbol, d, close)`` holds the underlying.
    """
    px = prices.select("symbol", "d", F.col("close").alias("underlying"))
    rows = (contracts.withColumnRenamed("root", "symbol")
            .where(F.col("expiry").between(F.col("d"), F.date_add("d", MAX_DAYS_TO_EXPIRY)))
            .join(universe.select("symbol").distinct(), "symbol", "left_semi")
            .join(px, ["symbol", "d"])
            .where((F.col("underlying") > 0) & (F.col("strike") / F.col("underlying")).between(*NEAR_BAND)))
    call, put = F.col("kind") == "C", F.col("kind") == "P"
    notional = F.col("volume") * F.col("close") * 100

    def total(cond, x):
        return F.sum(F.when(cond, x))
    agg = rows.groupBy("symbol", "d").agg(
        F.coalesce(total(call, F.col("volume")), F.lit(0)).alias("_cv"),
        F.coalesce(total(put, F.col("volume")), F.lit(0)).alias("_pv"),
        F.coalesce(total(call, notional), F.lit(0.0)).alias("_cn"),
        F.coalesce(total(put, notional), F.lit(0.0)).alias("_pn"),
        total(call, F.col("oi")).alias("_co"), total(put, F.col("oi")).alias("_po"),
        F.count("oi").alias("_noi"), F.count(F.lit(1)).alias("contracts"))
    grid = session_grid(universe, contracts).join(px, ["symbol", "d"], "left").join(agg, ["symbol", "d"], "left")
    c = F.col
    tot = c("_cv") + c("_pv")
    status = (F.when(c("underlying").isNull() | (c("underlying") <= 0), "NO_PRICE")
              .when(c("contracts").isNull(), "NO_OPTIONS").when(tot < MIN_TOTAL_VOLUME, "LOW_VOLUME").otherwise("OK"))
    ok = c("status") == "OK"
    oi_c = F.when(c("_noi") > 0, F.coalesce("_co", F.lit(0)))
    oi_p = F.when(c("_noi") > 0, F.coalesce("_po", F.lit(0)))
    return grid.withColumn("status", status).select(
        "symbol", "d",
        F.when(ok, F.try_divide(c("_cv") - c("_pv"), tot)).alias("score"),
        F.when(ok & (c("_cn") + c("_pn") > 0), F.try_divide(c("_cn") - c("_pn"), c("_cn") + c("_pn"))).alias("imbalance_notional"),
        F.when(ok & (oi_c + oi_p > 0), F.try_divide(oi_c - oi_p, oi_c + oi_p)).alias("imbalance_oi"),
        F.coalesce("_cv", F.lit(0)).cast("long").alias("call_volume"),
        F.coalesce("_pv", F.lit(0)).cast("long").alias("put_volume"),
        F.coalesce(tot, F.lit(0)).cast("long").alias("total_volume"),
        oi_c.cast("long").alias("call_oi"), oi_p.cast("long").alias("put_oi"),
        c("underlying").alias("underlying_price"), F.coalesce("contracts", F.lit(0)).cast("long").alias("contracts"), "status")


def dedupe_sessions(rows: DataFrame, prefer: str = "last") -> DataFrame:
    """Keep one source per session date: one with open interest beats one without.

    Among several with open interest the last (or first) read wins; without any, the first.
    ``rows`` carry ``source_seq`` (read order); the choice is made on one row per source.
    """
    src = rows.groupBy("d", "source_seq").agg((F.count("call_oi") > 0).alias("_oi"))
    seq = F.col("source_seq")
    key = F.when(F.col("_oi"), F.struct(F.lit(1).alias("a"), (seq if prefer == "last" else -seq).alias("b"))).otherwise(
        F.struct(F.lit(0).alias("a"), (-seq).alias("b")))
    pick = src.groupBy("d").agg(F.max_by("source_seq", key).alias("source_seq"))
    return rows.join(pick, ["d", "source_seq"], "left_semi")


def session_numbers(flow: DataFrame) -> DataFrame:
    """Ordinals of sessions and of sessions that carry open interest (bounded by the calendar)."""
    days = flow.groupBy("d").agg((F.count("call_oi") > 0).alias("has_oi"))
    w = Window.orderBy("d")
    days = days.select("d", "has_oi", F.row_number().over(w).alias("session_no"),
                       F.sum(F.col("has_oi").cast("int")).over(w).alias("oi_no"))
    return flow.join(days, "d")


def relative_volume(flow: DataFrame) -> DataFrame:
    """Mean volume of the previous ten sessions and today's multiple of it."""
    w = Window.partitionBy("symbol").orderBy("session_no").rangeBetween(-TRAIL_SESSIONS, -1)
    st = flow.withColumn("trail_mean", F.avg("total_volume").over(w))
    return st.withColumn("rvol", F.when(F.col("trail_mean") > 0, F.col("total_volume") / F.col("trail_mean")))


def weighted_score(flow: DataFrame, span: float = 3.0, out: str = "score_ema3") -> DataFrame:
    """Exponentially weighted score that skips nulls but lets weights decay over them; after a null the last value stands."""
    return decayed_mean(flow, "score", "session_no", span_alpha(span), out)


def oi_changes(flow: DataFrame, lags: Sequence[int] = (1, 5)) -> DataFrame:
    """Net open-interest change against k open-interest sessions earlier, relative to the base."""
    st = flow.where("has_oi")
    w = Window.partitionBy("symbol").orderBy("oi_no")
    for k in lags:
        f = w.rangeBetween(-k, -k)
        pc, pp = F.max("call_oi").over(f), F.max("put_oi").over(f)
        net = (F.col("call_oi") - pc) - (F.col("put_oi") - pp)
        st = st.withColumns({f"d_call_{k}": F.col("call_oi") - pc, f"d_put_{k}": F.col("put_oi") - pp,
                             f"base_{k}": pc + pp, f"rel_{k}": net / (pc + pp + 1)})
    return st


def _spike(min_score: float, min_volume: float, min_rvol: float) -> Column:
    return ((F.col("status") == "OK") & (F.abs("score") >= min_score) & (F.col("total_volume") >= min_volume)
            & (F.col("trail_mean") > 0) & (F.col("rvol") >= min_rvol))


def volume_spikes(flow: DataFrame, min_score: float = SPIKE_SCORE, min_volume: float = SPIKE_VOLUME,
                  min_rvol: float = SPIKE_RVOL) -> DataFrame:
    """Sessions with extreme balance and abnormal volume."""
    return flow.where(_spike(min_score, min_volume, min_rvol)).withColumn(
        "direction", F.when(F.col("score") > 0, "BULL FLOW").otherwise("BEAR FLOW"))


def oi_builds(changes: DataFrame) -> DataFrame:
    """One-session builds plus five-session builds that the first rule did not flag."""
    base = F.coalesce(F.col("base_1") >= OI_MIN_BASE, F.lit(False))
    one = base & F.coalesce(F.abs("rel_1") >= OI_REL_1D, F.lit(False))
    five = base & F.coalesce(F.abs("rel_5") >= OI_REL_5D, F.lit(False))
    return changes.where(one | five).withColumn("trigger", F.when(one, "1-session").otherwise("5-session")).withColumn(
        "label", F.when(F.col("rel_1") > 0, "CALL BUILD").otherwise("PUT BUILD"))


def oi_trends(flow: DataFrame, sessions: int = 5) -> DataFrame:
    """CALL BUILD / PUT BUILD over the last five (or all available) open-interest sessions."""
    st = oi_changes(flow, (sessions,))
    w = Window.partitionBy("symbol").orderBy("oi_no")
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    span = F.least(F.lit(sessions), F.col("oi_no") - 1)
    # with a shorter history the change is taken against the first session
    pc = F.max(F.when(F.col("oi_no") == 1, F.col("call_oi"))).over(first)
    pp = F.max(F.when(F.col("oi_no") == 1, F.col("put_oi"))).over(first)
    base = F.when(span >= sessions, F.col(f"base_{sessions}")).otherwise(pc + pp)
    rel = F.when(span >= sessions, F.col(f"rel_{sessions}")).otherwise(
        ((F.col("call_oi") - pc) - (F.col("put_oi") - pp)) / (pc + pp + 1))
    st = st.withColumn("_base", base).withColumn("oi_rel", F.when(span >= 1, rel)).withColumn(
        "_cut", F.when(span >= sessions, OI_TREND_5D).otherwise(OI_TREND_1D))
    big = F.col("_base") >= OI_MIN_BASE
    label = (F.when(big & (F.col("oi_rel") >= F.col("_cut")), "CALL BUILD")
             .when(big & (F.col("oi_rel") <= -F.col("_cut")), "PUT BUILD").otherwise(""))
    return st.select("symbol", "d", "oi_rel", label.alias("oi_trend"))


def flow_recommendation(strong_rank: int = 25) -> Column:
    """First matching rule over event, OI trend, weighted score and stability rank."""
    bull, bear = F.col("event") == "BULL", F.col("event") == "BEAR"
    call, put = F.col("oi_trend") == "CALL BUILD", F.col("oi_trend") == "PUT BUILD"
    ema = F.coalesce("score_ema3", F.lit(0.0))
    strong = F.col("stability_rank") <= strong_rank
    # fixed values: labels and thresholds
    return (F.when(put & bear, "STRONG SELL - Exit signal: put positioning plus bear flow event")
            .when(put & (ema < -0.2), "SELL - Protect: sustained put positioning with negative flow")
            .when(put, "HOLD - Caution: put OI building against quality rank, watch closely")
            .when(bear, "HOLD - Delay entry: bear flow event, reassess in 2-3 sessions")
            .when(call & bull & strong, "STRONG BUY - Enter now: OI build and flow event aligned")
            .when(call & strong, "STRONG BUY - Enter: call OI building on top-quality name")
            .when(call, "BUY - Accumulate: call OI building")
            .when(bull, "BUY - Enter: bull flow event (no OI confirmation yet)")
            .when(~F.col("has_flow"), "AMBIGUOUS - Not enough options data to judge (thin or no options market)")
            .when(ema >= 0.3, "BUY - Accumulate: positive flow tilt")
            .when(ema <= -0.3, "HOLD - Wait: negative flow tilt")
            .otherwise("HOLD - Wait: neutral flow"))


# Order of the tiers in a report.
TIERS = ("STRONG BUY", "BUY", "HOLD", "SELL", "STRONG SELL", "AMBIGUOUS")


def confluence(stability: DataFrame, flow: DataFrame, target: Column, strong_rank: int = 25,
               min_score: float = SPIKE_SCORE, min_volume: float = SPIKE_VOLUME,
               min_rvol: float = SPIKE_RVOL) -> DataFrame:
    """Stability rank x flow event x OI trend at the target session, with recommendation and order."""
    trend = oi_trends(flow).where(F.col("d") == target).drop("d")
    now = weighted_score(relative_volume(flow)).where(F.col("d") == target)
    spike = F.coalesce(_spike(min_score, min_volume, min_rvol), F.lit(False))
    now = now.select("symbol", F.col("score").alias("flow_score"), "score_ema3", "rvol",
                     F.when(spike & (F.col("score") > 0), "BULL").when(spike & (F.col("score") < 0), "BEAR")
                     .otherwise("").alias("event"), (F.col("status") == "OK").alias("has_flow"))
    st = stability.join(now, "symbol", "left").join(trend, "symbol", "left")
    st = (st.withColumn("event", F.coalesce("event", F.lit(""))).withColumn("oi_trend", F.coalesce("oi_trend", F.lit("")))
          .withColumn("has_flow", F.coalesce("has_flow", F.lit(False))))
    st = st.withColumn("recommendation", flow_recommendation(strong_rank))
    tier = F.split("recommendation", " - ")[0]
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
    return st.withColumn("tier", tier).withColumn("tier_order", order.cast("int"))


def alert_report(spikes: DataFrame, builds: DataFrame, watchlist: DataFrame, holdings: DataFrame) -> DataFrame:
    """Events, builds, watch-list hits and exit alerts as one sectioned table."""
    def section(df, name, label, with_volume):
        nul = F.lit(None).cast("double")
        return df.select(F.lit(name).alias("section"), "symbol", "d", label.alias("label"),
                         F.col("score"), (F.col("total_volume").cast("double") if with_volume else nul).alias("volume"),
                         (F.col("rvol") if with_volume else nul).alias("rvol"))
    watched = watchlist.select("symbol").distinct()
    held = holdings.select("symbol").distinct()
    s, b = spikes, builds
    exit_s = s.join(held, "symbol", "left_semi")
    exit_label = F.when(F.col("score") < 0, "EXIT REVIEW").otherwise("VOLATILITY NOTE")
    parts = [
        section(s, "VOLUME_SPIKE", F.col("direction"), True),
        section(b, "OI_BUILD", F.col("label"), False),
        section(s.join(watched, "symbol", "left_semi"), "WATCHLIST", F.col("direction"), True),
        section(b.join(watched, "symbol", "left_semi"), "WATCHLIST", F.col("label"), False),
        section(exit_s, "EXIT_ALERT", exit_label, False).withColumn("score", F.lit(None).cast("double")),
        section(b.join(held, "symbol", "left_semi").where(F.col("label") == "PUT BUILD"), "EXIT_ALERT",
                F.lit("EXIT REVIEW"), False).withColumn("score", F.lit(None).cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_snapshot(df: DataFrame, date: str = "d", keys: Sequence[str] = (), n: int | None = None,
                    by: Sequence[Column] = ()) -> DataFrame:
    """Rows of the newest date per key, optionally only the first ``n`` of them."""
    if keys:
        newest = df.groupBy(*keys).agg(F.max(date).alias("_newest"))
        out = df.join(newest, list(keys)).where(F.col(date) == F.col("_newest")).drop("_newest")
    else:
        out = df.where(F.col(date) == df.agg(F.max(date)).scalar())
    if n is None:
        return out
    w = Window.partitionBy(*keys).orderBy(*by)
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
