"""Trade ledger: average-cost positions, held shares, dividends, values, profit tables.

Orders inside a day are fixed by ``tx_seq``. A position (portfolio, symbol), and a day of it, may own any share of all
trades: trades are dealt over sampled ranges of (position, day, tx_seq), and what a range needs of those before it is carried over
as running sums and minima or as maps, one small row for each range of a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.session import checkpointed, settled, shared

EPS = 1e-9
KEY = ["portfolio", "symbol"]
BLOCK_ROWS = 50_000
FAN = 512   # blocks composed at a time
MAP_FAN = 4096
RANGES_MOST = 65_536   # borders that a range partitioning keeps on the driver
STRIDE = 1 << 20    # blocks of one range are numbered from a multiple of it
MARGIN = 1e-6   # what rounding may add up to in the bounds of opening shares
UNBOUNDED = Window.unboundedPreceding


def normalise(tx: DataFrame) -> DataFrame:
    """Trimmed upper-case symbols and capitalised types; missing amounts are 0."""
    zero = F.lit(0.0)
    return tx.select("portfolio", F.upper(F.trim("symbol")).alias("symbol"), F.initcap(F.trim("type")).alias("type"),
                     F.coalesce("price", zero).alias("price"), F.coalesce("shares", zero).alias("shares"), "d",
                     F.coalesce("commission", zero).alias("commission"), "tx_seq")


# ---- held shares -----------------------------------------------------------------------

def _ranges(tx: DataFrame, rows_each: int) -> int:
    """One range for ``rows_each`` trades, within the borders that a range partitioning may keep."""
    return max(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES_MOST, -(-tx.count() // rows_each)))


def ranged(tx: DataFrame, rows_each: int = BLOCK_ROWS) -> DataFrame:
    """Trades with the number ``rng`` of their range by (position, day, tx_seq), about ``rows_each`` rows each, written once.

    The ranges of a position follow each other by number; one that owns most trades, or one day of it, just has many of them. Beyond
    RANGES_MOST ranges they grow instead, and whoever needs bounded blocks cuts them.
    """
    # the number must not change between its uses, so it is written
    return checkpointed(tx.repartitionByRange(_ranges(tx, rows_each), *KEY, "d", "tx_seq").withColumn("rng", F.spark_partition_id()))


def daily_shares(tx: DataFrame, rows_each: int = BLOCK_ROWS) -> DataFrame:
    """Shares held after each trading day; a sale never takes them below zero.

    A walk that is stopped at zero equals the running sum minus its lowest value below zero. Both run inside a range of a position; the
    sums and minima of the ranges before are added, so neither a position nor a day of it is ever sorted as a whole.
    """
    q = F.when(F.col("type") == "Buy", F.col("shares")).when(F.col("type") == "Sell", -F.col("shares"))
    rows = ranged(tx.select(*KEY, "d", "tx_seq", q.alias("q")).where("q is not null"), rows_each)
    own = Window.partitionBy(*KEY, "rng").orderBy("d", "tx_seq")
    upto = own.rowsBetween(UNBOUNDED, 0)
    rows = rows.select(*KEY, "rng", "d", "q", F.sum("q").over(upto).alias("_run"), F.lead("d").over(own).alias("_next")).withColumn(
        "_low", F.min("_run").over(Window.partitionBy(*KEY, "rng").orderBy("d").rangeBetween(UNBOUNDED, 0)))
    # of each day of a range: its net, and the sum and the minimum of the range when it ends
    day = rows.groupBy(*KEY, "rng", "d").agg(F.sum("q").alias("net"), F.max(F.when(F.col("_next").isNull() | (F.col("_next") != F.col("d")), F.col("_run"))).alias(
        "_run"), F.min("_low").alias("_low"))
    whole = day.groupBy(*KEY, "rng").agg(F.max_by("_run", "d").alias("_sum"), F.min("_low").alias("_least"))
    earlier = Window.partitionBy(*KEY).orderBy("rng").rowsBetween(UNBOUNDED, -1)
    whole = whole.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    whole = whole.withColumn("_floor", F.coalesce(F.min(F.col("_before") + F.col("_least")).over(earlier), F.lit(0.0)))
    st = day.join(whole.select(*KEY, "rng", "_before", "_floor"), [*KEY, "rng"])
    held = F.col("_before") + F.col("_run") - F.least(F.lit(0.0), F.col("_floor"), F.col("_before") + F.col("_low"))
    return st.groupBy(*KEY, "d").agg(F.sum("net").alias("net"), F.max_by(held, "rng").alias("held"))


def held_on(dates: DataFrame, tx: DataFrame, carry: str) -> DataFrame:
    """``dates(portfolio, symbol, d, <carry>)``, unique by key and day, with the shares held then.

    Trades on the day count. The rows are interleaved with the trading days, so the value is
    carried along and nothing has to be joined back.
    """
    moves = daily_shares(tx).select(*KEY, "d", "held", F.lit(None).cast("double").alias(carry))
    asks = dates.select(*KEY, "d", F.lit(None).cast("double").alias("held"), F.col(carry).cast("double").alias(carry))
    both = moves.unionByName(asks)
    w = Window.partitionBy(*KEY).orderBy("d").rangeBetween(UNBOUNDED, 0)
    st = both.withColumn("_h", F.last("held", ignorenulls=True).over(w)).where(F.col(carry).isNotNull())
    return st.select(*KEY, "d", carry, F.coalesce("_h", F.lit(0.0)).alias("held"))


def auto_dividends(tx: DataFrame, dividends: DataFrame) -> DataFrame:
    """Dividend income of positions without manual dividend rows: shares held on each ex-date."""
    manual = tx.where(F.col("type") == "Dividend").select(*KEY).distinct()
    open_ = tx.where(F.col("type") != "Dividend").select(*KEY).distinct().join(manual, KEY, "left_anti")
    due = open_.join(dividends.where(F.col("amount") > 0).select("symbol", F.col("ex_date").alias("d"), "amount"), "symbol")
    paid = held_on(due, tx, "amount").where(F.col("held") > EPS)
    return paid.groupBy(*KEY).agg(F.sum(F.col("held") * F.col("amount")).alias("dividend_income"))


def daily_value(tx: DataFrame, closes: DataFrame) -> DataFrame:
    """Portfolio value per price date from the shares held that day; only positive values."""
    names = tx.where(F.col("type").isin("Buy", "Sell")).select(*KEY).distinct()
    px = names.join(closes.where(F.col("close") > 0).select("symbol", "d", "close"), "symbol")
    held = held_on(px, tx, "close").where(F.col("held") > EPS)
    val = held.groupBy("portfolio", "d").agg(F.sum(F.col("held") * F.col("close")).alias("value"))
    return val.where(F.col("value") > 0)


# ---- average cost ----------------------------------------------------------------------

BUY, SELL, DIVIDEND = 1, 2, 3
FACTS = ("net", "low", "big", "at_sale")


def _facts(kind: np.ndarray, shares: np.ndarray) -> tuple[float, float, float, float]:
    """Net of bought and sold shares, its lowest value (0 at most), the largest sale, the lowest value a sale meets."""
    sold = kind == SELL
    q = np.where(kind == BUY, shares, np.where(sold, -shares, 0.0))
    run = np.cumsum(q)
    return run[-1], min(run.min(), 0.0), max(shares[sold].max(), 0.0) if sold.any() else 0.0, (run - q)[sold].min() if sold.any() else np.inf


def _blocks(tx: DataFrame, block_rows: int) -> DataFrame:
    """Trades of each range of a position as arrays of at most ``block_rows`` in order, with their facts; ``blk`` numbers them.

    Ranges are sorted once, where they are dealt, and cut into blocks as they stream by. A range holds many small blocks: a shuffle has
    a part for each range, so their number must follow from the trades and not from the size of a block. A position without a portfolio
    or symbol meets nothing in the joins on them.
    """
    kind = F.when(F.col("type") == "Buy", BUY).when(F.col("type") == "Sell", SELL).when(F.col("type") == "Dividend", DIVIDEND).otherwise(0)
    order = [*KEY, "d", "tx_seq"]
    rows = tx.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY)).select(*order, kind.cast("tinyint").alias("ops"), "price", "shares", "commission")
    rows = rows.repartitionByRange(_ranges(tx, max(block_rows, BLOCK_ROWS)), *order).sortWithinPartitions(*order).drop("d", "tx_seq")
    columns = ["ops", "price", "shares", "commission"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() * STRIDE + 1
        key, sub, parts, size = None, 0, [], 0

        def block() -> tuple:
            held = [np.concatenate(x) for x in zip(*parts)]
            return (*key, first + sub, *held, *_facts(held[0], held[2]))
        names = [*KEY, "blk", *columns, *FACTS]
        for batch in batches:
            if not len(batch):
                continue
            a, b = (batch[k].to_numpy() for k in KEY)
            new = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
            values, out = [batch[c].to_numpy() for c in columns], []
            for at, end in zip([0, *new], [*new, len(batch)]):
                if key != (a[at], b[at]):
                    if size:
                        out.append(block())
                    key, sub, parts, size = (a[at], b[at]), 0, [], 0
                while at < end:
                    upto = min(end, at + block_rows - size)
                    parts.append([v[at:upto] for v in values])
                    size, at = size + upto - at, upto
                    if size == block_rows:
                        out.append(block())
                        sub, parts, size = sub + 1, [], 0
            if out:
                yield pd.DataFrame(out, columns=names)
        if size:
            yield pd.DataFrame([block()], columns=names)
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEY)
    doubles = ", ".join(f"{c} double" for c in FACTS)
    # the numbers must not change between their uses, so they are written
    return checkpointed(rows.mapInPandas(cut, f"{types}, blk long, ops array<tinyint>, price array<double>, shares array<double>, "
                                              f"commission array<double>, {doubles}"))


# The walks go through a block's trades in order. A sale counts only while something is held; NaN counts as held, as it does in SQL.

def _walked(kinds: list, shares: list, s: float) -> float:
    """Shares after the block."""
    for k, q in zip(kinds, shares):
        if k == BUY:
            s += q
        elif k == SELL and not s <= EPS:
            s -= q
    return s


def _walk_cost(ops: pd.Series, price: pd.Series, shares: pd.Series, start: pd.Series) -> pd.DataFrame:
    """The block's effect on cost as ``scale * cost + add`` for known shares at its start."""
    out = []
    for kinds, prices, amounts, s in zip(ops, price, shares, start):
        scale, add = 1.0, 0.0
        for k, p, q in zip(kinds.tolist(), prices.tolist(), amounts.tolist()):
            if k == BUY:
                s, add = s + q, add + q * p
            elif k == SELL and not s <= EPS:
                left = max((s - q) / s, 0.0)
                s, scale, add = s - q, scale * left, add * left
        out.append((scale, add))
    return pd.DataFrame(out, columns=["scale", "add"])


TOTALS = ("realized", "open_commission", "realized_commission", "dividends", "bought", "commission")


def _walk_full(ops: pd.Series, price: pd.Series, shares: pd.Series, commission: pd.Series, start: pd.Series, cost: pd.Series) -> pd.DataFrame:
    """Shares and cost after the block, and what it adds to the totals."""
    out = []
    for kinds, prices, amounts, fees, s, c in zip(ops, price, shares, commission, start, cost):
        realized = opened = closed = paid = bought = every = 0.0
        for k, p, q, fee in zip(kinds.tolist(), prices.tolist(), amounts.tolist(), fees.tolist()):
            every += fee
            if k == BUY:
                s, c, bought, opened = s + q, c + q * p, bought + q * p, opened + fee
            elif k == SELL and not s <= EPS:
                avg = c / s
                s, realized, opened, closed = s - q, realized + (p - avg) * q - fee, opened + fee, closed + fee
                c = max(s * avg, 0.0)
            elif k == DIVIDEND:
                paid, closed = paid + q * p - fee, closed + fee
        out.append((s, c, realized, opened, closed, paid, bought, every))
    return pd.DataFrame(out, columns=["s", "c", *TOTALS])


def share_map(moves: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """What trades do to opening shares in (lo, hi]: ends of intervals, and what is added to the shares that start in each.

    ``moves`` are bought (positive) or sold shares. A sale counts for those who hold something then, which cuts an interval at the
    opening shares that are just used up.
    """
    lower, upper, shift = np.array([lo]), np.array([hi]), np.zeros(1)
    for q in moves:
        if q >= 0:
            shift = shift + q
            continue
        edge = EPS - shift                          # who started above it still holds shares
        cut = (lower < edge) & (edge < upper)
        if cut.any():
            at = np.flatnonzero(cut)
            lower, upper = np.insert(lower, at + 1, edge[at]), np.insert(upper, at, edge[at])
            shift, edge = np.insert(shift, at, shift[at]), np.insert(edge, at, edge[at])
        shift = np.where(lower >= edge, shift + q, shift)
        same = np.flatnonzero(shift[1:] == shift[:-1])
        if len(same):
            lower, upper, shift = np.delete(lower, same + 1), np.delete(upper, same), np.delete(shift, same)
    return upper, shift


def compose_maps(first: tuple[np.ndarray, np.ndarray], lo: float, then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map ``first`` (from ``lo`` on) followed by the map ``then``."""
    ends, adds, lower = [], [], lo
    for upper, shift in zip(*first):
        cuts = then[0][:-1] - shift
        inner = cuts[(cuts > lower) & (cuts < upper)]
        for end in (*inner, upper):
            ends.append(end)
            adds.append(shift + then[1][_interval(then[0], (lower + end) / 2 + shift)])
            lower = end
    keep = [k for k in range(len(ends)) if k + 1 == len(ends) or adds[k] != adds[k + 1]]
    return np.array(ends)[keep], np.array(adds)[keep]


def _interval(ends: np.ndarray, s: float) -> int:
    """The interval that ``s`` lies in; rounding may put it a little beyond either end."""
    return min(int(np.searchsorted(ends, s, side="left")), len(ends) - 1)


def _opening_shares(blocks: DataFrame) -> DataFrame:
    """Shares at the start of every block: blocks as maps of opening shares, composed in a tree of two levels.

    A walk that is stopped at zero has a closed form, and the ledger's shares lie at most the largest earlier sale below it (a sale of
    more than is held leaves a debt). So a block's map is needed on an interval of that length only. Where no sale of the block can
    meet an empty position it is one interval; before the first sale it is one point.
    """
    earlier = Window.partitionBy(*KEY).orderBy("blk").rowsBetween(UNBOUNDED, -1)
    state = blocks.select(*KEY, "blk", *FACTS)
    state = state.withColumn("_before", F.coalesce(F.sum("net").over(earlier), F.lit(0.0)))
    state = state.withColumns({"_floor": F.least(F.min(F.col("_before") + F.col("low")).over(earlier), F.lit(0.0)),
                               "_debt": F.coalesce(F.max("big").over(earlier), F.lit(0.0))})
    hi = F.col("_before") - F.coalesce("_floor", F.lit(0.0))
    state = state.select(*KEY, "blk", (hi + MARGIN).alias("hi"), (hi - F.col("_debt") - MARGIN).alias("lo"), (F.col("_debt") == 0).alias("exact"))
    st = blocks.join(state, [*KEY, "blk"])
    plain = F.col("lo") + F.col("at_sale") > EPS
    asked = F.col("exact") | ~plain

    @F.pandas_udf("upto array<double>, add array<double>")
    def mapped(ops: pd.Series, shares: pd.Series, lo: pd.Series, hi: pd.Series, exact: pd.Series) -> pd.DataFrame:
        out = []
        for kinds, amounts, low, high, known in zip(ops, shares, lo, hi, exact):
            if kinds is None:
                out.append((None, None))
            elif known:
                point = high - MARGIN
                out.append(([high], [_walked(kinds.tolist(), amounts.tolist(), point) - point]))
            else:
                moves = np.where(kinds == BUY, amounts, -amounts)[(kinds == BUY) | (kinds == SELL)]
                out.append(tuple(x.tolist() for x in share_map(moves, low, high)))
        return pd.DataFrame(out, columns=["upto", "add"])
    st = st.select(*KEY, "blk", "lo", "hi", "net", "exact", *[F.when(asked, F.col(c)).alias(c) for c in ("ops", "shares")])
    st = st.withColumn("m", mapped("ops", "shares", "lo", "hi", "exact"))
    maps = settled(st.select(*KEY, "blk", F.floor(F.col("blk") / MAP_FAN).alias("grp"), "lo",
                             F.coalesce("m.upto", F.array("hi")).alias("upto"), F.coalesce("m.add", F.array("net")).alias("add")))

    def composed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("blk")
        lo, whole = part["lo"].iloc[0], None
        for upto, add in zip(part["upto"], part["add"]):
            one = (np.asarray(upto), np.asarray(add))
            whole = one if whole is None else compose_maps(whole, lo, one)
        return pd.DataFrame([(key[0], key[1], key[2], whole[0].tolist(), whole[1].tolist())], columns=[*KEY, "grp", "upto", "add"])

    def handed(part: pd.DataFrame, s: float) -> list[float]:
        out = []
        for upto, add in zip(part["upto"], part["add"]):
            out.append(s)
            s += add[_interval(np.asarray(upto), s)]
        return out

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("grp")
        return pd.DataFrame({**dict(zip(KEY, key)), "grp": part["grp"], "s0": handed(part, 0.0)})

    def down(key: tuple, part: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("blk")
        return pd.DataFrame({**dict(zip(KEY, key)), "blk": part["blk"], "s0": handed(part, float(starts["s0"].iloc[0]))})
    types = ", ".join(f"{c} {maps.schema[c].dataType.simpleString()}" for c in KEY)
    groups = maps.groupBy(*KEY, "grp").applyInPandas(composed, f"{types}, grp long, upto array<double>, add array<double>")
    starts = groups.groupBy(*KEY).applyInPandas(top, f"{types}, grp long, s0 double")
    return maps.groupBy(*KEY, "grp").cogroup(starts.groupBy(*KEY, "grp")).applyInPandas(down, f"{types}, blk long, s0 double")


def _opening_cost(maps: DataFrame, fan: int, levels: int = 3) -> DataFrame:
    """Cost at the start of every block from the blocks' maps ``scale * cost + add``.

    Maps are composed in groups of ``fan`` over a few levels and the costs handed back down,
    so no array is longer than ``fan`` except the last level's.
    """
    grouped = maps.withColumn("_g", F.floor((F.col("blk") - 1) / fan) + 1 if levels > 1 else F.lit(1).cast("long"))
    packs = grouped.groupBy(*KEY, "_g").agg(F.array_sort(F.collect_list(F.struct("blk", "scale", "add"))).alias("_m"))

    def compose(acc, m):
        return F.struct((acc["scale"] * m["scale"]).alias("scale"), (acc["add"] * m["scale"] + m["add"]).alias("add"))

    def hand_on(acc, m):
        return F.struct((acc["c"] * m["scale"] + m["add"]).alias("c"), F.array_append(
            acc["path"], F.struct(m["blk"].alias("blk"), acc["c"].alias("c0"))).alias("path"))
    if levels > 1:
        whole = F.aggregate("_m", F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("add")), compose)
        upper = packs.select(*KEY, F.col("_g").alias("blk"), whole.alias("w")).select(*KEY, "blk", "w.scale", "w.add")
        starts = _opening_cost(upper, fan, levels - 1).select(*KEY, F.col("blk").alias("_g"), F.col("c0").alias("_c"))
        packs = packs.join(starts, [*KEY, "_g"])
    else:
        packs = packs.withColumn("_c", F.lit(0.0))
    empty = F.array().cast("array<struct<blk:bigint,c0:double>>")
    path = F.aggregate("_m", F.struct(F.col("_c").alias("c"), empty.alias("path")), hand_on)["path"]
    return packs.select(*KEY, F.inline(path))


def positions(tx: DataFrame, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Average-cost result per position: shares, cost, realized profit, dividends, commissions."""
    at = [*KEY, "blk"]
    cost = F.pandas_udf(_walk_cost, "scale double, add double")
    full = F.pandas_udf(_walk_full, "s double, c double, " + ", ".join(f"{n} double" for n in TOTALS))
    # stored by what they are joined on: only the small sides of the joins move
    blocks = settled(_blocks(tx, block_rows).repartition(*at))
    opened = blocks.select(*at, "ops", "price", "shares", "commission").join(_opening_shares(blocks), at)
    # every level of the tree reads the maps, so the walks are stored
    costs = _opening_cost(settled(opened.select(*at, cost("ops", "price", "shares", "s0").alias("m")).select(*at, "m.scale", "m.add")), fan)
    done = opened.join(costs, at).select(*at, full("ops", "price", "shares", "commission", "s0", "c0").alias("r"))
    out = done.groupBy(*KEY).agg(F.max_by("r.s", "blk").alias("shares"), F.max_by("r.c", "blk").alias("total_cost"),
                                 *[F.sum(f"r.{n}").alias(n) for n in TOTALS])
    # one row for each position, which several tables are made of: the walks run once
    return shared(out.withColumn("avg_cost", F.when(F.col("shares") > EPS, F.col("total_cost") / F.col("shares"))))


def open_positions(pos: DataFrame) -> DataFrame:
    return pos.where(F.col("shares") > EPS).select(*KEY, "shares", "total_cost", "avg_cost",
                                                   F.col("open_commission").alias("commission"))


def realized_positions(pos: DataFrame) -> DataFrame:
    """Positions with realized profit (sales and dividends) or commission."""
    st = pos.select(*KEY, (F.col("realized") + F.col("dividends")).alias("realized_pnl"),
                    F.col("realized_commission").alias("commission"))
    return st.where((F.abs("realized_pnl") > 1e-6) | (F.col("commission") > 0))


def holdings(pos: DataFrame, closes: DataFrame) -> DataFrame:
    """Open positions at the last two prices: value, day change, profit and weight."""
    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    last = closes.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").groupBy("symbol").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("_p"), F.max(F.when(F.col("_rn") == 2, F.col("close"))).alias("_q"))
    st = open_positions(pos).join(last, "symbol", "left")
    price = F.coalesce("_p", "avg_cost")
    change = F.when(F.col("_q").isNotNull(), F.col("_p") - F.col("_q")).otherwise(0.0)
    st = st.withColumn("price", price).withColumn("day_change", change).withColumn(
        "day_change_pct", F.when(F.col("_q") > 0, F.col("day_change") / F.col("_q") * 100).otherwise(0.0))
    st = st.withColumn("market_value", F.col("shares") * F.col("price")).withColumn(
        "pnl", F.col("market_value") - F.col("total_cost")).withColumn(
        "pnl_pct", F.when(F.col("total_cost") > 0, F.col("pnl") / F.col("total_cost") * 100).otherwise(0.0))
    total = st.groupBy("portfolio").agg(F.sum("market_value").alias("_t"))
    return st.join(total, "portfolio").withColumn("weight", F.when(
        F.col("_t") > 0, F.col("market_value") / F.col("_t") * 100).otherwise(0.0)).drop("_p", "_q", "_t")


def portfolio_totals(pos: DataFrame, held: DataFrame, tx: DataFrame, as_of: Column) -> DataFrame:
    """Profit, return on money bought, day change and annualised return per portfolio."""
    base = pos.groupBy("portfolio").agg(F.sum("realized").alias("realized"), F.sum("dividends").alias("dividends"),
                                        F.sum("commission").alias("commission"), F.sum("bought").alias("bought"))
    mark = held.groupBy("portfolio").agg(F.sum("market_value").alias("market_value"), F.sum("total_cost").alias("open_cost"),
                                         F.sum(F.col("day_change") * F.col("shares")).alias("day_change"))
    first = tx.groupBy("portfolio").agg(F.min("d").alias("first_day"))
    st = base.join(mark, "portfolio", "left").join(first, "portfolio").fillna(0.0, ["market_value", "open_cost", "day_change"])
    st = st.withColumn("unrealized", F.col("market_value") - F.col("open_cost"))
    st = st.withColumn("total_pnl", F.col("realized") + F.col("dividends") + F.col("unrealized"))
    st = st.withColumn("total_pnl_pct", F.when(F.col("bought") > 0, F.col("total_pnl") / F.col("bought") * 100).otherwise(0.0))
    days = F.datediff(as_of, F.col("first_day"))
    base_ = F.greatest(1 + F.col("total_pnl_pct") / 100, F.lit(1e-9))
    ann = F.when((days > 30) & (F.col("bought") > 0), (F.pow(base_, 365.0 / days) - 1) * 100).otherwise(0.0)
    return st.withColumn("annualised_return", ann).withColumn("day_change_pct", F.when(
        F.col("market_value") > 0, F.col("day_change") / F.col("market_value") * 100).otherwise(0.0)).drop("first_day")


def contributions(held: DataFrame, realized: DataFrame) -> DataFrame:
    """Unrealized plus realized profit per symbol."""
    a = held.select(*KEY, F.col("pnl").alias("unrealized"))
    b = realized.select(*KEY, F.col("realized_pnl").alias("realized"))
    j = a.join(b, KEY, "full").fillna(0.0, ["unrealized", "realized"])
    return j.withColumn("contribution", F.col("unrealized") + F.col("realized"))


def allocation(held: DataFrame, companies: DataFrame, by: str = "industry") -> DataFrame:
    """Share of market value per industry (or sector); unknown where the company is missing."""
    st = held.join(companies.select("symbol", by), "symbol", "left").withColumn(by, F.coalesce(by, F.lit("Unknown")))
    agg = st.groupBy("portfolio", by).agg(F.sum("market_value").alias("market_value"))
    total = agg.groupBy("portfolio").agg(F.sum("market_value").alias("_t"))
    return agg.join(total, "portfolio").withColumn("share", F.try_divide(F.col("market_value"), F.col("_t")) * 100).drop("_t")
