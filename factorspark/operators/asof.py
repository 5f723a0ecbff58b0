"""What each snapshot of a symbol could know, from running states: one pass over the history serves all its dates.

A state (count, sum, maximum, mean, deviation, covariance, ...) is carried along a symbol's rows in date order; snapshots stand
among the rows as markers and read the state they meet. The work is that of the history plus that of the snapshots, however many
there are. Only two measures restart at each snapshot by their definition, the ADX and the drawdown at risk: for these (and for what looks back a year at most) a
marker gets its last 252 bars as one small array, so their work is bounded by 252 bars a snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.functions.windows import by_symbol, simple_return
from factorspark.operators.factors import beta_columns, tail_columns, with_stability
from factorspark.operators.indicators import TRADING_DAYS, profile_facts, recovery_column, with_technical

RUNNING = (Window.unboundedPreceding, 0)
HALF_YEAR = 126
NEAR_PEAK = 0.99


def _marked(rows: DataFrame, snapshots: DataFrame, date: str) -> DataFrame:
    """Rows and snapshots as one series: ``_d`` is the date, ``_bar`` tells rows, ``_mark`` is the date of a snapshot."""
    marks = snapshots.select("symbol", F.col("until").alias("_d"), F.lit(False).alias("_bar"), F.col("as_of").alias("_mark"))
    return rows.withColumnRenamed(date, "_d").withColumn("_bar", F.lit(True)).unionByName(marks, allowMissingColumns=True)


def with_until(snapshots: DataFrame, until: Column | None = None) -> DataFrame:
    """``(symbol, as_of, until)``: a snapshot knows what is dated ``until`` or earlier, by default its own date."""
    return snapshots.select("symbol", "as_of", (F.col("as_of") if until is None else until).alias("until"))


def _series():
    """Rows come before the markers of their day."""
    return Window.partitionBy("symbol").orderBy("_d", F.desc("_bar"), "_mark")


def last_known(tables: Sequence[tuple[DataFrame, str, Sequence[str]]], snapshots: DataFrame) -> DataFrame:
    """``(symbol, as_of, *values)``: for each snapshot the values of the latest row it knows of each table, nulls where there is none.

    ``tables`` are (rows, date column, value columns), rows unique on (symbol, date). One exchange for all of them; no pair of a row and a
    snapshot is ever formed.
    """
    series, values = None, [v for _, _, columns in tables for v in columns]
    for k, (rows, date, columns) in enumerate(tables):
        rows = rows.select("symbol", F.col(date).alias("_d"), F.struct(*columns).alias(f"_s{k}"))
        series = rows if series is None else series.unionByName(rows, allowMissingColumns=True)
    upto = _series().rowsBetween(*RUNNING)
    seen = [F.last(f"_s{k}", ignorenulls=True).over(upto).alias(f"_s{k}") for k in range(len(tables))]
    out = _marked(series, snapshots, "_d").select("symbol", "_bar", F.col("_mark").alias("as_of"), *seen).where("NOT _bar")
    return out.select("symbol", "as_of", *[f"_s{k}.*" for k in range(len(tables))]).select("symbol", "as_of", *values)


def dividend_states(divs: DataFrame) -> DataFrame:
    """``(symbol, ex_date, dividend_cagr, streak)`` of what was paid up to each payment; amounts are not negative.

    ``divs(symbol, ex_date, amount)``, unique on symbol and date. The running year counts with what it paid so far. One exchange serves all windows.
    """
    year = Window.partitionBy("symbol", "yr").orderBy("ex_date")
    paid = divs.repartition("symbol").withColumn("yr", F.year("ex_date")).withColumn("_so_far", F.sum("amount").over(year.rowsBetween(*RUNNING))).where("_so_far > 0")
    w = by_symbol(order=("ex_date",)).rowsBetween(*RUNNING)
    paid = paid.withColumns({"_y0": F.min("yr").over(w), "_new": (F.row_number().over(year) == 1).cast("long")})
    paid = paid.withColumns({"streak": F.sum("_new").over(w), "_a0": F.max(F.when(F.col("yr") == F.col("_y0"), F.col("_so_far"))).over(w)})
    span = F.col("yr") - F.col("_y0")
    paid = paid.withColumn("dividend_cagr", F.when(span >= 1, F.pow(F.col("_so_far") / F.col("_a0"), 1 / span) - 1))
    return paid.select("symbol", "ex_date", "dividend_cagr", "streak")


def surprise_states(surprises: DataFrame, n: int = 4) -> DataFrame:
    """``(symbol, d, mean_surprise)``: mean of the last ``n`` surprises at each."""
    mean = F.avg("surprise_pct").over(by_symbol().rowsBetween(1 - n, 0))
    return surprises.where("surprise_pct IS NOT NULL").select("symbol", "d", mean.alias("mean_surprise"))


def bar_states(bars: DataFrame, market: DataFrame, snapshots: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(symbol, as_of, n_bars, technical, momentum_12m, stability)`` of each snapshot, nulls before a symbol's first bar.

    ``bars(symbol, d, high, low, close)`` unique on symbol and date, ``market(d, close)`` one row a day, ``snapshots(symbol, as_of,
    until)`` unique on symbol and as_of. Bars and markers are exchanged once, by symbol, and each symbol's series (a row a calendar day at
    most) is read through once in date order; nothing is stored. ``tasks`` is for a caller who knows how many sort the rows in memory.
    """
    day = market.select(F.lit("MKT").alias("symbol"), "d", "close")
    day = day.select("d", simple_return(F.col("close"), by_symbol()).alias("mret"))     # one row a day, as many as the calendar has
    rows = bars.select("symbol", "d", "high", "low", "close").join(day, "d", "left")
    series = _marked(rows, snapshots, "d").select("symbol", "_d", "_bar", "_mark", *BAR)
    dealt = series.repartition(*([tasks] if tasks else []), "symbol").sortWithinPartitions("symbol", "_d", F.desc("_bar"), "_mark")
    st = dealt.select("symbol", "_bar", "_mark", *BAR).mapInArrow(_told, FACTS_SCHEMA)
    beta, score = beta_columns()
    volatility, cvar = tail_columns()
    st = st.withColumn("beta", beta).withColumn("beta_score", score).select("*", volatility, cvar)
    kept = [c for c in st.columns if c not in ("n_bars", "high_close", "last_close", "_first", "_s50", "_s200", "_slope")]
    st = with_stability(with_technical(profile_facts(st, kept)).withColumn("recovery", recovery_column()))
    known = F.col("n_bars") > 0
    return st.select("symbol", "as_of", "n_bars", *[F.when(known, F.col(c)).alias(c) for c in ("technical", "momentum_12m", "stability")])


#: Bars deeper than this below their peak are to recover; a bar counts once so many more have followed.
DEEP, FOLLOWED = 0.05, 19
BAR = ("high", "low", "close", "mret")
COUNTS = ("n_bars", "deep_bars", "n_common")
MEANS = ("high_close", "_mu", "_sd", "_c", "_v", "mean_bars_to_recover")
RECENT = ("_first", "last_close", "_s50", "_s200", "_slope", "cdar", "adx", "plus_di", "minus_di")
FACTS_SCHEMA = ", ".join(["symbol string", "as_of date", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in (*MEANS, *RECENT)]])
#: Markers whose last 252 bars are looked at together.
TOGETHER = 1024


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of every marker; rows (symbol, _bar, _mark, *BAR) come by symbol, in the order of ``_series``."""
    held, n = [], 0
    for symbol, bar, mark, *values in _each_symbol(batches):
        at = ~bar
        if not at.any():
            continue
        facts, recent = marker_facts(bar, *values)
        held.append((np.full(len(recent), symbol, dtype=object), mark[at], facts, recent))
        n += len(recent)
        if n >= TOGETHER:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _each_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(symbol, *columns)``; the rows of a symbol stand together and may lie in several batches."""
    name, held = None, []
    for batch in batches:
        symbols, *columns = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if not len(symbols):
            continue
        cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1), len(symbols)]
        for a, b in zip(cuts, cuts[1:]):
            if held and symbols[a] != name:
                yield name, *(np.concatenate(x) for x in zip(*held))
                held = []
            name = symbols[a]
            held.append([x[a:b] for x in columns])
    if held:
        yield name, *(np.concatenate(x) for x in zip(*held))


def _batch(held: list[tuple]) -> pa.RecordBatch:
    symbols, marks, facts, recent = ([x[k] for x in held] for k in range(4))
    told = recent_facts(*np.concatenate(recent).transpose(1, 0, 2))
    known = {c: np.concatenate([f[c] for f in facts]) for c in (*COUNTS, *MEANS)}
    told[known["n_bars"] == 0] = np.nan
    numbers = [pa.array(known[c].astype(np.int64)) for c in COUNTS]
    numbers += [pa.array(x, pa.float64(), from_pandas=True) for x in (*(known[c] for c in MEANS), *(told[c].to_numpy() for c in RECENT))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(symbols), pa.string()), pa.array(np.concatenate(marks), pa.date32()), *numbers],
                                      ["symbol", "as_of", *COUNTS, *MEANS, *RECENT])


def marker_facts(bar: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, mret: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``COUNTS`` and ``MEANS`` of each marker in one symbol's series, and the last 252 bars before it as (marker, 3, 252), NaN before the first.

    Everything is a running sum, count or maximum over the bars, read where the marker stands. A value that is missing is NaN.
    """
    upto = np.cumsum(bar)[~bar]                 # so many bars stand before each marker
    high, low, close, mret = (x[bar] for x in (high, low, close, mret))
    n = len(close)
    place = np.arange(n)

    def running(x):
        return np.concatenate(([0], np.cumsum(x)))[upto]
    there = ~np.isnan(close)
    peak = np.fmax.accumulate(close) if n else close
    prior = np.concatenate(([-1], np.maximum.accumulate(np.where(there, place, -1))[:-1])) if n else place
    with np.errstate(invalid="ignore", divide="ignore"):
        before = np.where(prior >= 0, close[prior], np.nan)
        ret = np.where(before != 0, close / before, np.nan) - 1
        dd = np.where(peak != 0, 1 - close / peak, np.nan)
        has, both = ~np.isnan(ret), ~np.isnan(ret + mret)
        r, cr, cm = np.where(has, ret, 0), np.where(both, ret, 0), np.where(both, mret, 0)
        k, s, common, scr, scm = (running(x) for x in (has, r, both, cr, cm))
        mean = s / k
        var = np.maximum((running(r * r) - s * mean) / (k - 1), 0)
        facts = {"n_bars": upto, "deep_bars": running(dd > DEEP), "n_common": common,
                 "high_close": np.concatenate(([np.nan], peak))[upto], "_mu": mean, "_sd": np.where(k > 1, np.sqrt(var), np.nan),
                 "_c": np.where(common > 1, (running(cr * cm) - scr * scm / common) / (common - 1), np.nan),
                 "_v": running(cm * cm) / common - (scm / common) ** 2}
        # a deep bar is back at the next bar that is near the running peak or a new one, and counts from FOLLOWED bars on
        new = np.concatenate(([True], ~(peak[1:] <= peak[:-1]))) if n else there
        back_at = np.flatnonzero(new | (close >= NEAR_PEAK * peak))
        deep = np.flatnonzero(dd > DEEP)
        found = np.searchsorted(back_at, deep, side="right")
        deep, found = deep[found < len(back_at)], found[found < len(back_at)]
        back = back_at[found]
        counts_at = np.maximum(back, deep + FOLLOWED) + 1
        order = np.argsort(counts_at, kind="stable")
        seen = np.searchsorted(counts_at[order], upto, side="right")
        w, wt = (np.concatenate(([0.0], np.cumsum(x[order])))[seen] for x in (dd[deep], dd[deep] * (back - deep)))
        facts["mean_bars_to_recover"] = wt / w
    pad = np.full((3, TRADING_DAYS), np.nan)
    bars = np.concatenate((pad, np.stack((high, low, close))), axis=1)
    return facts, bars[:, upto[:, None] + np.arange(TRADING_DAYS)].transpose(1, 0, 2)


def recent_facts(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> pd.DataFrame:
    """The measures of ``RECENT`` for each row of bars, step by step along the columns and all rows at once; NaN becomes null."""
    there = ~np.isnan(close)
    size = there.sum(axis=1)
    rows = np.arange(len(close))
    out = {"_first": close[rows, TRADING_DAYS - np.maximum(size, 1)], "last_close": close[:, -1]}
    for k in (50, 200):
        out[f"_s{k}"] = np.nansum(close[:, -k:], axis=1) / np.maximum(np.minimum(size, k), 1)
    k = np.minimum(size, HALF_YEAR).astype(float)
    place = np.arange(HALF_YEAR) - (HALF_YEAR - 1) + (k[:, None] - 1) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        out["_slope"] = np.where(k > 1, np.nansum(place * close[:, -HALF_YEAR:], axis=1) / (k * (k * k - 1) / 12), np.nan)
        fall = np.sort(1 - close / np.fmax.accumulate(close, axis=1), axis=1)       # NaN last
        at = np.maximum(size - 1, 0) * 0.95
        lo = np.floor(at).astype(int)
        cut = fall[rows, lo] + (at - lo) * (fall[rows, np.minimum(lo + 1, np.maximum(size - 1, 0))] - fall[rows, lo])
        worst = fall >= cut[:, None]
        out["cdar"] = np.where(worst, fall, 0).sum(axis=1) / worst.sum(axis=1)
        # the recursion of ``true_adx``, from the second of the last half year's bars on
        a, state, steps = 1.0 / n, {x: np.zeros(len(close)) for x in ("tr", "up", "dn", "adx", "plus", "minus")}, np.zeros(len(close), int)
        for j in range(TRADING_DAYS - HALF_YEAR + 1, TRADING_DAYS):
            ok = there[:, j - 1]
            up, down = high[:, j] - high[:, j - 1], low[:, j - 1] - low[:, j]
            moves = {"tr": np.maximum.reduce([high[:, j] - low[:, j], np.abs(high[:, j] - close[:, j - 1]), np.abs(low[:, j] - close[:, j - 1])]),
                     "up": np.where((up > down) & (up > 0), up, 0.0), "dn": np.where((down > up) & (down > 0), down, 0.0)}
            new = {x: np.where(steps == 0, v, a * v + (1 - a) * state[x]) for x, v in moves.items()}
            for side, x in (("plus", "up"), ("minus", "dn")):
                new[side] = np.where(new["tr"] != 0, 100 * new[x] / new["tr"], 0.0)
            both = new["plus"] + new["minus"]
            dx = np.where(both != 0, 100 * np.abs(new["plus"] - new["minus"]) / both, 0.0)
            new["adx"] = np.where(steps == 0, dx, a * dx + (1 - a) * state["adx"])
            state = {x: np.where(ok, new[x], v) for x, v in state.items()}
            steps += ok
    for x, name in (("adx", "adx"), ("plus", "plus_di"), ("minus", "minus_di")):
        out[name] = np.where(steps > 0, state[x], np.nan)
    return pd.DataFrame(out)[list(RECENT)]
