"""Backtests of very many overlapping portfolios: co-moments of the universe by tiles, cut out for each portfolio.

Portfolios of a grid share most of their names. The second moments and rank correlations of a look-back window are therefore
computed once for each pair of tiles (TILE names each) and block of sessions, and each portfolio gets its own part of them. Equal
baskets are one. Daily returns come from the tiles as well, as sums of weight times return for each tile. A group holds two tiles
over ``CHUNK + lookback`` sessions and at most some PART baskets, so none grows with the universe, the history or the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.allocation import weights_of_moments
from factorspark.operators.cleaning import calendar_of, fill_forward
from factorspark.session import checkpointed, shared

TILE, CHUNK, PART = 128, 252, 256


@dataclass(frozen=True)
class Schedule:
    """Look-back windows of ``lookbacks`` sessions that end before session ``start`` and every ``every`` sessions from ``start + 2 every`` on."""

    start: int
    every: int = 21
    lookbacks: tuple[int, ...] = (252, 504, 756)
    chunk: int = CHUNK          # sessions of a group

    def ends(self, chunk: int, last: int) -> list[int]:
        lo, hi = chunk * self.chunk, min((chunk + 1) * self.chunk, last + 1)
        return [t for t in range(lo, hi) if t == self.start or (t >= self.start + 2 * self.every and (t - self.start) % self.every == 0)]

    def chunks(self, last: int) -> list[int]:
        return [c for c in range(self.start // self.chunk, last // self.chunk + 1) if self.ends(c, last)]


@dataclass(frozen=True)
class Universe:
    """Returns ``(tile, pos, symbol, i, ret)`` of all names on one calendar (``days(i, d)``), and how many tiles and sessions there are."""

    returns: DataFrame
    names: DataFrame
    days: DataFrame
    tiles: int
    last: int
    width: int = TILE           # names of a tile


def baskets_of(members: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(basket, names)`` with sorted names, and ``(*keys, basket)``: portfolios of the same names are one basket."""
    named = members.groupBy(*keys).agg(F.array_sort(F.collect_set("symbol")).alias("names"))
    named = checkpointed(named.withColumn("basket", F.sha2(F.concat_ws("\n", "names"), 256)))
    return named.select("basket", "names").dropDuplicates(["basket"]), named.select(*keys, "basket")


def universe(closes: DataFrame, baskets: DataFrame, width: int = TILE) -> Universe:
    """Prices of all names of the baskets, carried forward on their common calendar; a name has none before its first.

    The names are numbered by one window over the distinct symbols of the baskets, which are bounded by the pools they were taken from.
    """
    symbols = baskets.select(F.explode("names").alias("symbol")).distinct()
    number = F.row_number().over(Window.orderBy("symbol")) - 1
    names = shared(symbols.select("symbol", number.alias("_n")).select(
        "symbol", F.floor(F.col("_n") / width).cast("int").alias("tile"), (F.col("_n") % width).cast("int").alias("pos")))
    own = closes.join(names.select("symbol"), "symbol")
    days = shared(calendar_of(own).select("d", (F.col("session") - 1).cast("int").alias("i")))
    filled = fill_forward(own, "close", None).join(days, "d").join(names, "symbol")
    w = Window.partitionBy("symbol").orderBy("i")
    returns = shared(filled.select("tile", "pos", "symbol", "i", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")))
    size = names.agg(F.max("tile")).first()[0]
    return Universe(returns, names, days, 0 if size is None else size + 1, days.agg(F.coalesce(F.max("i"), F.lit(-1))).first()[0], width)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each column, ties at their mean."""
    order = x.argsort(axis=0, kind="stable")
    s = np.take_along_axis(x, order, axis=0)
    at = np.arange(len(x))[:, None]
    new = np.ones(x.shape, bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    ends = np.ones(x.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, at, len(x) - 1)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return out


def _matrix(rows: pd.DataFrame, lo: int, hi: int, width: int) -> np.ndarray:
    out = np.full((hi - lo, width), np.nan)
    out[rows["i"].to_numpy() - lo, rows["pos"].to_numpy()] = rows["ret"].to_numpy(float)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Columns of length 1; columns of zeros stay."""
    size = np.sqrt((x ** 2).sum(axis=0))
    return x / np.where(size > 0, size, 1.0)


def window_moments(a: np.ndarray, b: np.ndarray, ranks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariances (divided by n), correlations and fourth moments between the columns of two windows; NaN where a name lacks a return."""
    ca, cb = a - a.mean(axis=0), b - b.mean(axis=0)
    if ranks:
        ra, rb = average_ranks(a), average_ranks(b)
        corr = _unit(ra - ra.mean(axis=0)).T @ _unit(rb - rb.mean(axis=0))
    else:
        corr = np.nan_to_num(_unit(ca).T @ _unit(cb))
    return ca.T @ cb / len(a), corr, (ca ** 2).T @ (cb ** 2)


def _by_tile(u: Universe, reach: int, chunks: Sequence[int], parts: int, size: int) -> DataFrame:
    """Return rows once for each chunk whose windows can reach back to them, and each part of the baskets."""
    chunk = F.explode(F.sequence(*[F.floor((F.col("i") + more) / size).cast("int") for more in (0, reach)]))
    rows = u.returns.select("tile", "pos", "i", "ret", chunk.alias("chunk")).where(F.col("chunk").isin(list(chunks)))
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _pairs_of(u: Universe, baskets: DataFrame, parts: int) -> DataFrame:
    """For each pair of tiles that a basket touches: where its names stand in the basket and in the tiles."""
    at = baskets.select("basket", F.posexplode("names").alias("j", "symbol")).join(u.names, "symbol")
    held = at.groupBy("basket", "tile").agg(F.array_sort(F.collect_list(F.struct("j", "pos"))).alias("at"))
    both = held.select("basket", F.col("tile").alias("ta"), F.col("at").alias("at_a")).join(
        held.select("basket", F.col("tile").alias("tb"), F.col("at").alias("at_b")), "basket").where("ta <= tb")
    return both.select("basket", "ta", "tb", "at_a.j", "at_a.pos", F.col("at_b.j").alias("j2"), F.col("at_b.pos").alias("pos2"),
                       F.pmod(F.xxhash64("basket"), F.lit(parts)).cast("int").alias("part"))


def _parts(baskets: DataFrame) -> int:
    return max(1, -(-baskets.count() // PART))


CUT = "basket string, chunk int, lookback int, ends array<int>, j array<int>, j2 array<int>, cov binary, corr binary, fourth array<double>"


def basket_moments(u: Universe, baskets: DataFrame, schedule: Schedule, ranks: bool = True) -> DataFrame:
    """Each basket's part of the co-moments of each pair of tiles, all windows of a chunk in one row.

    Moments are computed once for all baskets of a part that touch the pair of tiles.
    """
    chunks, parts, last, width = schedule.chunks(u.last), _parts(baskets), u.last, u.width
    reach = max(schedule.lookbacks)
    wanted = _pairs_of(u, baskets, parts).withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in chunks]))) if chunks else _pairs_of(
        u, baskets, parts).withColumn("chunk", F.lit(0)).limit(0)
    rows = _by_tile(u, reach, chunks, parts, schedule.chunk)
    other = F.explode(F.sequence(F.lit(0), F.lit(max(u.tiles - 1, 0))))
    rows = rows.withColumn("other", other).select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"),
                                                  "chunk", "part", "tile", "pos", "i", "ret")

    def cut(key: tuple, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(found):
            ta, tb, chunk = int(key[0]), int(key[1]), int(key[2])
            lo, hi = chunk * schedule.chunk - reach, (chunk + 1) * schedule.chunk
            a = _matrix(found[found["tile"] == ta], lo, hi, width)
            b = a if ta == tb else _matrix(found[found["tile"] == tb], lo, hi, width)
            ends = schedule.ends(chunk, last)
            for lookback in schedule.lookbacks:
                # the first of a window's prices has no return inside it
                spans = [(t, slice(t - lookback + 1 - lo, t - lo)) for t in ends if t >= lookback]
                if not spans:
                    continue
                cov, corr, fourth = (np.stack(m) for m in zip(*(window_moments(a[s], b[s], ranks) for _, s in spans)))
                for basket, j, pos, j2, pos2 in asked[["basket", "j", "pos", "j2", "pos2"]].itertuples(index=False):
                    at = (slice(None), np.asarray(pos)[:, None], np.asarray(pos2)[None, :])
                    out.append((basket, chunk, lookback, [t for t, _ in spans], list(j), list(j2), cov[at].tobytes(), corr[at].tobytes(),
                                fourth[at].sum(axis=(1, 2)).tolist()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])
    key = ["ta", "tb", "chunk", "part"]
    return rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(cut, CUT)


SOLVED = "basket string, lookback int, i int, w array<double>"


def solve(moments: DataFrame, method: str = "mhrp") -> DataFrame:
    """Weights ``(basket, lookback, i, w)`` in the order of the basket's names, for windows in which every name has all its returns."""
    def run(key: tuple, cuts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lookback, same in cuts.groupby("lookback"):
            ends = list(same["ends"].iloc[0])
            n = 1 + max(max(j) for j in same["j2"])
            n = max(n, 1 + max(max(j) for j in same["j"]))
            cov, corr, fourth = np.zeros((len(ends), n, n)), np.zeros((len(ends), n, n)), np.zeros(len(ends))
            for j, j2, s, r, f in same[["j", "j2", "cov", "corr", "fourth"]].itertuples(index=False):
                shape, j, j2 = (len(ends), len(j), len(j2)), np.asarray(j), np.asarray(j2)
                s, r = (np.frombuffer(x).reshape(shape) for x in (s, r))
                cov[:, j[:, None], j2], corr[:, j[:, None], j2] = s, r
                if not np.array_equal(j, j2):       # two tiles: both halves of the symmetric matrix
                    cov[:, j2[:, None], j], corr[:, j2[:, None], j] = s.transpose(0, 2, 1), r.transpose(0, 2, 1)
                    fourth += np.asarray(f)
                fourth += np.asarray(f)
            for k, t in enumerate(ends):
                if np.isfinite(cov[k]).all():
                    out.append((key[0], int(lookback), int(t), weights_of_moments(cov[k], corr[k], fourth[k], int(lookback) - 1, method).tolist()))
        return pd.DataFrame(out, columns=["basket", "lookback", "i", "w"])
    return moments.groupBy("basket", "chunk").applyInPandas(run, SOLVED)


def accept_drift(candidates: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Of each basket's candidate weights in order those that move a name by more than ``threshold``; the first is accepted."""
    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        kept, current = [], None
        found = found.sort_values("i")
        for k, w in enumerate(found["w"]):
            w = np.asarray(w)
            if current is None or np.abs(w - current).max() > threshold:
                kept.append(k)
                current = w
        return found.iloc[kept]
    return candidates.groupBy("basket", "lookback").applyInPandas(run, SOLVED)


def daily_returns(u: Universe, baskets: DataFrame, weights: DataFrame, start: int, fee: float = 0.001, size: int = CHUNK) -> DataFrame:
    """``(basket, lookback, d, i, ret, rebalanced, value)`` from ``start`` (or the first session all names have a price, if later) on.

    ``weights(basket, lookback, i, w)`` hold from session i on, that day's return included; equal weights before the first. A session
    with new weights costs ``fee``. The first day has return 0.
    """
    parts, last, width = _parts(baskets), u.last, u.width
    place = baskets.select("basket", F.posexplode("names").alias("j", "symbol")).join(u.names, "symbol")
    begin = place.join(u.returns.groupBy("symbol").agg(F.min("i").alias("_first")), "symbol").groupBy("basket").agg(
        F.greatest(F.max("_first"), F.lit(start)).alias("begin"))
    turns = weights.groupBy("basket", "lookback").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("turns"))
    spans = turns.join(begin, "basket").join(
        place.groupBy("basket", "tile").agg(F.array_sort(F.collect_list(F.struct("j", "pos"))).alias("at")), "basket").join(
        baskets.select("basket", F.size("names").alias("held")), "basket")
    chunks = range(start // size, last // size + 1)
    asked = spans.select("basket", "lookback", "begin", "turns.i", "turns.w", "tile", "at.j", "at.pos", "held",
                         F.pmod(F.xxhash64("basket"), F.lit(parts)).cast("int").alias("part"),
                         F.explode(F.array(*[F.lit(c) for c in chunks]) if chunks else F.array().cast("array<int>")).alias("chunk"))
    rows = _by_tile(u, 0, list(chunks), parts, size)

    def partial(key: tuple, found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(wanted):
            lo, hi = int(key[1]) * size, (int(key[1]) + 1) * size
            x = np.nan_to_num(_matrix(found, lo, hi, width))
            days = np.arange(lo, hi)
            for basket, lookback, i, w, j, pos, n in wanted[["basket", "lookback", "i", "w", "j", "pos", "held"]].itertuples(index=False):
                table = np.vstack([np.full(n, 1.0 / n), *[np.asarray(v) for v in w]])[:, np.asarray(j)]
                held = table[np.searchsorted(np.asarray(i), days, side="right")]
                out.append((basket, int(lookback), lo, (held * x[:, np.asarray(pos)]).sum(axis=1).tolist()))
        return pd.DataFrame(out, columns=["basket", "lookback", "lo", "part_ret"])
    sums = rows.groupBy("tile", "chunk", "part").cogroup(asked.groupBy("tile", "chunk", "part")).applyInPandas(
        partial, "basket string, lookback int, lo int, part_ret array<double>")
    whole = sums.groupBy("basket", "lookback").agg(F.collect_list(F.struct("lo", "part_ret")).alias("parts"))
    marked = whole.join(turns.select("basket", "lookback", "turns.i"), ["basket", "lookback"]).join(begin, "basket")

    def series(frames):
        for frame in frames:
            for basket, lookback, pieces, turns_at, first in frame[["basket", "lookback", "parts", "i", "begin"]].itertuples(index=False):
                total = np.zeros((last // size + 1) * size)
                for piece in pieces:
                    total[piece["lo"]:piece["lo"] + size] += np.asarray(piece["part_ret"])
                days = np.arange(first, last + 1)
                if not len(days):
                    continue
                new = np.isin(days, np.asarray(turns_at))
                ret = np.where(days > first, total[first:last + 1] - fee * new, 0.0)
                yield pd.DataFrame({"basket": basket, "lookback": lookback, "i": days.astype(np.int32), "ret": ret, "rebalanced": new,
                                    "value": np.cumprod(1 + ret)})
    return marked.mapInPandas(series, "basket string, lookback int, i int, ret double, rebalanced boolean, value double").join(u.days, "i")


def grid_backtest(closes: DataFrame, members: DataFrame, keys: Sequence[str], schedule: Schedule, method: str = "mhrp",
                  threshold: float = 0.05, fee: float = 0.001, width: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Drift-rebalanced daily series of every basket and look-back, and ``(*keys, basket)``."""
    baskets, portfolios = baskets_of(members, keys)
    baskets = shared(baskets)
    u = universe(closes, baskets, width)
    accepted = shared(accept_drift(solve(basket_moments(u, baskets, schedule, method != "hrp"), method), threshold))
    return daily_returns(u, baskets, accepted, schedule.start, fee, schedule.chunk), portfolios


def latest_moments(u: Universe, lookbacks: Sequence[int]) -> DataFrame:
    """``(lookback, a, b, cov, spearman)`` of every pair of names a <= b over the window that ends with the last session, by pairs of tiles."""
    reach, last, width = max(lookbacks), u.last, u.width
    rows = u.returns.where(F.col("i") > last - reach)
    other = F.explode(F.sequence(F.lit(0), F.lit(max(u.tiles - 1, 0))))
    rows = rows.withColumn("other", other).select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "pos", "symbol", "i", "ret")

    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        lo, hi = last - reach + 1, last + 1
        names = []
        for t in key:
            listed = found[found["tile"] == t].drop_duplicates("pos").sort_values("pos")
            names.append((listed["pos"].to_numpy(), listed["symbol"].to_numpy()))
        a, b = (_matrix(found[found["tile"] == t], lo, hi, width)[:, p] for t, (p, _) in zip(key, names))
        out = []
        for n in lookbacks:
            cov, corr, _ = window_moments(a[-n + 1:], b[-n + 1:], True)
            ia, ib = np.nonzero(np.isfinite(cov))
            keep = names[0][1][ia] <= names[1][1][ib]
            ia, ib = ia[keep], ib[keep]
            out.append(pd.DataFrame({"lookback": n, "a": names[0][1][ia], "b": names[1][1][ib], "cov": cov[ia, ib] * (n - 1) / (n - 2),
                                     "spearman": np.where(names[0][1][ia] == names[1][1][ib], 1.0, corr[ia, ib])}))
        return pd.concat(out, ignore_index=True)
    return rows.groupBy("ta", "tb").applyInPandas(run, "lookback int, a string, b string, cov double, spearman double")
