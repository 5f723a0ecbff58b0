"""Weights for many portfolios and dates at once.

Spark builds the complete price panel, cuts it into blocks of rows and distributes the blocks
by (portfolio, look-back, block). Inside a task a block is a small dates x holdings matrix, on
which numpy does the covariance, clustering and bisection. A block holds at most
``BLOCK + lookback`` dates, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.operators.cleaning import complete_dates, fill_forward
from factorspark.session import shared

BLOCK = 252


def price_panel(closes: DataFrame, members: DataFrame, lookbacks: tuple[int, ...] = (252,), limit: int = 2) -> DataFrame:
    """``(portfolio, lookback, d, i, symbol, px)``: filled prices on complete dates, dates numbered from 0."""
    closes = shared(closes)            # symbols x days, read for the calendar and for the fill
    filled = fill_forward(closes, "close", limit).select("symbol", "d", F.col("close").alias("px"))
    full = complete_dates(filled.join(members.select("portfolio", "symbol"), "symbol"))
    w = Window.partitionBy("portfolio").orderBy("d")
    days = full.select("portfolio", "d").distinct().withColumn("i", F.row_number().over(w) - 1)
    st = full.join(days, ["portfolio", "d"])
    return st.withColumn("lookback", F.explode(F.array(*[F.lit(n) for n in lookbacks])))


# ---- small matrix helpers, run inside tasks ------------------------------------------

def shrunk_cov(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk to a scaled identity (Ledoit and Wolf 2004)."""
    x = x - x.mean(axis=0)
    return shrink(x.T @ x / len(x), float(((x ** 2).T @ (x ** 2)).sum()), len(x))


def shrink(s: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """The shrunk form of a covariance ``s`` of n rows; ``fourth`` sums the products of squares over all pairs and rows."""
    p = len(s)
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min((fourth / n - (s ** 2).sum()) / n, d2)
    rho = 0.0 if d2 <= 0 or b2 <= 0 else b2 / d2
    return (1 - rho) * s + rho * mu * np.eye(p)


def correlation(x: np.ndarray, ranks: bool) -> np.ndarray:
    """Pearson or Spearman correlation; undefined entries count as 0."""
    if ranks:
        x = pd.DataFrame(x).rank().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.atleast_2d(np.corrcoef(x, rowvar=False)))
    np.fill_diagonal(c, 1.0)
    return c


def ward_tree(corr: np.ndarray) -> list[tuple[int, int]]:
    """Ward merges on sqrt((1-corr)/2); each pair lists the smaller cluster number first.

    A chain of nearest neighbours grows until two are nearest to each other; these are merged and the distances to the new cluster follow
    from the old ones. Every step costs a row of the matrix, the tree n^2. Sorted by height, the merges are those of always joining the
    closest pair.
    """
    n = len(corr)
    far = np.inf
    dist2 = np.clip(0.5 * (1 - corr), 0, 1).astype(float)
    np.fill_diagonal(dist2, far)
    size, height = np.ones(n), np.zeros(n)
    slot = list(range(n))                           # a row of the matrix -> its cluster
    found: list[tuple[float, int, int]] = []        # (height, cluster, cluster); merge k makes cluster n + k
    alive = np.ones(n, bool)
    chain: list[int] = []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        x = chain[-1]
        y = int(np.argmin(dist2[x]))
        if len(chain) > 1 and dist2[x, chain[-2]] <= dist2[x, y]:
            y = chain[-2]
        if len(chain) < 2 or y != chain[-2]:
            chain.append(y)
            continue
        del chain[-2:]
        a, b = min(x, y), max(x, y)
        gap = dist2[a, b]
        height[a] = max(gap, height[a], height[b])
        found.append((height[a], slot[a], slot[b]))
        total = size[a] + size[b] + size
        row = ((size[a] + size) * dist2[a] + (size[b] + size) * dist2[b] - size * gap) / total
        alive[b] = False
        row[~alive] = far
        row[a] = far
        dist2[a], dist2[:, a] = row, row
        dist2[b], dist2[:, b] = far, far
        size[a] += size[b]
        slot[a] = n + len(found) - 1
    order = sorted(range(n - 1), key=lambda k: found[k][0])
    number = {k: k for k in range(n)} | {n + k: n + at for at, k in enumerate(order)}
    return [tuple(sorted((number[found[k][1]], number[found[k][2]]))) for k in order]


def leaf_order(merges: list[tuple[int, int]]) -> list[int]:
    n = len(merges) + 1
    members = {k: [k] for k in range(n)}
    for new, (a, b) in enumerate(merges, start=n):
        members[new] = members[a] + members[b]
    return members[2 * n - 2]


def bisect_weights(order: list[int], risk: Callable[[list[int]], float]) -> np.ndarray:
    """Split the ordered names in halves; each half's share falls with its own risk."""
    w = np.ones(len(order))
    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[:len(part) // 2], part[len(part) // 2:]
        rl, rr = risk(left), risk(right)
        share = rr / (rl + rr) if rl + rr > 0 else 0.5
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    return w


def _pinv_variance(cov: np.ndarray) -> Callable[[list[int]], float]:
    def risk(ix):
        sub = cov[np.ix_(ix, ix)]
        w = np.linalg.pinv(sub).sum(axis=1)
        w = w / w.sum()
        return float(w @ sub @ w)
    return risk


def _inverse_vol_risk(cov: np.ndarray) -> Callable[[list[int]], float]:
    vol = np.sqrt(np.diag(cov))

    def risk(ix):
        w = 1 / vol[ix]
        w = w / w.sum()
        return float(np.sqrt(w @ cov[np.ix_(ix, ix)] @ w))
    return risk


def long_only_min_variance(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Fixed-iteration projected gradient on the simplex."""
    n = len(cov)
    w = np.full(n, 1.0 / n)
    rate = 1.0 / max(np.linalg.eigvalsh(cov)[-1] * 2, 1e-12)
    for _ in range(steps):
        v = w - rate * 2 * cov @ w
        u = np.sort(v)[::-1]
        css = np.cumsum(u) - 1
        k = np.nonzero(u - css / np.arange(1, n + 1) > 0)[0][-1]
        w = np.maximum(v - css[k] / (k + 1), 0)
    return w


def solve_weights(x: np.ndarray, method: str) -> np.ndarray:
    """Weights of the columns of a returns matrix; constant columns get 0.

    ``hrp``: Pearson distance and pseudo-inverse cluster variance. ``mhrp``: Spearman distance
    and inverse-volatility clusters; ``mhrp_vol`` multiplies by inverse volatility at the end.
    ``nco``: at most five clusters, minimum variance inside, inverse variance across.
    """
    if len(x) < 2:
        return np.full(x.shape[1], 1.0 / x.shape[1])
    c = x - x.mean(axis=0)
    return weights_of_moments(c.T @ c / len(x), correlation(x, ranks=method != "hrp"), float(((c ** 2).T @ (c ** 2)).sum()), len(x), method)


def weights_of_moments(s: np.ndarray, corr: np.ndarray, fourth: float, n: int, method: str) -> np.ndarray:
    """The weights from the moments of n rows: covariance (divided by n), correlation that the method asks for, and sum of fourth moments."""
    out = np.zeros(len(s))
    keep = np.nonzero(np.sqrt(np.diag(s) * n / max(n - 1, 1)) > 1e-10)[0]
    if len(keep) < 2:
        if len(keep) == 1:
            out[keep] = 1.0
        return out
    cov = shrink(s[np.ix_(keep, keep)], fourth, n)
    corr = corr[np.ix_(keep, keep)].copy()
    np.fill_diagonal(corr, 1.0)
    merges = ward_tree(corr)
    if method == "nco":
        w = _cluster_weights(cov, merges)
    else:
        order = leaf_order(merges)
        risk = _pinv_variance(cov) if method == "hrp" else _inverse_vol_risk(cov)
        w = bisect_weights(order, risk)
        if method == "mhrp_vol":
            w = w / np.sqrt(np.diag(cov))
    out[keep] = w / w.sum()
    return out


def _cluster_weights(cov: np.ndarray, merges: list[tuple[int, int]]) -> np.ndarray:
    n = len(cov)
    clusters = {k: [k] for k in range(n)}
    for new, (a, b) in enumerate(merges, start=n):
        if len(clusters) <= max(1, min(5, n // 2)):
            break
        clusters[new] = clusters.pop(a) + clusters.pop(b)
    w = np.zeros(n)
    for ix in clusters.values():
        sub = cov[np.ix_(ix, ix)]
        inner = long_only_min_variance(sub)
        w[ix] = inner / (inner @ sub @ inner + 1e-8)
    return w


def posterior_cov(cov: np.ndarray, viewed: list[int], tau: float = 0.05) -> np.ndarray:
    """Covariance after absolute views on some names (view variance tau * their variance)."""
    p = np.eye(len(cov))[viewed]
    ts = tau * cov @ p.T
    a = p @ ts
    a = a + np.diag(np.diag(a))
    return cov + tau * cov - ts @ np.linalg.solve(a, ts.T)


# ---- distribution ---------------------------------------------------------------------

KEYS = ["portfolio", "lookback"]
WEIGHTS_SCHEMA = "portfolio string, lookback int, d date, symbol string, w double"


def weights_at(panel: DataFrame, solves: DataFrame, method: str = "mhrp") -> DataFrame:
    """Weights for each solve ``(portfolio, lookback, d, w0, w1)`` from panel rows w0 <= i < w1.

    A window ends in one block; every panel row is sent to the blocks whose windows can
    reach back to it (two copies at a look-back of 252).
    """
    blocks = panel.withColumn("blk", F.explode(F.sequence(
        F.floor(F.col("i") / BLOCK), F.floor((F.col("i") + F.col("lookback") - 1) / BLOCK))))
    rows = blocks.select("portfolio", "lookback", "blk", "i", "symbol", "px")
    # fresh column names: both sides come from the same panel
    todo = solves.select(F.col("portfolio").alias("job_portfolio"), F.col("lookback").alias("job_lookback"),
                         F.floor((F.col("w1") - 1) / BLOCK).alias("job_blk"), F.col("d").alias("job_d"),
                         F.col("w0").alias("job_w0"), F.col("w1").alias("job_w1"))

    def run(key: tuple, prices: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        if prices.empty or jobs.empty:
            return pd.DataFrame(columns=["portfolio", "lookback", "d", "symbol", "w"])
        wide = prices.pivot(index="i", columns="symbol", values="px").sort_index()
        first = int(wide.index[0])
        values = wide.to_numpy()
        parts = []
        for d, w0, w1 in jobs.sort_values("job_d")[["job_d", "job_w0", "job_w1"]].itertuples(index=False):
            px = values[max(w0 - first, 0):w1 - first]
            ret = px[1:] / px[:-1] - 1
            parts.append(pd.DataFrame({"portfolio": key[0], "lookback": key[1], "d": d,
                                       "symbol": wide.columns, "w": solve_weights(ret, method)}))
        return pd.concat(parts, ignore_index=True)
    return rows.groupBy(*KEYS, "blk").cogroup(todo.groupBy("job_portfolio", "job_lookback", "job_blk")).applyInPandas(
        run, WEIGHTS_SCHEMA)


def trailing_solves(panel: DataFrame, when: Column, min_share: float = 0.5) -> DataFrame:
    """A solve on the look-back rows before each date that ``when`` selects.

    Dates with fewer than ``min_share`` of the look-back before them are skipped.
    """
    days = panel.select("portfolio", "lookback", "d", "i").distinct().where(when)
    w0 = F.greatest(F.col("i") - F.col("lookback"), F.lit(0))
    return days.withColumn("w1", F.col("i")).withColumn("w0", w0).where(
        F.col("w1") - F.col("w0") >= F.floor(F.col("lookback") * min_share)).where(F.col("w1") > 1)


CROSS = "portfolio string, a string, b string, n bigint, s double, q double, f double"


def covariance_long(returns: DataFrame) -> DataFrame:
    """Sample covariance, both correlations and the shrunk covariance for each pair a <= b.

    ``returns(portfolio, d, symbol, ret)``, complete dates. Returns and their ranks are centred for each symbol
    first; then cross products are summed inside blocks of dates and the sums of the blocks are added for each pair,
    so a long history is spread over many tasks. A portfolio of one name, or constant columns, give
    correlations of 0 off and 1 on the diagonal.
    """
    own = Window.partitionBy("portfolio", "symbol")
    rank = F.rank().over(own.orderBy("ret")) + (F.count(F.lit(1)).over(Window.partitionBy("portfolio", "symbol", "ret")) - 1) / 2
    days = returns.select("portfolio", "d").distinct().withColumn(
        "blk", F.floor((F.row_number().over(Window.partitionBy("portfolio").orderBy("d")) - 1) / BLOCK))
    rows = returns.select("portfolio", "d", "symbol", (F.col("ret") - F.avg("ret").over(own)).alias("x"),
                          (rank - (F.count(F.lit(1)).over(own) + 1) / 2).alias("q")).join(days, ["portfolio", "d"])

    def cross(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="d", columns="symbol", values="x")
        q = pdf.pivot(index="d", columns="symbol", values="q").to_numpy()
        names, x = list(x.columns), x.to_numpy()
        ia, ib = np.triu_indices(len(names))
        return pd.DataFrame({"portfolio": key[0], "a": [names[k] for k in ia], "b": [names[k] for k in ib], "n": len(x),
                             "s": (x.T @ x)[ia, ib], "q": (q.T @ q)[ia, ib], "f": ((x ** 2).T @ (x ** 2))[ia, ib]})
    sums = shared(rows.groupBy("portfolio", "blk").applyInPandas(cross, CROSS).groupBy("portfolio", "a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "q", "f")]))
    diagonal = sums.where("a = b").select("portfolio", F.col("a").alias("_name"), F.col("s").alias("_s"), F.col("q").alias("_q"))

    def side(name: str) -> DataFrame:
        return diagonal.select("portfolio", F.col("_name").alias(name), F.col("_s").alias(f"_s{name}"), F.col("_q").alias(f"_q{name}"))
    # Ledoit and Wolf's intensity needs sums over both halves of the matrix
    same = F.col("a") == F.col("b")
    twice = F.when(same, 1.0).otherwise(2.0)
    per_day = F.col("s") / F.col("n")
    whole = sums.groupBy("portfolio").agg(
        (F.sum(F.when(same, per_day)) / F.count_if(same)).alias("_mu"), F.count_if(same).alias("_p"), F.sum(twice * per_day ** 2).alias("_sq"),
        (F.sum(twice * (F.col("f") / F.col("n") - per_day ** 2) / F.col("n"))).alias("_b2"))
    d2 = F.col("_sq") - F.col("_p") * F.col("_mu") ** 2
    rho = F.when((d2 <= 0) | (F.col("_b2") <= 0), 0.0).otherwise(F.least("_b2", d2) / d2)

    def ratio(c: str) -> Column:
        scale = F.sqrt(F.col(f"_{c}a") * F.col(f"_{c}b"))
        return F.when(same, 1.0).when(scale > 0, F.col(c) / scale).otherwise(0.0)
    return sums.join(side("a"), ["portfolio", "a"]).join(side("b"), ["portfolio", "b"]).join(whole, "portfolio").select(
        "portfolio", "a", "b", F.try_divide("s", F.col("n") - 1).alias("cov"), ratio("s").alias("corr"), ratio("q").alias("spearman"),
        ((1 - rho) * per_day + F.when(same, rho * F.col("_mu")).otherwise(0.0)).alias("shrunk"))


def posterior_covariance(cov: DataFrame, views: DataFrame, tau: float = 0.05) -> DataFrame:
    """Adjust long shrunk covariances ``(portfolio, a, b, shrunk)`` for names that carry a view."""
    def run(key: tuple, pairs: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pairs["a"]) | set(pairs["b"]))
        at = {s: k for k, s in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        ia, ib = pairs["a"].map(at).to_numpy(), pairs["b"].map(at).to_numpy()
        m[ia, ib] = m[ib, ia] = pairs["shrunk"].to_numpy()
        viewed = sorted(at[s] for s in set(seen["symbol"]) if s in at)
        post = posterior_cov(m, viewed, tau) if viewed else m
        return pd.DataFrame({"portfolio": key[0], "a": pairs["a"], "b": pairs["b"], "cov": post[ia, ib]})
    return cov.select("portfolio", "a", "b", "shrunk").groupBy("portfolio").cogroup(
        views.select("portfolio", "symbol").groupBy("portfolio")).applyInPandas(
        run, "portfolio string, a string, b string, cov double")


def average_correlation(returns: DataFrame, window: int = 60) -> DataFrame:
    """Mean off-diagonal rolling correlation per date and its rolling deviation.

    Dates are cut into blocks that overlap by the window, so a long history is spread over
    many tasks and no pair of symbols is ever shuffled.
    """
    w = Window.partitionBy("portfolio").orderBy("d")
    days = returns.select("portfolio", "d").distinct().withColumn("i", F.row_number().over(w) - 1)
    rows = returns.join(days, ["portfolio", "d"]).withColumn("blk", F.explode(F.sequence(
        F.floor(F.col("i") / BLOCK), F.floor((F.col("i") + window - 1) / BLOCK))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="i", columns="symbol", values="ret").sort_index()
        idx = wide.index.to_numpy()
        x = wide.to_numpy()
        n = x.shape[1]
        if len(x) < window or n < 2:
            return pd.DataFrame(columns=["portfolio", "i", "avg_corr"])
        view = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)
        z = view - view.mean(axis=2, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = z / np.sqrt((z ** 2).sum(axis=2, keepdims=True))
        total = (z.sum(axis=1) ** 2).sum(axis=1)   # sum of all correlations incl. the diagonal
        avg = (total - n) / (n * (n - 1))
        end = idx[window - 1:]
        own = end // BLOCK == key[1]
        return pd.DataFrame({"portfolio": key[0], "i": end[own], "avg_corr": avg[own]})
    per = rows.select("portfolio", "blk", "i", "symbol", "ret").groupBy("portfolio", "blk").applyInPandas(
        run, "portfolio string, i int, avg_corr double")
    per = per.join(days, ["portfolio", "i"])
    half = w.rowsBetween(-(window // 2 - 1), 0)
    return per.withColumn("corr_stability", F.when(F.count("avg_corr").over(half) == window // 2,
                                                   F.stddev_samp("avg_corr").over(half)))


def correlation_spectrum(returns: DataFrame, window: int = 60, tile: int = 512) -> DataFrame:
    """Eigenvalues and explained variance of the correlation matrix over each portfolio's latest ``window`` dates.

    With Z the standardised returns (dates x names), Z'Z and ZZ' have the same eigenvalues but for zeros. ZZ' is dates x dates however many
    names there are, and a sum over names: tiles of names give their part of it, the parts are added, and one small matrix a portfolio is
    left. A constant name correlates with nothing and is an eigenvalue of 1 by itself. One row for each name.
    """
    w = Window.partitionBy("portfolio").orderBy(F.desc("d"))
    days = returns.select("portfolio", "d").distinct().withColumn("t", F.row_number().over(w) - 1).where(F.col("t") < window)
    own = Window.partitionBy("portfolio", "symbol")
    rows = returns.join(days, ["portfolio", "d"]).select("portfolio", "symbol", "t", (F.col("ret") - F.avg("ret").over(own)).alias("x"))
    rows = shared(rows.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(own))))
    names = rows.groupBy("portfolio", "symbol").agg(F.max("norm").alias("norm"))
    sizes = names.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm") <= 1e-12).alias("constant"))
    tiles = sizes.agg(F.coalesce(F.ceil(F.max("n") / tile), F.lit(1))).first()[0]

    def gram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.pivot(index="t", columns="symbol", values="z")
        g = z.to_numpy() @ z.to_numpy().T
        t = z.index.to_numpy()
        return pd.DataFrame({"portfolio": key[0], "s": np.repeat(t, len(t)), "t": np.tile(t, len(t)), "g": g.ravel()})
    z = rows.where("norm > 1e-12").select("portfolio", "symbol", "t", (F.col("x") / F.col("norm")).alias("z"),
                                          F.pmod(F.xxhash64("symbol"), F.lit(tiles)).alias("tile"))
    whole = z.groupBy("portfolio", "tile").applyInPandas(gram, "portfolio string, s int, t int, g double").groupBy("portfolio", "s", "t").agg(F.sum("g").alias("g"))

    def solve(key: tuple, pdf: pd.DataFrame, size: pd.DataFrame) -> pd.DataFrame:
        n, constant = int(size["n"].iloc[0]), int(size["constant"].iloc[0])
        ev = np.empty(0)
        if len(pdf):
            ev = np.maximum(np.linalg.eigvalsh(pdf.pivot(index="s", columns="t", values="g").to_numpy()), 0)
        ev = np.sort(np.concatenate([ev, np.ones(constant)]))[::-1][:n]
        return pd.DataFrame({"portfolio": key[0], "component": np.arange(1, len(ev) + 1), "eigenvalue": ev, "names": n})
    found = whole.groupBy("portfolio").cogroup(sizes.groupBy("portfolio")).applyInPandas(solve, "portfolio string, component int, eigenvalue double, names int")
    # behind the last component of a window that is shorter than the list of names there are zeros
    last = found.groupBy("portfolio", "names").agg(F.max("component").alias("k")).where("k < names")
    zeros = last.select("portfolio", F.explode(F.sequence(F.col("k") + 1, F.col("names"))).alias("component"), F.lit(0.0).alias("eigenvalue"), "names")
    return found.unionByName(zeros).select("portfolio", "component", "eigenvalue", (F.col("eigenvalue") / F.col("names")).alias("explained"))


def weight_metrics(weights: DataFrame, returns: DataFrame, cov: DataFrame) -> DataFrame:
    """Annual return and risk of fixed weights, concentration and effective number of names.

    ``cov`` is long with each pair once (a <= b).
    """
    wt = weights.select("portfolio", "symbol", "w")
    pr = returns.join(wt, ["portfolio", "symbol"]).groupBy("portfolio", "d").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    ret = pr.groupBy("portfolio").agg((F.avg("r") * 252).alias("annual_return"))
    a = wt.select("portfolio", F.col("symbol").alias("a"), F.col("w").alias("wa"))
    b = wt.select("portfolio", F.col("symbol").alias("b"), F.col("w").alias("wb"))
    term = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("wa") * F.col("wb") * F.col("cov")
    var = cov.join(a, ["portfolio", "a"]).join(b, ["portfolio", "b"]).groupBy("portfolio").agg(F.sum(term).alias("_v"))
    con = wt.groupBy("portfolio").agg(
        F.max("w").alias("max_weight"), F.coalesce(F.min(F.when(F.col("w") > 1e-6, F.col("w"))), F.lit(0.0)).alias("min_weight"),
        F.sum(F.col("w") * F.col("w")).alias("herfindahl"))
    st = ret.join(var, "portfolio").join(con, "portfolio")
    vol = F.sqrt(F.col("_v") * 252)
    return st.withColumn("annual_volatility", vol).withColumn(
        "sharpe", F.when(vol > 0, F.col("annual_return") / vol).otherwise(0.0)).withColumn(
        "effective_n", F.when(F.col("herfindahl") > 0, 1 / F.col("herfindahl")).otherwise(1.0)).drop("_v")


def rebalance_suggestions(holdings: DataFrame, prices: DataFrame, target: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Current weights from shares and last prices, and trades where they are off by the threshold."""
    last = prices.groupBy("symbol").agg(F.max_by("close", "d").alias("price"))
    st = holdings.join(last, "symbol", "left").withColumn("_v", F.col("shares") * F.coalesce("price", F.lit(100.0)))
    total = st.groupBy("portfolio").agg(F.sum("_v").alias("_t"), F.count(F.lit(1)).alias("_n"))
    st = st.join(total, "portfolio").withColumn("current_weight", F.when(
        F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(1.0 / F.col("_n")))
    j = target.select("portfolio", "symbol", F.col("w").alias("target_weight")).join(
        st.select("portfolio", "symbol", "current_weight"), ["portfolio", "symbol"], "left")
    j = j.withColumn("current_weight", F.coalesce("current_weight", F.lit(0.0))).withColumn(
        "difference", F.col("target_weight") - F.col("current_weight"))
    off = F.abs("difference") > threshold
    return j.withColumn("action", F.when(off & (F.col("difference") > 0), "Buy").when(off, "Sell").otherwise("Keep"))
