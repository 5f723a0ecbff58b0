"""Rolling windows with full-frame guards, recursive averages and islands.

All of them order one symbol's rows by date. The tables they run on are unique on
``(symbol, d)`` (the adapters aggregate to that grain first), so a window group never
holds more rows than there are calendar days, however many raw rows a symbol has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("d",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def full_frame(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """``agg`` over the trailing ``n`` rows, null until ``n`` values are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return full_frame(F.avg, x, n, w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    return full_frame(F.stddev_samp, x, n, w)


def rolling_std_pop(x: Column, n: int, w: WindowSpec) -> Column:
    return full_frame(F.stddev_pop, x, n, w)


def _doubled(most: int) -> list[int]:
    """Powers of two up to ``most``."""
    return [1 << k for k in range(most.bit_length())]


def _cut_frame(n: int) -> list[tuple[int, int]]:
    """Trailing frames whose lengths are powers of two and that make up one of ``n`` rows: their lengths and the rows that lie after them."""
    out, after = [], 0
    for size in reversed(_doubled(n)):
        if n & size:
            out.append((size, after))
            after += size
    return out


def trailing_means(df: DataFrame, x: str, names: dict[int, str], w: WindowSpec) -> DataFrame:
    """Mean of ``x`` over the trailing ``n`` rows for each ``n`` of ``names``, null until ``n`` values are present.

    Whether they are follows from one running count, so a sliding frame holds the mean alone.
    """
    st = df.withColumn("_seen", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = {n: F.col("_seen") - F.lag("_seen", n, 0).over(w) == n for n in names}
    return st.withColumns({out: F.when(whole[n], F.avg(x).over(w.rowsBetween(-(n - 1), 0))) for n, out in names.items()}).drop("_seen")


def trailing_moments(df: DataFrame, x: str, n: int, w: WindowSpec, mean: str, squares: str) -> DataFrame:
    """Mean of ``x`` over the trailing ``n`` rows and the sum of squares about it, null until ``n`` values are present.

    A sliding frame goes over all its rows again at each row. Here the moments of 2 k rows are those of k rows merged with the ones k rows
    before, so a row costs as many steps as the frame has binary digits. Parts are merged by the difference of their means, which is
    0 in a constant series.
    """
    def merged(a: Column, b: Column, na: int, nb: int) -> Column:
        off = b["m"] - a["m"]
        return F.struct((a["m"] + off * (nb / (na + nb))).alias("m"), (a["q"] + b["q"] + off * off * (na * nb / (na + nb))).alias("q"))
    st = df.withColumn("_f1", F.struct(F.col(x).cast("double").alias("m"), (F.col(x).cast("double") * 0).alias("q")))
    powers = _doubled(n)
    for k in powers[:-1]:
        st = st.withColumn("_b", F.lag(f"_f{k}", k).over(w)).withColumn(f"_f{2 * k}", merged(F.col(f"_f{k}"), F.col("_b"), k, k))
    (size, _), *rest = _cut_frame(n)
    st = st.select("*", F.col(f"_f{size}").alias("_a"), *[F.lag(f"_f{k}", after).over(w).alias(f"_b{k}") for k, after in rest])
    for k, _ in rest:
        st = st.withColumn("_a", merged(F.col("_a"), F.col(f"_b{k}"), size, k))
        size += k
    return st.withColumns({mean: F.col("_a.m"), squares: F.col("_a.q")}).drop("_a", "_b", *[f"_f{k}" for k in powers], *[f"_b{k}" for k, _ in rest])


def pct_change(x: Column, k: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def simple_return(x: Column, w: WindowSpec) -> Column:
    return pct_change(x, 1, w)


def ema(df: DataFrame, specs: dict[str, tuple[str, float]], keys: Sequence[str] = ("symbol",),
        order: Sequence[str] = ("d",), keep_row_number: str | None = None) -> DataFrame:
    """Exponential averages ``e0 = x0; e = a*x + (1-a)*e`` as plain windows.

    ``specs`` maps an output name to ``(input column, alpha)``. The recursion has the
    closed form ``e_i = sum_j w_j x_j (1-a)^(i-j)``. A symbol's rows are cut into blocks
    of B rows with ``(1-a)^B = 1e-20``: inside a block the sum is a running sum of
    ``x_j (1-a)^(-j)`` scaled back, and only the previous block's last value can still
    matter at double precision. No array is collected and no Python runs.
    Inputs must not be null after a symbol's first row; leading nulls are skipped by
    filtering before the call.
    """
    keys = list(keys)
    size = max(max(2, math.ceil(46.0 / -math.log(1.0 - a))) for _, a in specs.values())
    steepest = max(a for _, a in specs.values())
    if len(specs) > 1 and size * -math.log10(1.0 - steepest) > 280:
        # one block length for all would overflow the steepest average: do it on its own
        first = {n: s for n, s in specs.items() if s[1] == steepest}
        rest = {n: s for n, s in specs.items() if s[1] != steepest}
        return ema(ema(df, first, keys, order), rest, keys, order)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_blk", F.floor(F.col("_i") / size)).withColumn("_pos", F.col("_i") % size)
    inner = Window.partitionBy(*keys, "_blk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rangeBetween(-1, -1)
    pos = F.col("_pos")
    local, final = [], []
    for name, (x, a) in specs.items():
        q = F.lit(1.0 - a)
        weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(a))
        local.append((F.sum(weight * F.col(x) * F.pow(q, -pos)).over(inner) * F.pow(q, pos)
                      ).alias(f"_l_{name}"))
        carry = F.max(F.when(pos == size - 1, F.col(f"_l_{name}"))).over(before)
        final.append((F.col(f"_l_{name}") + F.coalesce(carry, F.lit(0.0)) * F.pow(q, pos + 1)
                      ).alias(name))
    out = out.select("*", *local).select("*", *final)
    if keep_row_number:
        out = out.withColumn(keep_row_number, F.col("_i"))
    return out.drop("_i", "_blk", "_pos", *[f"_l_{n}" for n in specs])


def decayed_mean(df: DataFrame, x: str, at: str, alpha: float, out: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Weighted mean of the values so far, with weights ``(1 - alpha) ** distance``; null values have none, yet distance runs on.

    ``at`` is a whole-number position, unique in a key. Positions are cut into blocks of B with ``(1 - alpha) ** B = 1e-20``: sums of
    numerator and denominator run inside a block, rescaled to its start, and the block before is added as its last sums left it. At a
    row with a value the denominator is 1 at least, so what lies further back is below double precision. Rows without a value
    keep the mean of the last one: both sums decay alike.
    """
    q = F.lit(1.0 - alpha)
    size = max(2, math.ceil(46.0 / -math.log(1.0 - alpha)))
    keys = list(keys)
    out_rows = df.withColumns({"_blk": F.floor(F.col(at) / size), "_pos": F.pmod(F.col(at), F.lit(size)).cast("double")})
    own = F.col(x).isNotNull()
    inner = Window.partitionBy(*keys, "_blk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    grow = F.when(own, F.pow(q, -F.col("_pos")))
    out_rows = out_rows.withColumns({"_num": F.sum(grow * F.col(x)).over(inner), "_den": F.sum(grow).over(inner)})
    # the sums of a block are scaled to its first position; a block earlier that is B positions
    before = Window.partitionBy(*keys).orderBy("_blk").rangeBetween(-1, -1)
    last = F.max_by(F.struct("_num", "_den"), at).over(before)
    carried = F.pow(q, F.lit(float(size)))
    out_rows = out_rows.withColumn("_last", last)
    num = F.col("_num") + F.coalesce(F.col("_last._num"), F.lit(0.0)) * carried
    den = F.col("_den") + F.coalesce(F.col("_last._den"), F.lit(0.0)) * carried
    run = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out_rows = out_rows.withColumn("_mean", F.when(own, num / den))
    return out_rows.withColumn(out, F.last("_mean", ignorenulls=True).over(run)).drop("_blk", "_pos", "_num", "_den", "_last", "_mean")


def span_alpha(n: float) -> float:
    return 2.0 / (n + 1.0)


def island_id(changed: Column, w: WindowSpec) -> Column:
    """Running number of the run of rows that ``changed`` starts."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(
        w.rowsBetween(Window.unboundedPreceding, 0))


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",),
              order: str = "d", name: str = "rn") -> DataFrame:
    """The last ``n`` rows per key; Spark prunes each map task's rows to ``n`` first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
