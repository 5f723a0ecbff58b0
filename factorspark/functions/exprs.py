"""Column builders shared by every operator: clip, ramps, weighted means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Num = float | int | Column


def as_col(x: Num | str) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x: Column, lo: Num, hi: Num) -> Column:
    """Bound ``x``; null stays null (``least``/``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_col(lo)), as_col(hi)))


def finite(x: Column) -> Column:
    """``x`` when it is an ordinary number, else null (also for NaN and infinities)."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` when ``den > 0``, else null."""
    return F.when(den > 0, F.try_divide(num, den))


def guarded_ratio(num: Column, den: Column) -> Column:
    """Ratio that also treats a zero numerator as missing (a vendor's placeholder)."""
    return F.when((num != 0) & (den > 0), F.try_divide(num, den))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def ramp(value: Column, threshold: Num, excellent: Num, higher_better: bool) -> Column:
    """0..1 score that starts at half (or 1.5 times) the threshold and is 1 at ``excellent``.

    A null value or a null threshold gives null, so the metric drops out of any
    weighted mean built on top.
    """
    v, thr, exc = finite(value), as_col(threshold), as_col(excellent)
    if higher_better:
        poor = thr / 2
        return clip(F.try_divide(v - poor, exc - poor), 0, 1)
    poor = thr * 1.5
    return clip(F.try_divide(poor - v, poor - exc), 0, 1)


def piecewise_linear(x: Column, xs: Sequence[float], ys: Sequence[float],
                     null_value: float | None = None) -> Column:
    """Linear interpolation through ``(xs, ys)``, flat outside the range."""
    pts = list(zip(xs, ys))
    out = F.when(x <= pts[0][0], F.lit(float(pts[0][1])))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) / float(x1 - x0) * float(y1 - y0))
    out = out.when(x > pts[-1][0], F.lit(float(pts[-1][1])))
    return out if null_value is None else F.coalesce(out, F.lit(float(null_value)))


def weighted_mean(parts: Sequence[tuple[Column, Num]], empty: float | None = None) -> Column:
    """Mean of the non-null scores with weights renormalised over those present."""
    num = reduce(lambda a, b: a + b,
                 [F.coalesce(s * as_col(w), F.lit(0.0)) for s, w in parts])
    den = reduce(lambda a, b: a + b,
                 [F.when(s.isNotNull(), as_col(w)).otherwise(F.lit(0.0)) for s, w in parts])
    out = F.when(den > 0, F.try_divide(num, den))
    return out if empty is None else F.coalesce(out, F.lit(float(empty)))


def add_weighted_means(df: DataFrame, specs: dict[str, list[tuple[Column, Num]]],
                       empty: float = 0.0) -> DataFrame:
    """Weighted means as new columns, the single scores staged in their own projection.

    Each score is read twice (value and presence); staging keeps the generated code small.
    """
    temps, outs = {}, {}
    for name, parts in specs.items():
        cols = [f"_s_{name}_{i}" for i in range(len(parts))]
        temps.update(dict(zip(cols, [p[0] for p in parts])))
        outs[name] = weighted_mean([(F.col(c), p[1]) for c, p in zip(cols, parts)], empty)
    return df.withColumns(temps).withColumns(outs).drop(*temps)


def step_score(x: Column, steps: Sequence[tuple[float, float]], default: float,
               inclusive: bool = True) -> Column:
    """First step whose bound ``x`` reaches, from the highest bound down."""
    out = None
    for bound, value in steps:
        test = x >= bound if inclusive else x > bound
        out = F.when(test, F.lit(float(value))) if out is None else out.when(test, F.lit(float(value)))
    return out.otherwise(F.lit(float(default)))


def tanh01(x: Column) -> Column:
    return (F.tanh(x) + 1) / 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_max(x: Column, lo: Column, hi: Column, constant: float) -> Column:
    """(x-lo)/(hi-lo), or ``constant`` when the range is empty."""
    return F.when(hi > lo, F.try_divide(x - lo, hi - lo)).when(
        x.isNotNull(), F.lit(float(constant)))


def rounded(cols: dict[str, Column | str], digits: int = 6) -> list[Column]:
    """Named, rounded output columns."""
    return [F.round(as_col(c) if not isinstance(c, str) else F.col(c), digits).alias(n)
            for n, c in cols.items()]


def r6(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def day_text(name: str = "d") -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd").alias(name)
