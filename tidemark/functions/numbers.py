"""Numeric helpers: guarded division, clamps, summary statistics and the quantile rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def stat8(x: Column, prefix: str, where: Column | None = None, finite: bool = False) -> list[Column]:
    """Mean, population deviation, quartiles, p90, max and min; 0 for an empty group.

    NaN never counts; with finite, nor do infinities. Quantiles interpolate linearly.
    """
    x = x.cast("double")
    ok = ~F.isnan(x)
    if finite:
        ok = ok & (F.abs(x) < F.lit(float("inf")))
    if where is not None:
        ok = ok & where
    x = F.when(ok, x)
    named = {
        "mean": F.avg(x), "std": F.stddev_pop(x), "p25": F.percentile(x, F.lit(0.25)), "p50": F.percentile(x, F.lit(0.5)),
        "p75": F.percentile(x, F.lit(0.75)), "p90": F.percentile(x, F.lit(0.9)), "max": F.max(x), "min": F.min(x),
    }
    return [F.coalesce(v, F.lit(0.0)).alias(f"{prefix}_{k}") for k, v in named.items()]


def stat5(x: Column, prefix: str) -> list[Column]:
    """Mean, population deviation, median, p90 and max of stat8."""
    keep = ("mean", "std", "p50", "p90", "max")
    return [c for c, k in zip(stat8(x, prefix), ("mean", "std", "p25", "p50", "p75", "p90", "max", "min")) if k in keep]


def quantile_at(sorted_values: Column, q: float, rule: str) -> Column:
    """A quantile of a sorted array by the 'higher' or 'lower' element of its place."""
    place = (F.size(sorted_values) - 1) * F.lit(float(q))
    at = F.ceil(F.round(place, 9)) if rule == "higher" else F.floor(F.round(place, 9))
    return F.get(sorted_values, at.cast("int"))
