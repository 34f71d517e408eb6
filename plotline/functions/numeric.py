"""Numeric expressions: ratios, rounding, rates, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["EXACT", "exact_sum", "money_avg", "round_to", "price_per_m2", "safe_ratio", "zero_to_null", "null_to_zero",
           "truncate_int", "round_hundreds", "round_half_up", "pct_change",
           "annual_to_monthly_rate", "trend_direction", "radius_bucket", "uniform_noise"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x, digits: int) -> Column:
    """Round a double to ``digits`` decimals, half away from zero, on its binary value
    (``x * 10^d`` then nearest integer), as browser ``toFixed`` and C ``round`` do.
    Spark's ``round`` instead rounds the shortest decimal text, so 5116.235 (stored as
    5116.23499...) would become 5116.24."""
    scale = float(10 ** digits)
    v = _c(x).cast("double")
    return F.signum(v) * F.floor(F.abs(v) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


#: Exact sums run in this type: 12 decimals and 26 digits before them.  A value beyond
#: raises; none is rounded to cents.
EXACT = "decimal(38,12)"


def exact_sum(x) -> Column:
    """Sum that does not depend on partitioning or summation order, as a double."""
    return F.sum(_c(x).cast(EXACT)).cast("double")


def money_avg(x) -> Column:
    """Mean as an exact sum divided by the count: reruns and other engines agree to the
    last bit."""
    return exact_sum(x) / F.count(_c(x)).cast("double")


def price_per_m2(price, size) -> Column:
    """Chart form: 2 decimals, 0 when the size is missing or not positive."""
    return F.when(_c(size) > 0, round_to(_c(price) / _c(size), 2)).otherwise(F.lit(0.0))


def safe_ratio(a, b) -> Column:
    """a / b with NULL for a zero or NULL divisor (pandas gives inf, then NaN)."""
    return F.try_divide(_c(a).cast("double"), F.nullif(_c(b).cast("double"), F.lit(0.0)))


def zero_to_null(x) -> Column:
    return F.nullif(_c(x), F.lit(0))


def null_to_zero(x) -> Column:
    return F.coalesce(_c(x), F.lit(0)).cast("int")


def truncate_int(x) -> Column:
    """float -> integer toward zero (``astype(int)``)."""
    return _c(x).cast("bigint")


def round_hundreds(x) -> Column:
    """Round to a multiple of 100, ties to even (Python ``round(x, -2)``)."""
    return F.bround(_c(x), -2).cast("bigint")


def round_half_up(x) -> Column:
    return F.floor(_c(x) + F.lit(0.5))


def pct_change(old, new) -> Column:
    return F.try_divide(_c(new) - _c(old), _c(old)) * F.lit(100.0)


def annual_to_monthly_rate(r) -> Column:
    return F.pow(F.lit(1.0) + _c(r), F.lit(1.0 / 12.0))


def trend_direction(pct, band: float = 0.5) -> Column:
    return (F.when(_c(pct) > band, F.lit("up"))
            .when(_c(pct) < -band, F.lit("down")).otherwise(F.lit("neutral")))


def radius_bucket(n, steps: Sequence[tuple[int, int]], default: int, scale: int) -> Column:
    out = None
    for bound, units in steps:
        out = (F.when(_c(n) <= bound, F.lit(units * scale)) if out is None
               else out.when(_c(n) <= bound, F.lit(units * scale)))
    return out.otherwise(F.lit(default * scale))


def uniform_noise(seed: int, *keys, spread: float = 0.015) -> Column:
    """Factor in [1-spread, 1+spread) from a hash of the seed and the row's keys: it does
    not change with the partition layout or a rerun."""
    unit = F.pmod(F.xxhash64(F.lit(seed), *[_c(k) for k in keys]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.lit(1.0) + (unit - F.lit(0.5)) * F.lit(2 * spread)
