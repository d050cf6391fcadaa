"""Column helpers shared by all operators. Everything here stays JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Periods per year used for every annualisation.
AF = 252


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def series(keys: Sequence[str] = ("asset",), order: str = "date") -> WindowSpec:
    """One time series per key. (key, date) is unique and dates are days, so a
    partition never holds more rows than there are days in the calendar."""
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str] = ("asset",)) -> WindowSpec:
    return Window.partitionBy(*keys)


def to_date_rows(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def finite(col: Column | str) -> Column:
    """NaN and infinities become NULL."""
    x = c(col)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(col: Column | str, lo, hi) -> Column:
    """Clamp that keeps NULL as NULL (greatest/least skip NULLs)."""
    x = c(col)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(fn, col: Column | str, n: int, w: WindowSpec) -> Column:
    """``fn`` over the last ``n`` rows, NULL until all n are non-null."""
    x, frame = c(col), last_rows(w, n)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded, with -0.0 folded into 0.0."""
    return F.round(c(col), digits) + F.lit(0.0)


def sd(col: Column | str) -> Column:
    return F.stddev_samp(c(col))


def ann_mean(col: Column | str) -> Column:
    return F.avg(c(col)) * AF


def ann_vol(col: Column | str) -> Column:
    return sd(col) * F.sqrt(F.lit(float(AF)))


def sample_skew(col: Column | str) -> Column:
    """Bias-corrected skewness from the population one; NULL below 3 rows."""
    x = c(col)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(col: Column | str) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 rows."""
    x = c(col)
    n = F.count(x).cast("double")
    return F.when(
        n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    )


def quantile(col: Column | str, p: float, approx_accuracy: int | None = None) -> Column:
    """Linear-interpolated quantile. Exact by default: groups are calendar-bounded;
    pass an accuracy for an approximate one over wider groups."""
    x = c(col)
    if approx_accuracy:
        return F.percentile_approx(x, p, approx_accuracy)
    return F.percentile(x, p)


def one_row(df: DataFrame, col: str) -> Column:
    """The single cell of a one-row aggregate, as an uncorrelated scalar subquery."""
    return df.select(col).scalar()


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero or the result is not finite."""
    return finite(F.try_divide(c(a), c(b)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows with both values; NULL for a constant series,
    where the built-in raises under ANSI arithmetic."""
    x, y = c(a), c(b)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)
