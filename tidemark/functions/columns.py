"""Column helpers: missing values, clips, cross-section ranks and rolling frames.

Missing is always NULL: NaN and infinities become NULL where data come in, and
divisions go through ``ratio``, which gives NULL instead of an ANSI error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def clip(x: Column, low: float, high: float) -> Column:
    """Clip to low..high; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def clip01(x: Column) -> Column:
    """Clip to 0..1; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def band(x: Column, low: float, high: float) -> Column:
    """x where low <= x <= high, else NULL."""
    return F.when((x >= low) & (x <= high), x)


def indicator(condition: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it doesn't or is NULL."""
    return F.when(condition, 1.0).otherwise(0.0)


def row_mean(*xs: Column) -> Column:
    """Mean of the non-NULL values, NULL if there is none."""
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    count = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def pct_rank(x: Column, *by: str, descending: bool = False) -> Column:
    """Percentile rank with average ties among the non-NULL values of a group; NULL for NULL.

    Missing values stand last, and a range frame of the same value counts its
    ties, so that all ranks of a group share one shuffle and each needs one sort.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(group))


def series(symbol: str = "symbol", date: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(date)


def rolling(agg: Callable[[Column], Column], x: Column, rows: int, least: int | None = None, over: WindowSpec | None = None, shift: int = 0) -> Column:
    """``agg`` over the last ``rows`` rows, NULL below ``least`` values (default: all); ``shift`` moves the frame back."""
    frame = (over or series()).rowsBetween(-(rows - 1) - shift, -shift)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), agg(x).over(frame))


def change(x: Column, rows: int, over: WindowSpec | None = None) -> Column:
    return ratio(x, F.lag(x, rows).over(over or series())) - 1


def steady_mean(x: Column, scale: int = 12) -> Column:
    """Mean over a decimal sum, the same in whatever order the rows come (values to ``scale`` places)."""
    return F.sum(x.cast(f"decimal(28,{scale})")).cast("double") / F.count(x)
