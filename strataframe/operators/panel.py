"""Operators on long panels (date, ticker, fields): time windows by ticker, cross sections by date.

Every function takes extra keys `by` (a strategy, a draw), so that many runs are one plan. Missing is NULL inside; NaN is
turned into NULL at the boundary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def along(by: Keys = ()) -> WindowSpec:
    return Window.partitionBy(*by, "ticker").orderBy("date")


def across(by: Keys = ()) -> WindowSpec:
    return Window.partitionBy(*by, "date")


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clean(column: str) -> Column:
    """NaN and infinities as NULL."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def densify(panel: DataFrame, by: Keys = ()) -> DataFrame:
    """Every ticker on every date (J2): row offsets count calendar days, not a ticker's own rows.

    The universe is one array by key, as small as the list of tickers, beside each date. Without keys it is one row.
    """
    universe = panel.groupBy(*by).agg(F.collect_set("ticker").alias("__tickers"))
    dates = panel.select(*by, "date").distinct()
    grid = dates.join(universe, list(by)) if by else dates.crossJoin(F.broadcast(universe))
    grid = grid.select(*by, "date", F.explode("__tickers").alias("ticker"))
    return grid.join(panel, [*by, "date", "ticker"], "left")


def pad(column: str, by: Keys = ()) -> Column:
    """Carry the last value forward."""
    return F.last(column, ignorenulls=True).over(so_far(along(by)))


def change(column: str, days: int = 1, by: Keys = ()) -> Column:
    """Relative change over calendar rows of a padded column (W4); NULL for a zero base."""
    return F.try_divide(F.col(column), F.lag(column, days).over(along(by))) - 1


def rolling(function, column: str, days: int, by: Keys = (), least: int | None = None) -> Column:
    """`function` over the last `days` rows, NULL with fewer than `least` values (default: all of them)."""
    w = along(by).rowsBetween(1 - days, 0)
    return F.when(F.count(column).over(w) >= (days if least is None else least), function(F.col(column)).over(w))


def rank_average(column: str, by: Keys = (), percent: bool = True) -> Column:
    """Rank within the date, ties at their average, NULL for NULL; as a share of the values if `percent`."""
    w = across(by).orderBy(F.col(column).asc_nulls_last())
    upto = F.count(column).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = (F.rank().over(w) + upto) / 2.0
    return F.when(F.col(column).isNotNull(), rank / F.count(column).over(across(by)) if percent else rank)


def normalise(column: str, gross: float = 1.0, by: Keys = ()) -> Column:
    """Share of the date's total, times `gross`; 0 if the total is 0."""
    return F.coalesce(F.try_divide(F.col(column), F.sum(column).over(across(by))), F.lit(0.0)) * gross


def with_returns(panel: DataFrame, days: Sequence[int] = (1,), by: Keys = (), padded: bool = True) -> DataFrame:
    """Dense panel with `c` (close, padded or not) and `ret<n>`."""
    dense = densify(panel, by).withColumn("close", clean("close"))
    dense = dense.withColumn("c", pad("close", by) if padded else F.col("close"))
    return dense.withColumns({f"ret{n}": change("c", n, by) for n in days})


def friday_label(date: Column) -> Column:
    """The Friday that ends the week of `date`."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def weekly_last(weights: DataFrame, value: str = "w", by: Keys = ()) -> DataFrame:
    """Targets of each week's last value, held from its Friday until the next; an empty week reads 0."""
    last = weights.groupBy(*by, "ticker", friday_label(F.col("date")).alias("__label")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias("__v"))
    seen = weights.withColumn("__label", F.date_sub(F.next_day("date", "FRI"), 7))
    return seen.drop(value).join(last, [*by, "ticker", "__label"], "left").withColumn(value, F.coalesce("__v", F.lit(0.0))).drop("__label", "__v")


def period_last(weights: DataFrame, label: Column, visible: Column, value: str = "w", by: Keys = ()) -> DataFrame:
    """As weekly_last for any cadence: `label` names a row's period, `visible` the last complete one."""
    last = weights.groupBy(*by, "ticker", label.alias("__label")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias("__v"))
    return weights.withColumn("__label", visible).drop(value).join(last, [*by, "ticker", "__label"], "left").withColumn(value, F.coalesce("__v", F.lit(0.0))).drop("__label", "__v")


def membership(panel: DataFrame, additions: DataFrame | None = None, removals: DataFrame | None = None, by: Keys = ()) -> DataFrame:
    """Add `active`: on or after the first value, not before any addition, not after any removal."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy(*by, "ticker"))
    out, active = panel.withColumn("__first", first), F.coalesce(F.col("date") >= F.col("__first"), F.lit(False))
    if additions is not None:
        out = out.join(F.broadcast(additions.where("date is not null").groupBy("ticker").agg(F.max("date").alias("__added"))), "ticker", "left")
        active = active & F.coalesce(F.col("date") >= F.col("__added"), F.lit(True))
    if removals is not None:
        out = out.join(F.broadcast(removals.where("date is not null").groupBy("ticker").agg(F.min("date").alias("__removed"))), "ticker", "left")
        active = active & F.coalesce(F.col("date") <= F.col("__removed"), F.lit(True))
    return out.withColumn("active", active).drop("__first", "__added", "__removed")


def universe_asof(panel: DataFrame, date: str) -> DataFrame:
    """Tickers with a first value on or before `date`."""
    first = panel.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("first_valid"))
    return first.where(F.col("first_valid") <= F.lit(date).cast("date"))
