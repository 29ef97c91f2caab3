"""Text reports with masking at the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what hidden figures read.
HIDDEN = "<hidden, SHOW_OOS=0>"
OOS_COLUMNS = ("oos_sharpe", "max_drawdown", "annual_return", "annual_vol", "turnover_annual", "calmar", "median", "min", "oos_median", "oos_min", "num_trades")


def masked(metrics: DataFrame, show: bool) -> DataFrame:
    """All figures as text, those from out of sample hidden unless `show`."""
    cells = [
        (F.lit(HIDDEN) if c in OOS_COLUMNS and not show else F.format_string("%.6f", F.col(c)) if t == "double" else F.col(c).cast("string")).alias(c)
        for c, t in metrics.dtypes if not t.startswith("map")
    ]
    return metrics.select(*cells)


def summary_lines(metrics: DataFrame, show: bool) -> DataFrame:
    """One (metric, value) row for each figure of a one-row frame."""
    m = masked(metrics, show)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in m.columns])
    return m.select(F.inline(pairs))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.select(F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]).alias("line"))


#: Lines of the summary block by name, how many decimals, and whether they stay readable when hidden.
SUMMARY = (
    ("oos_sharpe", 6, False), ("is_sharpe", 6, True), ("max_drawdown", 4, False), ("annual_return", 4, False), ("annual_vol", 4, False), ("turnover_annual", 2, False), ("calmar", 4, False),
    ("num_trades", 0, True), ("median_fold_sharpe", 6, False), ("min_fold_sharpe", 6, False), ("is_fold_median_sharpe", 6, True), ("is_fold_min_sharpe", 6, True), ("oos_fold_median_sharpe", 6, False),
    ("oos_fold_min_sharpe", 6, False), ("status_hint", None, True),
)


def summary(result: DataFrame, show: bool) -> DataFrame:
    """(metric, value) rows of one run's summary block: the interval, years and folds among them; NULL reads nan. Without `show`
    out-of-sample figures and folds are hidden and years left out; trades and the status always show (S24)."""
    def text(c, digits):
        return F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("nan"))

    line = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    fixed = [line(n, F.col(n).cast("string") if d is None else text(n, d) if show or keep else F.lit(HIDDEN)) for n, d, keep in SUMMARY]
    ci = F.concat(F.lit("["), text("oos_sharpe_lo", 6), F.lit(", "), text("oos_sharpe_hi", 6), F.lit("]")) if show else F.lit(HIDDEN)
    entry = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v")))
    shown = lambda e: F.coalesce(F.format_string("%.6f", e["v"]), F.lit("nan")) if show else F.lit(HIDDEN)
    folds = F.transform(entry("fold_sharpes"), lambda e: F.struct(e["k"].alias("metric"), shown(e).alias("value")))
    years = F.transform(entry("yearly_sharpe"), lambda e: F.struct(F.concat(F.lit("oos_sharpe_"), e["k"]).alias("metric"), shown(e).alias("value")))
    lines = [F.array(*fixed, line("oos_sharpe_ci", ci)), folds, *([years] if show else [])]
    return result.select(F.inline(F.concat(*lines)))


def printed_sharpe(lines: DataFrame, column: str = "value") -> DataFrame:
    """`oos_sharpe` as a number from the text of a printed summary; NULL where no line has one."""
    found = F.regexp_extract(F.col(column), r"(?m)^oos_sharpe:\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$", 1)
    return lines.withColumn("oos_sharpe", found.try_cast("double"))
