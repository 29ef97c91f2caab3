"""Signals: panel in, target weights (date, ticker, w) out. Weights of a date use that date's data and earlier only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import Keys, across, along, densify, normalise, period_last, rank_average, rolling, weekly_last, with_returns


def inverse(column: str) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), F.col(column)), F.lit(0.0))


def sized(df: DataFrame, chosen: Column, size: Column, gross: float, by: Keys = ()) -> DataFrame:
    """Weights in proportion to `size` under the mask, with gross exposure `gross`; NULL in the mask is not chosen."""
    out = df.withColumn("w", F.when(chosen, size).otherwise(0.0)).withColumn("w", normalise("w", gross, by))
    return out.select(*by, "date", "ticker", "w")


def quad_reversal(
    panel: DataFrame, threshold: float = 0.1, gross: float = 0.5, weekly: bool = True, by: Keys = (), short: int = 21, long: int = 63, vol_days: int = 63, size_days: int = 63
) -> DataFrame:
    """Losers by the mean rank of `short`- and `long`-day returns, raw and over `vol_days` volatility; sized by the inverse of
    `size_days` volatility (G1)."""
    p = with_returns(panel, (1, short, long), by).withColumn("vol", rolling(F.stddev_samp, "ret1", vol_days, by))
    p = p.withColumn("size_vol", F.col("vol") if size_days == vol_days else rolling(F.stddev_samp, "ret1", size_days, by))
    p = p.withColumns({"raw_short": F.col(f"ret{short}"), "raw_long": F.col(f"ret{long}"), "adj_short": F.try_divide(f"ret{short}", "vol"), "adj_long": F.try_divide(f"ret{long}", "vol")})
    names = ["raw_short", "raw_long", "adj_short", "adj_long"]
    p = p.withColumns({f"r_{n}": rank_average(n, by) for n in names})
    p = p.withColumn("mean_rank", sum((F.col(f"r_{n}") for n in names[1:]), F.col("r_raw_short")) / 4.0).withColumn("composite", rank_average("mean_rank", by))
    w = sized(p, F.col("composite") <= threshold, inverse("size_vol"), gross, by)
    return weekly_last(w, by=by) if weekly else w


def bottom_k_reversal(panel: DataFrame, k: int = 14, gross: float = 0.35, weekly: bool = True, by: Keys = ()) -> DataFrame:
    """The k names with the lowest mean rank of 5-, 21-, 63- and 126-day returns; ties by ticker."""
    days = (5, 21, 63, 126)
    p = with_returns(panel, (1, *days), by).withColumn("vol", rolling(F.stddev_samp, "ret1", 21, by))
    p = p.withColumns({f"r{n}": rank_average(f"ret{n}", by, percent=False) for n in days})
    p = p.withColumn("mean_rank", (F.col("r5") + F.col("r21") + F.col("r63") + F.col("r126")) / 4.0)
    place = F.row_number().over(across(by).orderBy(F.col("mean_rank").asc_nulls_last(), "ticker"))
    w = sized(p.withColumn("place", place), (F.col("place") <= k) & F.col("mean_rank").isNotNull(), inverse("vol"), gross, by)
    return weekly_last(w, by=by) if weekly else w


def oracle_sign(panel: DataFrame, by: Keys = ()) -> DataFrame:
    """The sign of the same day's return; a look-ahead probe only."""
    p = with_returns(panel, (1,), by).withColumn("s", F.coalesce(F.signum("ret1"), F.lit(0.0)))
    total = F.sum(F.abs("s")).over(across(by))
    return p.select(*by, "date", "ticker", F.coalesce(F.try_divide(F.col("s"), total), F.lit(0.0)).alias("w"))


def momentum(panel: DataFrame, look: int = 252, skip: int = 21, top: float = 0.1, gross: float = 1.0, monthly: bool = True, by: Keys = ()) -> DataFrame:
    """Return from `look` to `skip` days ago; the top share, equally sized, by month end."""
    p = with_returns(panel, (1,), by)
    p = p.withColumn("m", F.try_divide(F.lag("c", skip).over(along(by)), F.lag("c", look).over(along(by))) - 1).withColumn("rank", rank_average("m", by))
    w = sized(p, F.col("rank") > 1 - top, F.lit(1.0), gross, by)
    if not monthly:
        return w
    month = F.trunc("date", "month")
    return period_last(w, month, F.add_months(month, -1), by=by)


def low_volatility(panel: DataFrame, share: float = 0.2, days: int = 63, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """The least volatile share, inverse-volatility sized."""
    p = with_returns(panel, (1,), by).withColumn("vol", rolling(F.stddev_samp, "ret1", days, by)).withColumn("rank", rank_average("vol", by))
    return sized(p, F.col("rank") <= share, inverse("vol"), gross, by)


def long_short(panel: DataFrame, days: int = 63, tail: float = 0.1, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Long the top and short the bottom tail by return, half of `gross` each."""
    p = with_returns(panel, (1, days), by).withColumn("rank", rank_average(f"ret{days}", by))
    p = p.withColumns({"up": F.when(F.col("rank") > 1 - tail, 1.0).otherwise(0.0), "down": F.when(F.col("rank") <= tail, 1.0).otherwise(0.0)})
    return p.select(*by, "date", "ticker", (normalise("up", gross / 2, by) - normalise("down", gross / 2, by)).alias("w"))


def residual_reversal(panel: DataFrame, days: int = 21, share: float = 0.1, gross: float = 0.5, by: Keys = ()) -> DataFrame:
    """Losers by the return in excess of the date's mean."""
    p = with_returns(panel, (1, days), by).withColumn("excess", F.col(f"ret{days}") - F.avg(f"ret{days}").over(across(by))).withColumn("rank", rank_average("excess", by))
    return sized(p, F.col("rank") <= share, F.lit(1.0), gross, by)


def soft_tilt(panel: DataFrame, days: int = 63, power: float = 2.0, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Weights by a power of the loser rank."""
    p = with_returns(panel, (1, days), by).withColumn("rank", rank_average(f"ret{days}", by))
    return sized(p, F.col("rank").isNotNull(), F.pow(1 - F.col("rank"), F.lit(power)), gross, by)


def liquid(panel: DataFrame, days: int = 20, share: float = 0.25, by: Keys = ()) -> DataFrame:
    """Names in the top share by mean dollar volume, equally sized."""
    p = densify(panel, by).withColumn("dv", F.col("close") * F.col("volume")).withColumn("adv", rolling(F.avg, "dv", days, by, least=1)).withColumn("rank", rank_average("adv", by))
    return sized(p, F.col("rank") > 1 - share, F.lit(1.0), 1.0, by)


def capped(weights: DataFrame, cap: float) -> DataFrame:
    """No name above `cap`, long or short; what is cut is not dealt out."""
    return weights.withColumn("w", F.greatest(F.least("w", F.lit(cap)), F.lit(-cap)))


def gated(weights: DataFrame, gate: DataFrame, scale: float = 0.0) -> DataFrame:
    """Weights times 1 where the date's `open` is true, else `scale`; dates without a gate stay open."""
    return weights.join(F.broadcast(gate.select("date", "open")), "date", "left").withColumn("w", F.col("w") * F.when(F.coalesce("open", F.lit(True)), 1.0).otherwise(scale)).drop("open")


def market_trend_gate(market: DataFrame, days: int = 200) -> DataFrame:
    """Open while the market is at or above its mean of `days` days."""
    w = Window.orderBy("date").rowsBetween(1 - days, 0)
    return market.withColumn("ma", F.when(F.count("mkt").over(w) >= days, F.avg("mkt").over(w))).withColumn("open", F.coalesce(F.col("mkt") >= F.col("ma"), F.lit(True)))


def beta(panel: DataFrame, market: DataFrame, days: int = 63, by: Keys = ()) -> DataFrame:
    """Rolling slope of each name's return on the market's."""
    m = market.withColumn("mret", F.try_divide("mkt", F.lag("mkt").over(Window.orderBy("date"))) - 1).select("date", "mret")
    p = with_returns(panel, (1,), by).join(F.broadcast(m), "date", "left")
    both = F.when(F.col("ret1").isNotNull() & F.col("mret").isNotNull(), 1)
    w = along(by).rowsBetween(1 - days, 0)
    return p.withColumn("beta", F.when(F.count(both).over(w) >= days, F.regr_slope("ret1", "mret").over(w)))


def ohlc_measures(panel: DataFrame, by: Keys = ()) -> DataFrame:
    """Overnight and intraday returns, range, Parkinson and Garman-Klass variances."""
    p = densify(panel, by)
    hl, co = F.ln(F.try_divide("high", "low")), F.ln(F.try_divide("close", "open"))
    return p.withColumns({
        "overnight": F.try_divide("open", F.lag("close").over(along(by))) - 1, "intraday": F.try_divide("close", "open") - 1, "day_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "parkinson": hl * hl / F.lit(4 * 0.6931471805599453), "garman_klass": 0.5 * hl * hl - F.lit(2 * 0.6931471805599453 - 1) * co * co,
    })


def trend_measures(panel: DataFrame, days: int = 200, by: Keys = ()) -> DataFrame:
    """Mean, high, low, distance from the high, %K, efficiency ratio and skewness over rolling windows."""
    p = with_returns(panel, (1,), by)
    w = along(by).rowsBetween(1 - days, 0)
    p = p.withColumns({"ma": rolling(F.avg, "c", days, by), "hi": F.max("c").over(w), "lo": F.min("c").over(w), "step": F.abs(F.col("c") - F.lag("c").over(along(by)))})
    return p.withColumns({
        "from_high": F.try_divide("c", "hi") - 1, "percent_k": F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")),
        "efficiency": F.try_divide(F.abs(F.col("c") - F.lag("c", days - 1).over(along(by))), F.sum("step").over(along(by).rowsBetween(2 - days, 0))),
        "skew": rolling(F.skewness, "ret1", days, by), "above_ma": F.col("c") > F.col("ma"),
    })


def zscore(column: str, by: Keys = ()) -> Column:
    """Distance from the date's mean in standard deviations."""
    w = across(by)
    return F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))


def smoothed(weights: DataFrame, halflife: float = 3.0, by: Keys = ()) -> DataFrame:
    """Exponentially weighted mean of each name's weights, exact (W19); one name's history is one group."""
    schema = weights.select(*by, "ticker", "date", "w").schema

    def ewm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(w=pdf["w"].ewm(halflife=halflife).mean())

    return weights.select(*by, "ticker", "date", "w").groupBy(*by, "ticker").applyInPandas(ewm, schema)


def throttled(weights: DataFrame, limit: float = 0.4, by: Keys = ()) -> DataFrame:
    """Trade to the target only when it is further than `limit` in L1 from what is held (G15); a path, so one strategy is
    one group, read in date order."""
    schema = weights.select(*by, "ticker", "date", "w").schema

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="ticker", values="w").fillna(0.0).sort_index()
        held, rows = None, []
        for target in wide.to_numpy():
            if held is None or abs(target - held).sum() > limit:
                held = target
            rows.append(held)
        out = pd.DataFrame(rows, index=wide.index, columns=wide.columns).rename_axis(index="date", columns="ticker").stack().rename("w").reset_index()
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[[*by, "ticker", "date", "w"]]

    keys = list(by) or ["__all"]
    rows = weights.select(*by, "ticker", "date", "w")
    return (rows if by else rows.withColumn("__all", F.lit(1))).groupBy(*keys).applyInPandas(hold, schema)


def equal_weight(panel: DataFrame, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Every name with a price so far, equally."""
    p = with_returns(panel, (), by)
    return sized(p, F.col("c").isNotNull(), F.lit(1.0), gross, by)


def vol_momentum(panel: DataFrame, look: int = 252, skip: int = 21, days: int = 63, top: float = 0.1, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Momentum over volatility; the top share, inverse-volatility sized."""
    p = with_returns(panel, (1,), by).withColumn("vol", rolling(F.stddev_samp, "ret1", days, by))
    p = p.withColumn("m", F.try_divide(F.try_divide(F.lag("c", skip).over(along(by)), F.lag("c", look).over(along(by))) - 1, F.col("vol"))).withColumn("rank", rank_average("m", by))
    return sized(p, F.col("rank") > 1 - top, inverse("vol"), gross, by)


def beta_neutral_reversal(panel: DataFrame, market: DataFrame, days: int = 21, window: int = 63, share: float = 0.1, gross: float = 0.5, by: Keys = ()) -> DataFrame:
    """Losers by the return less beta times the market's over the same days."""
    m = market.withColumn("mlong", F.try_divide("mkt", F.lag("mkt", days).over(Window.orderBy("date"))) - 1).select("date", "mlong")
    p = beta(panel, market, window, by).withColumn("rlong", F.try_divide("c", F.lag("c", days).over(along(by))) - 1).join(F.broadcast(m), "date", "left")
    p = p.withColumn("residual", F.col("rlong") - F.col("beta") * F.col("mlong")).withColumn("rank", rank_average("residual", by))
    return sized(p, F.col("rank") <= share, F.lit(1.0), gross, by)


def market_drawdown_gate(market: DataFrame, limit: float = 0.1, days: int = 252) -> DataFrame:
    """Open while the market is less than `limit` below its high of `days` days; `factor` falls from 1 to 0 on the way there, for
    scaled() (G7)."""
    high = F.max("mkt").over(Window.orderBy("date").rowsBetween(1 - days, 0))
    out = market.withColumn("drawdown", 1 - F.try_divide(F.col("mkt"), high))
    return out.withColumns({"open": F.coalesce(F.col("drawdown") < limit, F.lit(True)), "factor": F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("drawdown") / limit), F.lit(1.0))})


def dispersion_gate(panel: DataFrame, days: int = 21, window: int = 252) -> DataFrame:
    """Open while the spread of returns between names is at or above its mean of `window` days."""
    d = with_returns(panel, (days,)).groupBy("date").agg(F.stddev_samp(f"ret{days}").alias("spread"))
    w = Window.orderBy("date").rowsBetween(1 - window, 0)
    return d.withColumn("open", F.coalesce(F.col("spread") >= F.avg("spread").over(w), F.lit(True)))


def scaled(weights: DataFrame, factor: DataFrame) -> DataFrame:
    """Weights times the date's `factor`; dates without one stay as they are."""
    return weights.join(F.broadcast(factor.select("date", "factor")), "date", "left").withColumn("w", F.col("w") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def adv_sized(panel: DataFrame, days: int = 20, power: float = -1.0, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """All names sized by a power of their mean dollar volume: -1 for its inverse, 0.5 for its root."""
    p = densify(panel, by).withColumn("dv", F.col("close") * F.col("volume")).withColumn("adv", rolling(F.avg, "dv", days, by, least=1))
    return sized(p, F.col("adv") > 0, F.pow("adv", F.lit(power)), gross, by)


def volume_surge(panel: DataFrame, short: int = 5, long: int = 63, top: float = 0.1, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Names whose volume of late is highest against its longer mean."""
    p = densify(panel, by).withColumns({"near": rolling(F.avg, "volume", short, by, least=1), "far": rolling(F.avg, "volume", long, by, least=1)})
    p = p.withColumn("surge", F.try_divide("near", "far")).withColumn("rank", rank_average("surge", by))
    return sized(p, F.col("rank") > 1 - top, F.lit(1.0), gross, by)


def median_rank(panel: DataFrame, share: float = 0.1, gross: float = 0.5, by: Keys = ()) -> DataFrame:
    """Losers by the median of three return ranks."""
    p = with_returns(panel, (5, 21, 63), by)
    p = p.withColumns({f"r{n}": rank_average(f"ret{n}", by) for n in (5, 21, 63)})
    three = [F.col(f"r{n}") for n in (5, 21, 63)]
    middle = three[0] + three[1] + three[2] - F.greatest(*three) - F.least(*three)
    p = p.withColumn("middle", middle).withColumn("rank", rank_average("middle", by))
    return sized(p, F.col("rank") <= share, F.lit(1.0), gross, by)


def z_reversal(panel: DataFrame, days: int = 21, limit: float = 1.0, gross: float = 0.5, by: Keys = ()) -> DataFrame:
    """Names more than `limit` deviations below the date's mean return, sized by how far."""
    p = with_returns(panel, (days,), by).withColumn("z", zscore(f"ret{days}", by))
    return sized(p, F.col("z") < -limit, -F.col("z"), gross, by)


def golden_cross(panel: DataFrame, short: int = 50, long: int = 200, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """Names whose short mean is above the long one, equally sized."""
    p = with_returns(panel, (), by).withColumns({"near": rolling(F.avg, "c", short, by), "far": rolling(F.avg, "c", long, by)})
    return sized(p, F.col("near") > F.col("far"), F.lit(1.0), gross, by)


def dual_momentum(panel: DataFrame, days: int = 126, top: float = 0.2, gross: float = 1.0, by: Keys = ()) -> DataFrame:
    """The top share by return of those that rose at all."""
    p = with_returns(panel, (days,), by).withColumn("rank", rank_average(f"ret{days}", by))
    return sized(p, (F.col("rank") > 1 - top) & (F.col(f"ret{days}") > 0), F.lit(1.0), gross, by)


def days_since_low(panel: DataFrame, days: int = 252, by: Keys = ()) -> DataFrame:
    """Calendar rows since the last low of the window."""
    p = with_returns(panel, (), by).withColumn("__n", F.row_number().over(along(by)))
    w = along(by).rowsBetween(1 - days, 0)
    at = F.max_by("__n", F.when(F.col("c").isNotNull(), F.struct((-F.col("c")).alias("c"), "__n"))).over(w)
    return p.withColumn("since_low", F.col("__n") - at).drop("__n")


def vol_target(weights: DataFrame, daily: DataFrame, target: float = 0.06, days: int = 63, most: float = 2.0, days_per_year: int = 252) -> DataFrame:
    """Weights scaled so that the run's volatility of the last `days` days would have met the target (G15). `daily` are the
    returns of the unscaled weights: two passes."""
    vol = F.stddev_samp("ret").over(Window.orderBy("date").rowsBetween(1 - days, 0)) * F.sqrt(F.lit(float(days_per_year)))
    full = F.count("ret").over(Window.orderBy("date").rowsBetween(1 - days, 0)) >= days
    factor = daily.select("date", F.when(full, F.least(F.lit(most), F.coalesce(F.try_divide(F.lit(target), vol), F.lit(1.0)))).alias("factor"))
    return scaled(weights, factor)


def rebalanced(weights: DataFrame, cadence: str, by: Keys = ()) -> DataFrame:
    """Targets held from the end of each period (G16): `friday`, `wednesday`, `month`, `quarter`; `daily` changes nothing."""
    day = F.col("date")
    if cadence == "daily":
        return weights
    if cadence == "friday":
        return weekly_last(weights, by=by)
    if cadence == "wednesday":
        return period_last(weights, F.next_day(F.date_sub(day, 1), "WED"), F.date_sub(F.next_day(day, "WED"), 7), by=by)
    start = F.trunc(day, cadence)
    return period_last(weights, start, F.add_months(start, {"month": -1, "quarter": -3}[cadence]), by=by)


SIGNALS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (quad_reversal, bottom_k_reversal, oracle_sign, momentum, low_volatility, long_short, residual_reversal, soft_tilt, liquid, equal_weight, vol_momentum, adv_sized, volume_surge, median_rank, z_reversal, golden_cross, dual_momentum)
}
