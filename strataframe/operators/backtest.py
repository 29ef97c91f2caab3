"""Weights to daily returns to metrics: hold, mask, lag, cost, reduce. Lazy plans; extra keys `by` run many at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig, borrow_bps
from ..scratch import written
from .bootstrap import bootstrap_interval
from .panel import Keys, along, change, clean, densify, membership, pad, rank_average, rolling, so_far


def effective_weights(
    weights: DataFrame, panel: DataFrame, cfg: BacktestConfig, by: Keys = (), panel_by: Keys = (), additions: DataFrame | None = None, removals: DataFrame | None = None
) -> DataFrame:
    """The dense panel with `target` (held over gaps, 0 outside membership), `w_eff` (one day later), `dw` and `ret1`.

    Order matters: hold, then mask, then lag (X0 steps 6 to 9). Weights on other dates or tickers are dropped first. `by` are
    keys of the weights; those of them that the panel has too, as null draws do, are `panel_by`. With keys each run has the
    tickers that it has weights for: the others would be zeros throughout.
    """
    dense = densify(panel.select(*panel_by, "date", "ticker", clean("close").alias("close")), panel_by)
    dense = membership(dense, additions, removals, panel_by).withColumn("c", pad("close", panel_by) if cfg.pad_returns else F.col("close"))
    dense = dense.withColumn("ret1", F.coalesce(change("c", 1, panel_by), F.lit(0.0)))
    if cfg.impact_slope_bps > 0:
        dense = dense.withColumn("__r", change("c", 1, panel_by)).withColumn("vol63", rolling(F.stddev_samp, "__r", 63, panel_by)).withColumn("vol_rank", rank_average("vol63", panel_by)).drop("__r")
    if list(by) != list(panel_by):
        dense = weights.select(*by, "ticker").distinct().join(dense, [*panel_by, "ticker"])
    p = dense.join(weights.select(*by, "date", "ticker", clean("w").alias("w")), [*by, "date", "ticker"], "left")
    p = p.withColumn("target", F.when(F.col("active"), F.coalesce(pad("w", by), F.lit(0.0))).otherwise(0.0))
    p = p.withColumn("w_eff", F.coalesce(F.lag("target").over(along(by)), F.lit(0.0)))
    return p.withColumn("dw", F.abs(F.coalesce(F.col("w_eff") - F.lag("w_eff").over(along(by)), F.lit(0.0))))


def daily_returns(effective: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """One row a date: gross, pnl, turnover, cost, borrow, ret, trades, and row_hash, which tells different rows of weights
    apart whatever their order (A1, X1, X1b)."""
    flat = F.lit(cfg.cost_bps / 1e4)
    rate = flat if cfg.impact_slope_bps <= 0 else F.coalesce((F.lit(cfg.cost_bps) + cfg.impact_slope_bps * F.col("vol_rank")) / 1e4, flat)
    day = effective.groupBy(*by, "date").agg(
        F.coalesce(F.sum(F.abs("w_eff")), F.lit(0.0)).alias("gross"), F.coalesce(F.sum(F.col("w_eff") * F.col("ret1")), F.lit(0.0)).alias("pnl"),
        F.coalesce(F.sum("dw"), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum(F.col("dw") * rate), F.lit(0.0)).alias("cost"),
        (F.coalesce(F.sum(F.greatest(-F.col("w_eff"), F.lit(0.0))), F.lit(0.0)) * F.lit(cfg.borrow_bps / 1e4 / cfg.days_per_year)).alias("borrow"),
        F.count_if(F.col("dw") > cfg.trade_epsilon).alias("trades"), F.bit_xor(F.xxhash64("ticker", F.bround("w_eff", 10))).alias("row_hash"),
    )
    return day.withColumn("ret", F.col("pnl") - F.col("cost") - F.col("borrow"))


def strat_returns(weights: DataFrame, panel: DataFrame, cfg: BacktestConfig, by: Keys = (), panel_by: Keys = (), **schedule) -> DataFrame:
    """Daily returns net of all costs: the one path that backtests, null draws and sweeps share."""
    return daily_returns(effective_weights(weights, panel, cfg, by, panel_by, **schedule), cfg, by)


def sharpe(excess: Column, days: int = 252) -> Column:
    """Yearly Sharpe ratio of excess returns; NULL with fewer than 2 or no spread (A2)."""
    return F.try_divide(F.avg(excess), F.nullif(F.stddev_samp(excess), F.lit(0.0))) * F.sqrt(F.lit(float(days)))


def in_sample(cfg: BacktestConfig) -> Column:
    return F.col("date").between(F.lit(cfg.is_start).cast("date"), F.lit(cfg.is_end).cast("date"))


def out_of_sample(cfg: BacktestConfig) -> Column:
    return F.col("date").between(F.lit(cfg.oos_start).cast("date"), F.lit(cfg.oos_end).cast("date"))


def risk_free(calendar: DataFrame, rates: DataFrame | None, cfg: BacktestConfig) -> DataFrame:
    """(date, rf): a rate in percent a year on exactly its date, then carried; the constant before the first."""
    constant = F.lit(cfg.risk_free / cfg.days_per_year)
    if rates is None:
        return calendar.select("date").distinct().withColumn("rf", constant)
    joined = calendar.select("date").distinct().join(rates.select("date", (F.col("irx") / 100.0 / cfg.days_per_year).alias("__r")), "date", "left")
    return joined.select("date", F.coalesce(F.last("__r", ignorenulls=True).over(so_far(Window.orderBy("date"))), constant).alias("rf"))


def with_excess(daily: DataFrame, cfg: BacktestConfig, rf: DataFrame | None = None) -> DataFrame:
    constant = F.lit(cfg.risk_free / cfg.days_per_year)
    if rf is None:
        return daily.withColumn("ex", F.col("ret") - constant)
    return daily.join(F.broadcast(rf), "date", "left").withColumn("ex", F.col("ret") - F.coalesce("rf", constant)).drop("rf")


def equity(daily: DataFrame, by: Keys = ()) -> DataFrame:
    """Compounded wealth and its running high and drawdown."""
    w = so_far(Window.partitionBy(*by).orderBy("date"))
    return daily.withColumn("equity", F.product(1 + F.col("ret")).over(w)).withColumn("high", F.max("equity").over(w)).withColumn("drawdown", (F.col("high") - F.col("equity")) / F.col("high"))


def fold_table(cfg: BacktestConfig, spark) -> DataFrame:
    rows = [(f.name, f.start, f.end, f.kind) for f in cfg.folds]
    return spark.createDataFrame(rows, "fold string, start string, end string, kind string").select("fold", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"), "kind")


def fold_sharpes(daily: DataFrame, cfg: BacktestConfig, by: Keys = (), embargo: int | None = None) -> DataFrame:
    """Sharpe of each fold after its first `embargo` rows; NULL if none are left."""
    skip = cfg.embargo_days if embargo is None else embargo
    folds = F.broadcast(fold_table(cfg, daily.sparkSession))
    rows = daily.join(folds, F.col("date").between(F.col("start"), F.col("end")))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "fold").orderBy("date")))
    value = F.when(F.col("__n") > skip, F.col("ex"))
    return rows.groupBy(*by, "fold", "kind", "start", "end").agg(F.count("*").alias("days"), sharpe(value, cfg.days_per_year).alias("sharpe"))


def yearly_sharpes(daily: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    return daily.where(out_of_sample(cfg)).groupBy(*by, F.year("date").alias("year")).agg(sharpe(F.col("ex"), cfg.days_per_year).alias("sharpe"))


def fold_medians(folds: DataFrame, by: Keys = ()) -> DataFrame:
    """Median and least Sharpe over all, in-sample and out-of-sample folds in one pass."""
    def both(name, cond):
        v = F.when(cond, F.col("sharpe"))
        return [F.percentile(v, F.lit(0.5)).alias(f"{name}median"), F.min(v).alias(f"{name}min")]

    return folds.groupBy(*by).agg(*both("", F.lit(True)), *both("is_", F.col("kind") == "IS"), *both("oos_", F.col("kind") == "OOS"))


def headline(daily: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """One row: Sharpe in and out of sample, drawdown, yearly return and volatility, Calmar, turnover, trades."""
    wealth = equity(daily.where(out_of_sample(cfg)), by).groupBy(*by).agg(F.when(F.count("*") >= 2, F.max("drawdown")).alias("max_drawdown"))
    oos, year = out_of_sample(cfg), float(cfg.days_per_year)
    n, total = F.count_if(oos), F.product(F.when(oos, 1 + F.col("ret")).otherwise(1.0))
    main = daily.groupBy(*by).agg(
        sharpe(F.when(in_sample(cfg), F.col("ex")), cfg.days_per_year).alias("is_sharpe"), sharpe(F.when(oos, F.col("ex")), cfg.days_per_year).alias("oos_sharpe"),
        F.when((n > 0) & (total > 0), F.pow(total, F.lit(year) / n) - 1).alias("annual_return"), (F.stddev_samp(F.when(oos, F.col("ret"))) * F.sqrt(F.lit(year))).alias("annual_vol"),
        (F.avg(F.when(oos, F.col("turnover"))) * year).alias("turnover_annual"), F.sum(F.when(oos, F.col("trades")).otherwise(0)).alias("num_trades"), F.max("gross").alias("max_gross"),
    )
    both = main.join(wealth, list(by), "left") if by else main.crossJoin(F.broadcast(wealth))
    return both.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("annual_return") / F.col("max_drawdown")))


def status_hint(cfg: BacktestConfig) -> Column:
    """crash, force_discard or keep_eligible, in this order of rules (X1d)."""
    finite = [F.col(c).isNotNull() for c in ("oos_sharpe", "is_sharpe", "max_drawdown", "annual_return", "annual_vol", "turnover_annual")]
    ok = finite[0]
    for f in finite[1:]:
        ok = ok & f
    return (
        F.when(~ok, "crash").when(F.col("num_trades") < cfg.min_trades, "crash").when(F.col("max_drawdown") > cfg.max_drawdown, "force_discard")
        .when(F.col("turnover_annual") > cfg.max_turnover, "force_discard").otherwise("keep_eligible")
    )


def null_share(weights: DataFrame, by: Keys = ()) -> DataFrame:
    """Share of missing cells of the raw weights, over their own dates and tickers."""
    days = weights.groupBy(*by, "date").agg(F.count(clean("w")).alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("days"))
    names = weights.select(*by, "ticker").distinct().groupBy(*by).agg(F.count("*").alias("names"))
    both = days.join(names, list(by)) if by else days.crossJoin(F.broadcast(names))
    return both.select(*by, (1.0 - F.try_divide(F.col("n").cast("double"), F.col("days") * F.col("names"))).alias("null_share"))


def guards(weights: DataFrame, daily: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """Share of missing cells of the raw weights, greatest leverage, different out-of-sample weight rows, and the first
    reason to crash, if any (A17, A18, A19, X1c)."""
    total = daily.groupBy(*by).agg(F.max("gross").alias("max_gross"), F.count_distinct(F.when(out_of_sample(cfg), F.col("row_hash"))).alias("oos_rows"))
    raw = null_share(weights, by)
    out = raw.join(total, list(by)) if by else raw.crossJoin(total)
    reason = F.when(F.col("null_share").isNull() | (F.col("null_share") > cfg.max_null_share), "mostly missing weights").when(F.col("max_gross") > cfg.max_gross, "leverage above the limit").when(F.col("oos_rows") < 2, "frozen weights")
    return out.withColumn("crash_reason", reason)


def metrics(daily: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """All figures of daily returns with `ex`, one row for each run (X0b): the headline, the bootstrap interval, fold medians,
    ratios by year and by fold as maps, and the out-of-sample series as JSON."""
    folds = fold_sharpes(daily, cfg, by)
    maps = folds.groupBy(*by).agg(F.collect_list(F.struct("fold", "sharpe", "kind")).alias("__f"))
    pick = lambda kind, name: F.map_from_entries(F.sort_array(F.transform(F.filter("__f", lambda x: F.lit(kind is None) | (x["kind"] == F.lit(kind or ""))), lambda x: F.struct(x["fold"], x["sharpe"])))).alias(name)
    maps = maps.select(*by, pick(None, "fold_sharpes"), pick("IS", "is_fold_sharpes"), pick("OOS", "oos_fold_sharpes"))
    medians = fold_medians(folds, by)
    medians = medians.withColumnsRenamed({"median": "median_fold_sharpe", "min": "min_fold_sharpe", **{f"{k}_{m}": f"{k}_fold_{m}_sharpe" for k in ("is", "oos") for m in ("median", "min")}})
    yearly = yearly_sharpes(daily, cfg, by).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "sharpe")))).alias("yearly_sharpe"))
    oos = daily.where(out_of_sample(cfg))
    interval = bootstrap_interval(oos, cfg, by).select(*by, F.col("lo").alias("oos_sharpe_lo"), F.col("hi").alias("oos_sharpe_hi"))
    series = oos.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", F.round("ret", 10).alias("ret")))).alias("r"))
    text = F.to_json(F.struct(F.lit("ret").alias("name"), F.transform("r", lambda x: x["date"].cast("timestamp")).alias("index"), F.transform("r", lambda x: x["ret"]).alias("data")))
    out = headline(daily, cfg, by).drop("max_gross")
    for p in (interval, medians, yearly, maps, series.select(*by, text.alias("oos_daily_returns_json"))):
        out = out.join(p, list(by), "left") if by else out.crossJoin(F.broadcast(p))
    return out


def crashed(result: DataFrame) -> DataFrame:
    """The result of a run with a crash_reason: no figures, no trades, empty maps, no series."""
    out = {}
    for name, kind in result.dtypes:
        if name in ("crash_reason", "status_hint", "null_share", "max_gross", "oos_rows"):
            continue
        empty = F.lit(0).cast(kind) if name == "num_trades" else F.create_map().cast(kind) if kind.startswith("map") else F.lit("") if name.endswith("_json") else F.lit(None).cast(kind) if kind == "double" else None
        if empty is not None:
            out[name] = F.when(F.col("crash_reason").isNotNull(), empty).otherwise(F.col(name))
    return result.withColumns(out)


def run_backtest(
    weights: DataFrame, panel: DataFrame, cfg: BacktestConfig, by: Keys = (), panel_by: Keys = (), rates: DataFrame | None = None, universe: str | None = None, **schedule
) -> DataFrame:
    """One row for each run: metrics(), guards(), status_hint and crash_reason; a crashed run keeps no figures.

    `universe` sets the borrow rate to its tier (J14); None keeps that of `cfg`. The daily returns, a row a date and run,
    are written to the shared folder once, when this is called, because all figures read them.
    """
    cfg = cfg if universe is None else replace(cfg, borrow_bps=borrow_bps(universe))
    rf = None if rates is None else risk_free(panel, rates, cfg)
    daily = written(with_excess(strat_returns(weights, panel, cfg, by, panel_by, **schedule), cfg, rf), "daily")
    out, checks = metrics(daily, cfg, by), guards(weights, daily, cfg, by)
    out = out.join(checks, list(by)) if by else out.crossJoin(F.broadcast(checks))
    return crashed(out.withColumn("status_hint", F.when(F.col("crash_reason").isNotNull(), "crash").otherwise(status_hint(cfg))))
