"""Null shuffles and parameter sweeps as extra keys of one plan; random numbers as in the bootstrap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..scratch import dropping_tables, each_key_in_one_task, written
from .backtest import out_of_sample, sharpe, strat_returns, with_excess
from .bootstrap import bootstrap_draws, bootstrap_interval, each_draw, hash_uniform
from .panel import change, clean, densify, pad

__all__ = ["bootstrap_draws", "bootstrap_interval", "candidates", "hash_uniform", "null_draws", "null_test", "perturbed", "sensitivity", "sensitivity_summary", "shuffled_panels"]

#: Panel rows of a batch of null draws.
DRAWN_ROWS = 4_000_000


def _padded_returns(panel: DataFrame) -> DataFrame:
    """(ticker, date, pos, i, c, r): the padded closes and returns, numbered by the calendar and from each ticker's first close."""
    w = Window.partitionBy("ticker").orderBy("date")
    dense = densify(panel.select("date", "ticker", clean("close").alias("close"))).withColumns({"c": pad("close"), "pos": F.row_number().over(w) - 1})
    return dense.where(F.col("c").isNotNull()).select("ticker", "date", "pos", (F.row_number().over(w) - 1).alias("i"), "c", change("c").alias("r"))


def _shuffled(returns: DataFrame, draws: Column, seed: int) -> DataFrame:
    """The shuffled panels of an array of draws. A place takes its date from the calendar, so that no draw is joined to itself."""
    order = Window.partitionBy("k", "ticker").orderBy(F.col("i") > 0, hash_uniform(seed, F.col("k"), F.col("ticker"), F.col("i")), "i")
    keyed = returns.select(F.explode(draws).alias("k"), "ticker", (F.col("pos") - F.col("i")).alias("start"), "i", "c", "r").withColumn("j", F.row_number().over(order) - 1)
    w = Window.partitionBy("k", "ticker").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("i") > 0, 1 + F.coalesce("r", F.lit(0.0))).otherwise(1.0)
    moved = keyed.select("k", "ticker", (F.col("start") + F.col("j")).alias("pos"), (F.first("c").over(w) * F.product(step).over(w)).alias("close"))
    calendar = returns.groupBy("pos").agg(F.min("date").alias("date"))
    return moved.join(F.broadcast(calendar), "pos").select("k", "date", "ticker", F.when(F.col("close") > 0, F.col("close")).alias("close"))


def shuffled_panels(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """`draws` panels (k, date, ticker, close): each ticker's padded returns in a random order, compounded from its first
    close (X3)."""
    return _shuffled(_padded_returns(panel), each_draw(draws), seed)


def null_draws(panel: DataFrame, signal: Callable[..., DataFrame], cfg: BacktestConfig, draws: int = 200, rows: int = DRAWN_ROWS) -> DataFrame:
    """(k, s): the Sharpe ratio of each shuffled panel, NULL where it has none. Draws are a key of the panel: the signal and the
    returns, with all their costs, run once for all draws of a batch.

    Runs when this is called, in batches of draws of about `rows` panel rows (one draw at least). Panels and weights of a batch
    are written to the shared folder and removed after it, so plans stay small and disk does not grow with the draws.
    """
    spark = panel.sparkSession
    with dropping_tables(spark), each_key_in_one_task(spark):
        returns = written(_padded_returns(panel), "returns")
        step = max(1, rows // max(1, returns.count()))
        tasks = max(min(step, draws), int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = []
        for first in range(0, draws, step):
            with dropping_tables(spark):
                ks = F.sequence(F.lit(first), F.lit(min(draws, first + step) - 1))
                shuffled = written(_shuffled(returns, ks, cfg.seed), "shuffled").repartition(tasks, "k")
                weights = written(signal(shuffled, by=("k",)), "weights").repartition(tasks, "k")
                daily = with_excess(strat_returns(weights, shuffled, cfg, ("k",), ("k",)), cfg).where(out_of_sample(cfg))
                found.append(written(daily.groupBy("k").agg(sharpe(F.col("ex"), cfg.days_per_year).alias("s")), "draws", keep=True))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "k int, s double")


def null_test(panel: DataFrame, signal: Callable[..., DataFrame], cfg: BacktestConfig, draws: int = 200) -> DataFrame:
    """One row: the real Sharpe, how many draws have one and how many failed, mean, spread, 5 and 95 percent points of the
    shuffled ones, p and the verdict at `p_limit` (X3b, A21). p is NULL without the real ratio or without any draw.

    The panel is written once: the plans of the real run and of the draws read it many times."""
    panel = written(panel, "panel")
    null = null_draws(panel, signal, cfg, draws)
    real = with_excess(strat_returns(signal(panel), panel, cfg), cfg).where(out_of_sample(cfg)).agg(sharpe(F.col("ex"), cfg.days_per_year).alias("real"))
    out = null.crossJoin(F.broadcast(real)).agg(
        F.first("real").alias("real"), F.count("s").alias("draws"), (F.lit(max(0, draws)) - F.count("s")).alias("failed"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"),
        F.percentile("s", F.lit(0.05)).alias("p05"), F.percentile("s", F.lit(0.95)).alias("p95"), F.avg(F.when(F.col("s").isNotNull(), (F.col("s") >= F.col("real")).cast("double"))).alias("p"),
    )
    return out.withColumn("status", F.when(F.col("p") <= cfg.p_limit, "REJECT_NULL").when(F.col("p").isNotNull(), "FAIL_TO_REJECT"))


def perturbed(value: int | float) -> list[int | float]:
    """0.8 and 1.2 times a parameter: whole numbers stay whole and positive, shares stay in (0, 1]."""
    out = []
    for factor in (0.8, 1.2):
        if isinstance(value, bool):
            continue
        new = max(1, round(value * factor)) if isinstance(value, int) else (min(1.0, value * factor) or 1e-6)
        if new != value and new not in out:
            out.append(new)
    return out


def candidates(params: dict) -> dict:
    """Parameters a sweep moves: whole numbers of 6 and more, fractions between 0 and 1 (X7); by name, not by place."""
    return {k: v for k, v in params.items() if not isinstance(v, bool) and (isinstance(v, int) and v >= 6 or isinstance(v, float) and 0 < v < 1)}


def sensitivity(panel: DataFrame, signal: Callable[..., DataFrame], params: dict, cfg: BacktestConfig) -> DataFrame:
    """Out-of-sample Sharpe of the signal and of each perturbed variant, in one multi-strategy plan, with the change."""
    variants = [("base", dict(params))] + [(f"{k}={v:g}", {**params, k: v}) for k, base in candidates(params).items() for v in perturbed(base)]
    weights = reduce(DataFrame.unionByName, [signal(panel, **p).withColumn("strategy_id", F.lit(n)) for n, p in variants])
    daily = with_excess(strat_returns(weights, panel, cfg, ("strategy_id",)), cfg).where(out_of_sample(cfg))
    s = daily.groupBy("strategy_id").agg(sharpe(F.col("ex"), cfg.days_per_year).alias("sharpe"))
    # A window over one row for each variant: a join with the base's row would hold the plan of all variants twice.
    base = F.max(F.when(F.col("strategy_id") == "base", F.col("sharpe"))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("delta", F.col("sharpe") - base)


def sensitivity_summary(sweep: DataFrame, limit: float = 0.3) -> DataFrame:
    """Greatest and spread of the changes and the verdict."""
    d = F.when(F.col("strategy_id") != "base", F.col("delta"))
    return sweep.agg(F.max(F.abs(d)).alias("max_abs_delta"), F.stddev_pop(d).alias("sd"), F.count(d).alias("variants")).withColumn("fragile", F.col("max_abs_delta") > limit)
