"""Stationary bootstrap of a daily series. Random numbers are hashes of (seed, draw, place), so they need no stream and come out
alike on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig
from .panel import Keys


def each_draw(draws: int) -> Column:
    """0 to draws - 1; empty for none (a sequence would count down)."""
    return F.sequence(F.lit(0), F.lit(draws - 1)) if draws > 0 else F.array().cast("array<int>")


def hash_uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from the first 8 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def bootstrap_draws(returns: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """Sharpe ratio of each stationary-bootstrap draw of (date, ex) (X2, W15): a path restarts with probability 1 / block
    and else steps on; restarts are gaps, steps are islands, so a path is one window. No draws give no rows."""
    from .backtest import sharpe

    w = Window.partitionBy(*by).orderBy("date")
    rows = returns.where(F.col("ex").isNotNull()).withColumn("pos", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    rows = rows.where(F.col("n") >= cfg.bootstrap_min_days).select(*by, "pos", "n", "ex")
    path = rows.select(*by, "pos", "n", F.explode(each_draw(cfg.bootstrap_draws)).alias("draw"))
    start = (F.col("pos") == 0) | (hash_uniform(cfg.seed, F.lit("jump"), F.col("draw"), F.col("pos")) < 1.0 / cfg.bootstrap_block)
    path = path.withColumn("to", F.when(start, F.floor(hash_uniform(cfg.seed, F.lit("to"), F.col("draw"), F.col("pos")) * F.col("n")).cast("long"))).withColumn("from", F.when(start, F.col("pos")))
    so_far = Window.partitionBy(*by, "draw").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.last("to", True).over(so_far) + F.col("pos") - F.last("from", True).over(so_far)) % F.col("n")
    drawn = path.select(*by, "draw", at.alias("pos")).join(rows.select(*by, F.col("pos").cast("long").alias("pos"), "ex"), [*by, "pos"])
    return drawn.groupBy(*by, "draw").agg(sharpe(F.col("ex"), cfg.days_per_year).alias("sharpe"))


def bootstrap_interval(returns: DataFrame, cfg: BacktestConfig, by: Keys = ()) -> DataFrame:
    """lo, hi and how many draws have a ratio, one row a key that has enough days; without keys always one row."""
    tail = (1 - cfg.confidence) / 2
    return bootstrap_draws(returns, cfg, by).groupBy(*by).agg(F.percentile("sharpe", F.lit(tail)).alias("lo"), F.percentile("sharpe", F.lit(1 - tail)).alias("hi"), F.count("sharpe").alias("draws"))
