"""Panels and logs derived from the star-schema tables; integers first, so that engines agree bit for bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import BacktestConfig, Fold

CONFIG = BacktestConfig(
    is_start="1995-01-01", is_end="1999-12-31", oos_start="2000-01-01", oos_end="2001-12-31",
    folds=(Fold("is_1", "1996-01-01", "1997-12-31", "IS"), Fold("is_2", "1998-01-01", "1999-12-31", "IS"), Fold("oos_1", "2000-01-01", "2000-12-31", "OOS"), Fold("oos_2", "2001-01-01", "2001-12-31", "OOS")),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_discount") * 100).cast("long").alias("x"), F.col("l_quantity").cast("long").alias("q"))


def panel_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from discounts by nation and day."""
    names = _read(spark, sf_dir, "supplier").join(F.broadcast(_read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("ticker"))
    rows = _lines(spark, sf_dir).join(names, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("date", "ticker").agg(
        (F.lit(100.0) + (F.min("x") + F.max("x")) / F.lit(2.0)).alias("open"), (F.lit(100.0) + F.max("x")).alias("high"), (F.lit(100.0) + F.min("x")).alias("low"),
        (F.lit(100.0) + F.sum("x") / F.count("*")).alias("close"), F.sum("q").cast("double").alias("volume"),
    )


def panel_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded prices: independent returns."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return panel_flat(spark, sf_dir).select("date", "ticker", (100.0 * F.product(1 + (F.col("close") - 105) / 100).over(w)).alias("close"))


def market_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("date").agg((F.lit(100.0) + F.sum("x") / F.count("*")).alias("mkt"))


def schedule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    added = n.where("n_nationkey between 0 and 4").select("ticker", F.lit("1996-01-01").cast("date").alias("date"))
    return added, n.where("n_nationkey between 20 and 24").select("ticker", F.lit("2001-01-01").cast("date").alias("date"))


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    sharpe = F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 17 != 0), F.col("o_totalprice") / 100000.0 - 1)
    return o.select(
        F.col("o_orderkey").alias("row_no"), F.col("o_orderpriority").alias("universe_tag"), F.md5(F.concat((F.col("o_custkey") % 700).cast("string"), F.lit("|"), "o_orderpriority").cast("binary")).alias("ast_sha256"),
        F.concat(F.lit("b"), (F.col("o_custkey") % 20).cast("string")).alias("branch_tag"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("commit"), sharpe.alias("oos_sharpe"),
        F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "discard").otherwise("crash").alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise("2").alias("hurdle_version"), F.col("o_orderdate").alias("written_at"),
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_no"), F.concat(F.lit("thesis: "), "p_type", F.lit(" size "), F.col("p_size").cast("string")).alias("description"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial log with figures of each run, all from whole numbers; some are missing."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    part = lambda col, m, d, less: (F.col(col) % m) / F.lit(float(d)) - F.lit(less)
    figures = o.select(
        "row_no", F.when(F.col("k") % 11 != 0, part("c", 100, 50, 0.5)).alias("is_fold_median_sharpe"), part("k", 40, 40, 0.2).alias("oos_fold_median_sharpe"), part("k", 30, 30, 0.1).alias("min_fold_sharpe"),
        part("c", 60, 100, 0.0).alias("max_drawdown"), part("k", 70, 1, 0.0).alias("turnover_annual"), (F.col("c") % 200).alias("num_trades"), F.when(F.col("k") % 7 == 0, part("c", 30, 100, 0.0)).alias("paired_p"),
    )
    log = trial_log(spark, sf_dir)
    return log.join(figures, "row_no").withColumn("oos_sharpe_lo", F.col("oos_sharpe") - 0.3)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate in percent a year on every third date of the market's, and on dates that are none of its."""
    return _lines(spark, sf_dir).groupBy("date").agg(F.sum("x").alias("x")).where("x % 3 = 0").select(F.when(F.col("x") % 2 == 0, F.col("date")).otherwise(F.date_sub("date", 9000)).alias("date"), (F.col("x") % 500 / F.lit(100.0)).alias("irx"))
