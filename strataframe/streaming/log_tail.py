"""Beyond batch: the trial log as a stream of files, deduplicated by hash, counted by branch and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_trials(stream: DataFrame, time: str = "written_at", key: str = "ast_sha256", late: str = "1 day") -> DataFrame:
    """The first row of each hash; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, time: str = "written_at", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("hour"), "branch_tag").agg(F.count("*").alias("n"), F.max("oos_sharpe").alias("best"))
