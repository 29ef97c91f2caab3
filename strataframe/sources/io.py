"""Sources and sinks: panels, universes, schedules and logs, with explicit schemas throughout."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FIELDS = ("open", "high", "low", "close", "volume")
UNIVERSE = "tag string, as_of string, source string, survivorship_warning string, tickers array<string>"
SCHEDULE = "removals array<struct<ticker:string,date:string>>, additions array<struct<ticker:string,date:string>>"
RESULTS = "commit string, oos_sharpe string, max_dd string, turnover string, status string, description string"
CACHE = "ast_sha256 string, branch_tag string, commit string, oos_sharpe string, status string, hurdle_version string, written_at string"
SERIES = "name string, `index` array<timestamp>, data array<double>"


def read_panel(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Long panel; only the fields asked for are read."""
    p = spark.read.parquet(path)
    return p.select(F.col("date").cast("date").alias("date"), "ticker", *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in fields])


def exists(spark: SparkSession, *paths: str) -> bool:
    """Whether all paths are there, in any store that Spark reads."""
    def there(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    return all(there(p) for p in paths)


def missing_columns(df: DataFrame, needed: tuple[str, ...]) -> list[str]:
    """Columns that a table should have and has not (P15); callers skip or reject it."""
    return sorted(set(needed) - set(df.columns))


def read_market(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """(date, mkt) of a market series kept as a long panel, or as one column beside the date (S10); broadcast by its users."""
    p = spark.read.parquet(path)
    if "ticker" in p.columns:
        p = p.where(F.col("ticker") == ticker) if ticker is not None else p
        return p.select(F.col("date").cast("date").alias("date"), F.nanvl(F.col("close").cast("double"), F.lit(None)).alias("mkt"))
    value = next(c for c in p.columns if c != "date")
    return p.select(F.col("date").cast("date").alias("date"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("mkt"))


def assemble(requested: DataFrame, first: DataFrame, fetch) -> tuple[DataFrame, DataFrame]:
    """The panel of a first batch and of fetch(tickers) for what it lacks, and the tickers that neither has (S4). `fetch` is any
    source: it takes a frame of tickers and gives long rows."""
    panel = merge_batches(first, fetch(retry_missing(requested, first)))
    return panel, retry_missing(requested, panel)


def with_dollar_volume(panel: DataFrame) -> DataFrame:
    return panel.withColumn("dollar_volume", F.col("close") * F.col("volume"))


def write_panel(panel: DataFrame, path: str, refresh: bool = False) -> None:
    """Partitioned by nothing but time order: one table of all fields; kept as it is unless `refresh`."""
    panel.repartitionByRange("date").sortWithinPartitions("date", "ticker").write.mode("overwrite" if refresh else "ignore").parquet(path)


def from_wide(wide: DataFrame, field: str) -> DataFrame:
    """A (date, ticker columns) frame as long rows; tickers without a value are dropped."""
    names = [c for c in wide.columns if c != "date"]
    long = wide.select("date", F.inline(F.array(*[F.struct(F.lit(n).alias("ticker"), F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)).alias(field)) for n in names])))
    seen = long.where(F.col(field).isNotNull()).select("ticker").distinct()
    return long.join(seen, "ticker", "left_semi")


def retry_missing(requested: DataFrame, delivered: DataFrame) -> DataFrame:
    """Tickers that a batch did not deliver."""
    return requested.select("ticker").distinct().join(delivered.select("ticker").distinct(), "ticker", "left_anti")


def merge_batches(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Both batches; tickers of the retry override."""
    return first.join(retry.select("ticker").distinct(), "ticker", "left_anti").unionByName(retry)


def top_moves(panel: DataFrame, n: int = 10) -> DataFrame:
    """The n greatest absolute daily returns, a report."""
    from ..operators.panel import with_returns

    return with_returns(panel).where("ret1 is not null").select("date", "ticker", "ret1").orderBy(F.abs("ret1").desc(), "date", "ticker").limit(n)


def read_universe(spark: SparkSession, path: str, default_tag: str | None = None) -> DataFrame:
    """(universe_tag, ticker) of a JSON universe file."""
    u = spark.read.schema(UNIVERSE).json(path, multiLine=True)
    return u.select(F.coalesce("tag", F.lit(default_tag)).alias("universe_tag"), F.explode("tickers").alias("ticker"))


def read_schedule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Additions and removals (ticker, date); absent or malformed files give empty frames, bad dates are skipped."""
    try:
        s = spark.read.schema(SCHEDULE).json(path, multiLine=True)
        s.schema  # noqa: B018
    except AnalysisException:
        s = spark.createDataFrame([], SCHEDULE)
    side = lambda c: s.select(F.inline(c)).select("ticker", F.try_to_timestamp(F.col("date")).cast("date").alias("date")).where("ticker is not null and date is not null")
    return side("additions"), side("removals")


def _numbered(df: DataFrame) -> DataFrame:
    """File order as row_no; logs are small and single files."""
    return df.withColumn("row_no", F.monotonically_increasing_id())


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results log; commits stay text, numbers that do not parse are NULL."""
    r = _numbered(spark.read.schema(RESULTS).csv(path, sep="\t", header=True))
    return r.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("oos_sharpe", "max_dd", "turnover")}).withColumn("status", F.lower(F.trim("status")))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Trial caches of one or many universes (a glob); the universe is the file's name (S15, S16). Rows with another number of
    fields are kept apart: their text is in `malformed`, which is NULL for others."""
    schema = CACHE + ", malformed string"
    try:
        c = _numbered(spark.read.schema(schema).option("columnNameOfCorruptRecord", "malformed").csv(path, sep="\t", header=True, mode="PERMISSIVE", enforceSchema=True))
    except AnalysisException:
        c = _numbered(spark.createDataFrame([], schema))
    tag = F.regexp_extract(F.input_file_name(), r"trial_cache_(.+)\.tsv$", 1)
    return c.withColumn("universe_tag", tag).withColumn("oos_sharpe", F.nanvl(F.expr("try_cast(oos_sharpe AS DOUBLE)"), F.lit(None))).withColumn("status", F.lower(F.trim("status")))


def read_oos_log(spark: SparkSession, path: str, columns: list[str], text: tuple[str, ...] = ("commit", "status_hint")) -> DataFrame:
    """Metrics log with a known header; all but text and JSON columns as numbers, trades as whole numbers."""
    raw = _numbered(spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, sep="\t", header=True))
    numbers = [c for c in columns if c not in text and not c.endswith("_json")]
    out = raw.withColumns({c: F.nanvl(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(None)) for c in numbers})
    return out.withColumn("num_trades", F.coalesce(F.col("num_trades"), F.lit(0)).cast("int")) if "num_trades" in numbers else out


def parse_series(column: str = "oos_daily_returns_json"):
    """Array of (date, ret) from split-oriented JSON; NULL for empty text and `nan`."""
    text = F.when(~F.lower(F.trim(F.col(column))).isin("", "nan", "null"), F.col(column))
    s = F.from_json(text, SERIES)
    return F.transform(F.arrays_zip(s["index"], s["data"]), lambda x: F.struct(x["index"].cast("date").alias("date"), x["data"].alias("ret")))


def export_series(daily: DataFrame) -> DataFrame:
    """One JSON text of the series, with 10 decimals."""
    rows = F.sort_array(F.collect_list(F.struct("date", F.round("ret", 10).alias("ret"))))
    out = daily.agg(rows.alias("r"))
    return out.select(F.to_json(F.struct(F.lit("ret").alias("name"), F.transform("r", lambda x: x["date"].cast("timestamp")).alias("index"), F.transform("r", lambda x: x["ret"]).alias("data"))).alias("json"))


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a table of any schema version; readers merge schemas."""
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


@contextlib.contextmanager
def log_lock(path: str, shared: bool = False) -> Iterator[None]:
    """One writer at a time on this driver's machine, over read, check and append (S22); `shared` lets readers in together.
    Writers on other machines are not held: give them a log each, or a table format with commits."""
    import fcntl

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a") as f:
        fcntl.flock(f, fcntl.LOCK_SH if shared else fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def audit_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, NULL kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def load_report(panel: DataFrame) -> DataFrame:
    """Range, size and share of rows with volume."""
    return panel.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.avg((F.col("volume") > 0).cast("double")).alias("traded_share"))
