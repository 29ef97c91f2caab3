"""Relational analytics of the append-only trial log; `row_no` is the order of the file and breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import deflated_z, expected_max_sharpe, norm_cdf_col

_ORDER = ("written_at", "row_no")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def latest_per_key(log: DataFrame, key: str) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), "row_no").alias("r")).select("r.*")


def earliest_duplicate(cache: DataFrame, probe: DataFrame) -> DataFrame:
    """The first cached trial with the same hash and another commit, for each probe (J10); a null hash has none.

    That is the first trial of the hash, or, for probes of its own commit, the first one of another commit: two rows a hash,
    so the join is linear in the log however many trials share a hash.
    """
    trial = F.struct(F.col("branch_tag").alias("seen_branch"), F.col("commit").alias("seen_commit"))
    c = cache.where("ast_sha256 is not null and commit is not null")
    first = c.groupBy("ast_sha256").agg(F.min_by(trial, "row_no").alias("first"))
    other = c.join(first, "ast_sha256").where(F.col("commit") != F.col("first.seen_commit")).groupBy("ast_sha256").agg(F.min_by(trial, "row_no").alias("other"))
    found = F.when(F.col("commit") != F.col("first.seen_commit"), F.col("first")).otherwise(F.col("other"))
    hits = probe.select("commit", "ast_sha256").where("commit is not null").distinct().join(first, "ast_sha256").join(other, "ast_sha256", "left")
    return hits.select("commit", "ast_sha256", found.alias("f")).where("f is not null").select("commit", "ast_sha256", "f.*")


def seeds(log: DataFrame, by: tuple[str, ...] = ("branch_tag",)) -> DataFrame:
    """First non-null commit and Sharpe of each branch, each column on its own."""
    order = F.struct(*_ORDER)
    return log.groupBy(*by).agg(F.min_by("commit", F.when(F.col("commit").isNotNull(), order)).alias("seed_commit"), F.min_by("oos_sharpe", F.when(F.col("oos_sharpe").isNotNull(), order)).alias("seed_sharpe"))


def baseline(results: DataFrame) -> DataFrame:
    """The first row that is no crash."""
    return results.where("status <> 'crash'").orderBy("row_no").limit(1)


def repaired(results: DataFrame, oos_log: DataFrame) -> DataFrame:
    """Results with the Sharpe of the latest out-of-sample row of the commit, unless that is missing or zero."""
    true = latest_per_key(oos_log, "commit").select("commit", F.col("oos_sharpe").alias("true_sharpe"))
    good = finite(F.col("true_sharpe")) & (F.col("true_sharpe") != 0)
    return results.join(true, "commit", "left").withColumn("oos_sharpe", F.when(good, F.col("true_sharpe")).otherwise(F.col("oos_sharpe"))).drop("true_sharpe")


def running_best(log: DataFrame, by: tuple[str, ...] = (), stretch: int = 1_000_000) -> DataFrame:
    """Kept trials in order with the best so far and the change against the kept one before (W11, W12), each group of `by`
    on its own. The log is cut into stretches of `stretch` row numbers, so that no sequence, however long, is one task: what
    a stretch takes over from those before it is a row a stretch."""
    kept = log.where((F.col("status") == "keep") & F.col("oos_sharpe").isNotNull()).withColumn("__at", F.floor(F.col("row_no") / stretch))
    w = Window.partitionBy(*by, "__at").orderBy("row_no")
    ends = kept.groupBy(*by, "__at").agg(F.max("oos_sharpe").alias("best"), F.max_by("oos_sharpe", "row_no").alias("last"))
    order = Window.partitionBy(*by).orderBy("__at")
    ends = ends.select(*by, "__at", F.max("best").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__best"), F.lag("last").over(order).alias("__last"))
    rows = kept.withColumns({"__max": F.max("oos_sharpe").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__lag": F.lag("oos_sharpe").over(w)}).join(ends, [*by, "__at"])
    rows = rows.withColumns({"best": F.greatest("__max", "__best"), "delta": F.col("oos_sharpe") - F.coalesce("__lag", "__last")})
    return rows.select(*log.columns, "best", "delta")


def best_kept(log: DataFrame) -> DataFrame:
    """The kept trial with the greatest ratio, the earliest of several, and the number of rows of the log (X9); one row, NULL
    where nothing is kept."""
    use = (F.col("status") == "keep") & finite(F.col("oos_sharpe"))
    best = F.max_by(F.struct("oos_sharpe", "commit"), F.when(use, F.struct("oos_sharpe", (-F.col("row_no")).alias("r"))))
    return log.agg(best.alias("b"), F.count("*").alias("trials")).select(F.col("b.oos_sharpe").alias("best_sharpe"), F.col("b.commit").alias("best_commit"), "trials")


def pool(log: DataFrame, version: str | None = "2", by: tuple[str, ...] = ("universe_tag",)) -> DataFrame:
    """Spread and number of finite non-crash Sharpe ratios of a hurdle version (A16): 0 and at least 2."""
    use = finite(F.col("oos_sharpe")) & (F.col("status") != "crash")
    if version is not None:
        use = use & (F.col("hurdle_version") == version)
    x = F.when(use, F.col("oos_sharpe"))
    return log.groupBy(*by).agg(F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sigma"), F.greatest(F.count(x), F.lit(2)).alias("n"))


def gate_audit(log: DataFrame, version: str = "2", hurdle: float = 0.15) -> DataFrame:
    """Each trial against its seed's hurdle, with and without deflation by the pool of earlier trials.

    The pool is a running window by universe, so the audit is linear in the log. Seed rows and rows without a finite
    Sharpe are judged by none.
    """
    of_seed = seeds(log, ("universe_tag", "branch_tag"))
    before = Window.partitionBy("universe_tag").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    use = finite(F.col("oos_sharpe")) & (F.col("status") != "crash") & (F.col("hurdle_version") == version)
    x = F.when(use, F.col("oos_sharpe"))
    rows = log.withColumns({"sigma": F.coalesce(F.stddev_samp(x).over(before), F.lit(0.0)), "n": F.greatest(F.count(x).over(before), F.lit(2))})
    rows = rows.join(of_seed, ["universe_tag", "branch_tag"]).where(finite(F.col("oos_sharpe")) & finite(F.col("seed_sharpe")) & (F.col("commit") != F.col("seed_commit")))
    rows = rows.withColumn("sr0", F.greatest(F.coalesce(expected_max_sharpe(F.col("sigma"), F.col("n")), F.lit(0.0)), F.lit(0.0)))
    plain = F.col("seed_sharpe") + hurdle
    return rows.withColumns({"margin": F.col("oos_sharpe") - plain, "margin_deflated": F.col("oos_sharpe") - plain - F.col("sr0")})


def gate_totals(audit: DataFrame) -> DataFrame:
    """Trials, passes and quantiles by universe."""
    q = lambda c, p: F.percentile(F.col(c), F.lit(p))
    return audit.groupBy("universe_tag").agg(
        F.count("*").alias("trials"), F.count_if(F.col("margin") > 0).alias("pass_plain"), F.count_if(F.col("margin_deflated") > 0).alias("pass_deflated"),
        F.avg("sr0").alias("sr0_mean"), q("sr0", 0.5).alias("sr0_median"), q("sr0", 0.9).alias("sr0_p90"), q("margin_deflated", 0.5).alias("margin_median"),
    )


def gate_totals_all(audit: DataFrame, log: DataFrame) -> DataFrame:
    """Trials and passes of each universe and of all together (universe_tag TOTAL), as shares too, and the trials kept."""
    sums = lambda df, *a: df.groupBy("universe_tag").agg(*a)
    a = sums(audit, F.count("*").alias("trials"), F.count_if(F.col("margin") > 0).alias("pass_plain"), F.count_if(F.col("margin_deflated") > 0).alias("pass_deflated"))
    both = sums(log, F.count_if(F.col("status") == "keep").alias("keeps")).join(a, "universe_tag", "left").na.fill(0)
    names = ("trials", "pass_plain", "pass_deflated", "keeps")
    out = both.rollup("universe_tag").agg(*[F.sum(c).alias(c) for c in names]).withColumn("universe_tag", F.coalesce("universe_tag", F.lit("TOTAL")))
    return out.withColumns({f"{c}_share": F.try_divide(F.col(c).cast("double"), F.col("trials")) for c in ("pass_plain", "pass_deflated")})


def cross_universe(log: DataFrame, alpha: float = 0.05, days: int = 1260, scale: float = 1.0) -> DataFrame:
    """universe_report() of the universes with a usable cohort, with the chance p_raw that the best is luck, p_adj = K p_raw for
    the K universes, and the verdict, the most certain first (X6, A25, T2)."""
    r = universe_report(log, days, scale).where((F.col("n_live") >= 2) & F.col("z").isNotNull())
    r = r.withColumn("p_raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - norm_cdf_col(F.col("z"))))).withColumn("p_adj", F.least(F.lit(1.0), F.col("p_raw") * F.col("cohorts")))
    return r.withColumn("verdict", F.when(F.col("p_adj") <= alpha, "SURVIVES").otherwise("NOT_SIGNIFICANT")).orderBy("p_adj", "universe_tag")


def universe_report(log: DataFrame, days: int = 1260, scale: float = 1.0) -> DataFrame:
    """Best trial of each universe, its deflated z and the number of usable cohorts (X6, A24, A25); probabilities follow
    from z on the few rows of the report."""
    live = log.where(finite(F.col("oos_sharpe")))
    crash = F.col("status") == "crash"
    x = F.when(~crash, F.col("oos_sharpe"))
    g = live.groupBy("universe_tag").agg(
        F.count("*").alias("n_trials"), F.count(x).alias("n_live"), F.count_if(F.col("status") == "keep").alias("n_keeps"), F.stddev_samp(x).alias("sigma"),
        F.max_by(F.when(~crash, F.struct("oos_sharpe", "commit")), F.when(~crash, F.struct("oos_sharpe", (-F.col("row_no")).alias("r")))).alias("b"),
    )
    g = g.select("universe_tag", "n_trials", "n_live", "n_keeps", "sigma", F.col("b.oos_sharpe").alias("best_sharpe"), F.col("b.commit").alias("best_commit"))
    g = g.withColumn("sr0", expected_max_sharpe(F.col("sigma"), F.col("n_live"))).withColumn("z", deflated_z(F.col("best_sharpe"), F.col("sr0"), days, scale))
    return g.withColumn("cohorts", F.count_if((F.col("n_live") >= 2) & F.col("z").isNotNull()).over(Window.partitionBy()))


def status_counts(log: DataFrame) -> DataFrame:
    """Rows by upper-case status and the share of kept among kept and discarded."""
    s = F.upper(F.trim("status"))
    kept = F.try_divide(F.count_if(s == "KEEP").cast("double"), F.count_if(s.isin("KEEP", "DISCARD")))
    rate = log.agg(kept.alias("keep_rate"))
    return log.groupBy(s.alias("status")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(rate))


def sweep_shapes(log: DataFrame, text: str = "description") -> DataFrame:
    """Groups of at least two descriptions that differ in numbers only."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\bthesis:\s*", ""), r"-?\d+(\.\d+)?", "N"), r"\s+", " ")
    return log.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row")).where("n >= 2")


def histogram(values: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts in equal bins from least to greatest, the last one closed."""
    v = values.where(finite(F.col(column)))
    span = v.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(F.try_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return v.crossJoin(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
