"""Normal distribution, Sharpe statistics and their corrections, as Columns where Spark can say it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
#: The coefficients of Acklam's rational approximation of the normal quantile, and its break point.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425

#: Hart's rational approximation of the normal tail, the place from which a continued fraction takes over, and the
#: square root of 2 pi.
HART_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_BREAK, HART_ROOT = 7.07106781186547, 2.506628274631


def norm_cdf(x: float) -> float:
    """F1, on the driver."""
    return math.erfc(-x / math.sqrt(2.0)) / 2.0


def norm_cdf_col(x: Column) -> Column:
    """F1 over a column: Spark has no error function. A rational approximation, good to 1e-14 in absolute terms; NULL for NULL."""
    z = F.abs(x)
    e = F.exp(-z * z / 2.0)
    far = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = z + k / far
    upper = F.when(z > 37, F.lit(0.0)).when(z < HART_BREAK, e * _poly(z, HART_P) / _poly(z, HART_Q)).otherwise(e / far / HART_ROOT)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def _poly(x: Column, coefficients, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out if last is None else out * x + last


def norm_ppf(p: Column) -> Column:
    """Normal quantile (F2); NULL outside (0, 1)."""
    q, low, high = p - 0.5, F.sqrt(-2.0 * F.ln(p)), F.sqrt(-2.0 * F.ln(1.0 - p))
    r = q * q
    tail = lambda t: _poly(t, ACKLAM_C) / _poly(t, ACKLAM_D, 1.0)
    return (
        F.when((p <= 0) | (p >= 1), None).when(p < ACKLAM_LOW, tail(low)).when(p > 1 - ACKLAM_LOW, -tail(high))
        .otherwise(_poly(r, ACKLAM_A) * q / _poly(r, ACKLAM_B, 1.0))
    )


def expected_max_sharpe(sigma: Column, n: Column) -> Column:
    """Greatest of n null Sharpe ratios with spread sigma, expected (F3); NULL for n below 2 or no spread."""
    n = n.cast("double")
    z = (1 - EULER_GAMMA) * norm_ppf(1 - F.try_divide(F.lit(1.0), n)) + EULER_GAMMA * norm_ppf(1 - F.try_divide(F.lit(1.0), n * math.e))
    return F.when((n >= 2) & (sigma > 0), sigma * z)


def deflated_z(sharpe: Column, hurdle: Column, days: Column | int = 1260, scale: float = 1.0) -> Column:
    """The z value of the deflated Sharpe ratio; deflated_sharpe() is its probability. `scale` turns yearly ratios into
    daily ones (1 / sqrt(252)); 1 keeps the published mixture of units."""
    s, t = sharpe * scale, days if isinstance(days, Column) else F.lit(days)
    return (s - hurdle * scale) * F.sqrt(t - 1.0) / F.sqrt(1 + 0.5 * s * s)


def deflated_sharpe(sharpe: Column, sigma: Column, n: Column, days: Column | int = 1260, scale: float = 1.0) -> Column:
    """The probability that the best of n trials with spread sigma is no chance (F4); NULL for n below 2 or no spread."""
    return norm_cdf_col(deflated_z(sharpe, expected_max_sharpe(sigma, n), days, scale))


def paired_sharpe_test(a: DataFrame, b: DataFrame, min_days: int = 30, days: int = 252) -> DataFrame:
    """Paired test of two Sharpe ratios on (date, ret) (F5, J6): n, both yearly ratios, z, and the one-sided p that the first is
    not greater; NULL if the variance is not positive or fewer than `min_days` dates have both."""
    j = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date").where("x is not null and y is not null")
    m = j.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.corr("x", "y").alias("rho"))
    sa, sb = F.try_divide("mx", F.nullif("sx", F.lit(0.0))), F.try_divide("my", F.nullif("sy", F.lit(0.0)))
    m = m.withColumns({"sa": sa, "sb": sb, "rho": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "rho"))})
    v = (2 - 2 * F.col("rho") + 0.5 * (F.col("sa") ** 2 + F.col("sb") ** 2) - 0.5 * F.col("sa") * F.col("sb") * (1 + F.col("rho") ** 2)) / F.col("n")
    m = m.withColumn("v", v)
    ok = (F.col("n") >= min_days) & (F.col("v") > 1e-18)
    year = math.sqrt(days)
    m = m.select("n", (F.col("sa") * year).alias("sharpe_a"), (F.col("sb") * year).alias("sharpe_b"), F.when(ok, (F.col("sa") - F.col("sb")) / F.sqrt("v")).alias("z"))
    return m.withColumn("p", 1.0 - norm_cdf_col(F.col("z")))


def correlations(series: DataFrame, min_overlap: int = 60) -> DataFrame:
    """Pairs a < b of (t, id, r) with enough common values and spread (J12): one join on t, one grouping."""
    s = series.where("r is not null")
    pairs = s.select("t", F.col("id").alias("a"), F.col("r").alias("x")).join(s.select("t", F.col("id").alias("b"), F.col("r").alias("y")), "t").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).where((F.col("n") >= min_overlap) & F.col("rho").isNotNull() & ~F.isnan("rho"))


def effective_trials(series: DataFrame, min_overlap: int = 60) -> DataFrame:
    """N / (1 + (N - 1) max(mean rho, 0)), held to 1..N; N without a valid pair."""
    n = series.agg(F.count_distinct("id").cast("double").alias("n"))
    mean = correlations(series, min_overlap).agg(F.avg("rho").alias("rho"))
    value = F.col("n") / (1 + (F.col("n") - 1) * F.greatest("rho", F.lit(0.0)))
    return n.crossJoin(mean).select("n", "rho", F.coalesce(F.greatest(F.lit(1.0), F.least("n", value)), "n").alias("effective_n"))
