"""Grading of one run (X4): text rules, cap, duplicates, metrics, eight gates. The frames give one row each; the rule is plain."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions.stats import expected_max_sharpe, norm_cdf, paired_sharpe_test
from ..operators.triallog import baseline, earliest_duplicate, latest_per_key, pool


@dataclass
class Verdict:
    code: int
    status: str
    message: str
    gates: dict[str, bool] = field(default_factory=dict)


def spec_hash(spec: dict | None) -> str | None:
    """SHA-256 of the canonical JSON of a strategy's named parameters (X12, F14); None stays None and is never a duplicate."""
    return None if spec is None else hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def bad_description(text: str) -> str | None:
    """F11."""
    if "\t" in text or "\n" in text:
        return "the description holds a tab or a line break"
    return None


def has_thesis(text: str) -> bool:
    return text.strip().lower().startswith("thesis:")


def gates(row: dict, base: dict, hurdle: float, z: float | None, cfg: BacktestConfig) -> dict[str, bool]:
    """Eight gates; all must hold (X4b). A missing value fails its gate. Without a paired test the interval's lower end
    must lie above the baseline."""
    def over(value, limit):
        return value is not None and limit is not None and value > limit

    def upto(value, limit):
        return value is not None and value <= limit

    base_fold = base.get("is_fold_median_sharpe")
    better = (1 - norm_cdf(z) <= cfg.p_limit) if z is not None else over(row.get("oos_sharpe_lo"), base.get("oos_sharpe"))
    return {
        "sharpe_over_hurdle": over(row.get("oos_sharpe"), hurdle),
        "better_than_baseline": better,
        "is_fold_median": over(row.get("is_fold_median_sharpe"), float("-inf") if base_fold is None else base_fold + cfg.fold_margin),
        "oos_fold_median": over(row.get("oos_fold_median_sharpe"), 0.0),
        "worst_fold": over(row.get("min_fold_sharpe"), 0.0),
        "drawdown": upto(row.get("max_drawdown"), cfg.max_drawdown),
        "turnover": upto(row.get("turnover_annual"), cfg.max_turnover),
        "trades": row.get("num_trades") is not None and row["num_trades"] >= cfg.min_trades,
    }


def grade_gates(runs: DataFrame, cfg: BacktestConfig, by: tuple[str, ...] = ("universe_tag",)) -> DataFrame:
    """The eight gates of every run against the first run of its group that is no crash, as one plan: the group's hurdle, a
    column for each gate and `passed`. A column `paired_p`, where there is one and not NULL, takes the place of the interval's
    lower end. Baselines themselves are not graded; missing values fail their gate (X4b)."""
    live = runs.where("status <> 'crash'")
    first = F.min_by(F.struct(F.col("commit").alias("base_commit"), F.col("oos_sharpe").alias("base_sharpe"), F.col("is_fold_median_sharpe").alias("base_fold")), "row_no")
    base = live.groupBy(*by).agg(first.alias("b")).select(*by, "b.*")
    chance = pool(runs, cfg.hurdle_version, by).select(*by, F.coalesce(expected_max_sharpe(F.col("sigma"), F.col("n")), F.lit(0.0)).alias("sr0"))
    r = runs.join(base.join(chance, list(by)), list(by)).where(F.col("commit") != F.col("base_commit"))
    r = r.withColumn("hurdle", F.coalesce("base_sharpe", F.lit(0.0)) + cfg.hurdle + F.greatest("sr0", F.lit(0.0)))
    better = F.col("oos_sharpe_lo") > F.col("base_sharpe")
    checks = {
        "sharpe_over_hurdle": F.col("oos_sharpe") > F.col("hurdle"),
        "better_than_baseline": F.coalesce(F.col("paired_p") <= cfg.p_limit, better) if "paired_p" in runs.columns else better,
        "is_fold_median": F.when(F.col("base_fold").isNull(), F.col("is_fold_median_sharpe").isNotNull()).otherwise(F.col("is_fold_median_sharpe") > F.col("base_fold") + cfg.fold_margin),
        "oos_fold_median": F.col("oos_fold_median_sharpe") > 0, "worst_fold": F.col("min_fold_sharpe") > 0, "drawdown": F.col("max_drawdown") <= cfg.max_drawdown,
        "turnover": F.col("turnover_annual") <= cfg.max_turnover, "trades": F.col("num_trades") >= cfg.min_trades,
    }
    r = r.select(*by, "commit", "hurdle", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    passed = F.col("trades")
    for n in list(checks)[:-1]:
        passed = passed & F.col(n)
    return r.withColumn("passed", passed)


def deflated_hurdle(log: DataFrame, base_sharpe: float, cfg: BacktestConfig) -> float:
    """Baseline, plus the fixed hurdle, plus what the best of the pool would reach by chance."""
    row = pool(log, cfg.hurdle_version, ()).select(expected_max_sharpe(F.col("sigma"), F.col("n")).alias("sr0")).first()
    return base_sharpe + cfg.hurdle + max(row["sr0"] or 0.0, 0.0)


def grade(commit: str, description: str, ast_sha256: str | None, results: DataFrame, cache: DataFrame, oos_log: DataFrame, cfg: BacktestConfig, series=None) -> Verdict:
    """Order of rules: text (2), cap (4), duplicate (3), no metrics (5, crash), thesis (2), gates (0). `series` maps a commit
    to its (date, ret) frame, or None. Appending is the caller's, under one lock with this read."""
    if problem := bad_description(description):
        return Verdict(2, "invalid", problem)
    if results.count() >= cfg.trial_cap:
        return Verdict(4, "capped", "the branch has used its trials")
    if ast_sha256 is not None:
        probe = cache.sparkSession.createDataFrame([(commit, ast_sha256)], "commit string, ast_sha256 string")
        if hit := earliest_duplicate(cache, probe).first():
            return Verdict(3, "duplicate", f"seen as {hit['seen_commit']} on {hit['seen_branch']}")
    row = latest_per_key(oos_log.where(F.col("commit") == commit), "commit").first()
    if row is None:
        return Verdict(5, "crash", "the run left no metrics")
    if not has_thesis(description):
        return Verdict(2, "invalid", "the description must start with thesis:")
    row = row.asDict()
    if row.get("status_hint") == "crash":
        return Verdict(0, "discard", "the backtest crashed")
    first = baseline(results).first()
    if first is None:
        return Verdict(0, "keep", "the first run is the baseline")
    found = latest_per_key(oos_log.where(F.col("commit") == first["commit"]), "commit").first()
    base = found.asDict() if found else {}
    if base.get("oos_sharpe") is None:
        base["oos_sharpe"] = first["oos_sharpe"]
    a, b = (series(commit), series(first["commit"])) if series else (None, None)
    z = paired_sharpe_test(a, b).first()["z"] if a is not None and b is not None else None
    checks = gates(row, base, deflated_hurdle(cache, base["oos_sharpe"] or 0.0, cfg), z, cfg)
    failed = [k for k, ok in checks.items() if not ok]
    return Verdict(0, "discard" if failed else "keep", "failed: " + ", ".join(failed) if failed else "all gates hold", checks)
