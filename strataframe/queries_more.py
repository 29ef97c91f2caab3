"""More queries: whole results of runs, verdicts, the rest of the signals, null draws and sweeps, sources and sinks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .config import borrow_bps
from .functions import stats
from .operators import backtest as bt
from .operators import panel as pn
from .operators import signals as sg
from .operators import simulation as sim
from .operators import triallog as tl
from .plans import grader, reports
from .queries import _AUDIT, _CRET, _HEAD, _LOG, _PANELS, _SHARPE, CFG, ORACLES, QUERIES, _daily, _flat, _max_sharpe, _rank, query, r8
from .scratch import new_path
from .sources import io


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _cdf(x: str) -> str:
    z = f"abs({x})"
    far = f"({z} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k}.0::DOUBLE / {far})"
    e = f"exp(-{z} * {z} / 2.0::DOUBLE)"
    upper = f"CASE WHEN {z} > 37 THEN 0.0::DOUBLE WHEN {z} < {stats.HART_BREAK!r}::DOUBLE THEN {e} * {_horner(z, stats.HART_P)} / {_horner(z, stats.HART_Q)} ELSE {e} / {far} / {stats.HART_ROOT!r}::DOUBLE END"
    return f"CASE WHEN {x} > 0 THEN 1.0::DOUBLE - ({upper}) ELSE ({upper}) END"


def _normal(m: str, gross: float = 1.0) -> str:
    return f"round(coalesce({m} / nullif(sum({m}) OVER (PARTITION BY date), 0), 0) * {gross}::DOUBLE, 8) AS w"


# Statistics and verdicts.
@query(f"SELECT x, round({_cdf('x')}, 10) AS p FROM (SELECT CAST(range AS DOUBLE) / 50 - 10 AS x FROM range(0, 1001))", base="")
def norm_cdf(s, d):
    return s.range(1001).select((F.col("id").cast("double") / 50 - 10).alias("x")).withColumn("p", F.round(stats.norm_cdf_col(F.col("x")), 10))


_CROSS = f"""SELECT *, least(1.0, p_raw * k) AS p_adj FROM (SELECT *, count(*) OVER () AS k, greatest(0.0, least(1.0, 1.0 - {_cdf('z')})) AS p_raw FROM (
  SELECT *, (best_sharpe - sr0) * sqrt(1259.0::DOUBLE) / sqrt(1 + 0.5 * best_sharpe * best_sharpe) AS z FROM (SELECT *, {_max_sharpe("sigma", "n_live")} AS sr0 FROM (
    SELECT universe_tag, count(*) AS n_trials, count(*) FILTER (status <> 'crash') AS n_live, count(*) FILTER (status = 'keep') AS n_keeps, stddev_samp(oos_sharpe) FILTER (status <> 'crash') AS sigma,
    max(oos_sharpe) FILTER (status <> 'crash') AS best_sharpe, arg_max(commit, (oos_sharpe, -row_no)) FILTER (status <> 'crash') AS best_commit FROM log WHERE oos_sharpe IS NOT NULL GROUP BY 1))) WHERE n_live >= 2 AND z IS NOT NULL)"""


@query(f"SELECT universe_tag, n_trials, n_live, n_keeps, best_commit, round(p_raw, 8) AS p_raw, round(p_adj, 8) AS p_adj, CASE WHEN p_adj <= 0.05 THEN 'SURVIVES' ELSE 'NOT_SIGNIFICANT' END AS verdict FROM ({_CROSS})", base=_LOG)
def cross_universe(s, d):
    r = tl.cross_universe(fx.trial_log(s, d))
    return r.select("universe_tag", "n_trials", "n_live", "n_keeps", "best_commit", F.round("p_raw", 8).alias("p_raw"), F.round("p_adj", 8).alias("p_adj"), "verdict")


@query(f"SELECT row_no, round({_cdf('z')}, 8) AS psr FROM (SELECT row_no, (oos_sharpe - {_max_sharpe('sigma', 'n')}) * sqrt(1259.0::DOUBLE) / sqrt(1 + 0.5 * oos_sharpe * oos_sharpe) AS z FROM log JOIN (SELECT universe_tag, stddev_samp(oos_sharpe) AS sigma, count(oos_sharpe) AS n FROM log WHERE status <> 'crash' GROUP BY 1) USING (universe_tag) WHERE oos_sharpe IS NOT NULL)", base=_LOG)
def deflated_sharpe(s, d):
    log = fx.trial_log(s, d)
    return log.join(tl.pool(log, None), "universe_tag").where("oos_sharpe is not null").select("row_no", F.round(stats.deflated_sharpe(F.col("oos_sharpe"), F.col("sigma"), F.col("n")), 8).alias("psr"))


@query(_AUDIT + """, a AS (SELECT universe_tag, count(*) AS trials, count(*) FILTER (margin > 0) AS pass_plain, count(*) FILTER (margin - sr0 > 0) AS pass_deflated FROM audit GROUP BY 1),
each AS (SELECT universe_tag, coalesce(trials, 0) AS trials, coalesce(pass_plain, 0) AS pass_plain, coalesce(pass_deflated, 0) AS pass_deflated, keeps FROM (SELECT universe_tag, count(*) FILTER (status = 'keep') AS keeps FROM log GROUP BY 1) LEFT JOIN a USING (universe_tag))
SELECT coalesce(universe_tag, 'TOTAL') AS universe_tag, CAST(sum(trials) AS BIGINT) AS trials, CAST(sum(pass_plain) AS BIGINT) AS pass_plain, CAST(sum(pass_deflated) AS BIGINT) AS pass_deflated, CAST(sum(keeps) AS BIGINT) AS keeps, round(sum(pass_plain) / CAST(sum(trials) AS DOUBLE), 8) AS pass_plain_share, round(sum(pass_deflated) / CAST(sum(trials) AS DOUBLE), 8) AS pass_deflated_share FROM each GROUP BY ROLLUP (universe_tag)""", base=_LOG)
def gate_totals_all(s, d):
    log = fx.trial_log(s, d)
    return tl.gate_totals_all(tl.gate_audit(log), log).withColumns(r8("pass_plain_share", "pass_deflated_share"))


@query("SELECT arg_max(oos_sharpe, (oos_sharpe, -row_no)) FILTER (status = 'keep' AND oos_sharpe IS NOT NULL) AS best_sharpe, arg_max(commit, (oos_sharpe, -row_no)) FILTER (status = 'keep' AND oos_sharpe IS NOT NULL) AS best_commit, count(*) AS trials FROM log", base=_LOG)
def best_kept(s, d):
    return tl.best_kept(fx.trial_log(s, d))


@query("SELECT commit, max(row_no) AS row_no, arg_max(status, row_no) AS status FROM (SELECT 'c' || CAST(row_no % 300 AS VARCHAR) AS commit, row_no, status FROM log) GROUP BY 1", base=_LOG)
def latest_per_commit(s, d):
    log = fx.trial_log(s, d).withColumn("commit", F.concat(F.lit("c"), (F.col("row_no") % 300).cast("string")))
    return tl.latest_per_key(log, "commit").select("commit", "row_no", "status")


_RUNS = """, runs AS (SELECT l.*, oos_sharpe - 0.3::DOUBLE AS oos_sharpe_lo, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 100) / 50.0::DOUBLE - 0.5::DOUBLE END AS is_fold, (o_orderkey % 40) / 40.0::DOUBLE - 0.2::DOUBLE AS oos_fold, (o_orderkey % 30) / 30.0::DOUBLE - 0.1::DOUBLE AS worst,
  (o_custkey % 60) / 100.0::DOUBLE AS dd, (o_orderkey % 70)::DOUBLE AS turnover, o_custkey % 200 AS n_trades, CASE WHEN o_orderkey % 7 = 0 THEN (o_custkey % 30) / 100.0::DOUBLE END AS paired FROM log l JOIN orders ON o_orderkey = row_no),
base AS (SELECT universe_tag, arg_min(commit, row_no) AS bc, first(oos_sharpe ORDER BY row_no) AS bs, first(is_fold ORDER BY row_no) AS bf FROM runs WHERE status <> 'crash' GROUP BY 1),
chance AS (SELECT universe_tag, greatest(coalesce(""" + _max_sharpe("sigma", "n") + """, 0), 0) AS sr0 FROM (SELECT universe_tag, coalesce(stddev_samp(x), 0) AS sigma, greatest(count(x), 2) AS n FROM (SELECT universe_tag, CASE WHEN status <> 'crash' AND hurdle_version = '2' THEN oos_sharpe END AS x FROM log) GROUP BY 1)),
graded AS (SELECT universe_tag, commit, coalesce(bs, 0) + 0.15::DOUBLE + sr0 AS hurdle, coalesce(oos_sharpe > coalesce(bs, 0) + 0.15::DOUBLE + sr0, false) AS sharpe_over_hurdle, coalesce(paired <= 0.05, oos_sharpe_lo > bs, false) AS better_than_baseline,
  coalesce(CASE WHEN bf IS NULL THEN is_fold IS NOT NULL ELSE is_fold > bf + 0.1::DOUBLE END, false) AS is_fold_median, oos_fold > 0 AS oos_fold_median, worst > 0 AS worst_fold, dd <= 0.35::DOUBLE AS drawdown, turnover <= 50 AS turnover, n_trades >= 50 AS trades
  FROM runs JOIN base USING (universe_tag) JOIN chance USING (universe_tag) WHERE commit <> bc)
"""


@query(_RUNS + "SELECT universe_tag, commit, round(hurdle, 6) AS hurdle, sharpe_over_hurdle, better_than_baseline, is_fold_median, oos_fold_median, worst_fold, drawdown, turnover, trades, sharpe_over_hurdle AND better_than_baseline AND is_fold_median AND oos_fold_median AND worst_fold AND drawdown AND turnover AND trades AS passed FROM graded", base=_LOG)
def grade_gates(s, d):
    return grader.grade_gates(fx.run_metrics(s, d), CFG).withColumns(r8("hurdle", digits=6))


@query(_CRET + f""", m AS (SELECT count(*) AS n, avg(x.r) / stddev_samp(x.r) AS sa, avg(y.r) / stddev_samp(y.r) AS sb, corr(x.r, y.r) AS rho FROM cr x JOIN cr y ON x.date = y.date WHERE x.ticker = (SELECT max(ticker) FROM cr) AND y.ticker = (SELECT min(ticker) FROM cr) AND x.r IS NOT NULL AND y.r IS NOT NULL),
v AS (SELECT (sa - sb) / sqrt((2 - 2 * rho + 0.5 * (sa * sa + sb * sb) - 0.5 * sa * sb * (1 + rho * rho)) / n) AS z FROM m)
SELECT round(z, 6) AS z, round(1.0 - {_cdf("z")}, 6) AS p FROM v""")
def paired_p(s, d):
    x = pn.with_returns(fx.panel_compound(s, d)).select("date", F.col("ticker").alias("id"), F.col("ret1").alias("ret"))
    ends = x.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    pick = lambda e: x.join(F.broadcast(ends), F.col("id") == F.col(e)).select("date", "ret")
    return stats.paired_sharpe_test(pick("hi"), pick("lo")).select(F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


# Whole results of runs.
_BOOT = ORACLES["bootstrap_ci"].removeprefix(_PANELS).replace("SELECT round(quantile_cont(s, 0.05), 6) AS lo", ", ci AS (SELECT round(quantile_cont(s, 0.05), 6) AS lo")
_FOLD = "(SELECT round(median(sharpe) {f}, 6) FROM foldsharpe)"
_RESULT = _BOOT + f""")
SELECT round(oos_sharpe, 6) AS oos_sharpe, (SELECT lo FROM ci) AS oos_sharpe_lo, (SELECT hi FROM ci) AS oos_sharpe_hi, round(is_sharpe, 6) AS is_sharpe, round(max_drawdown, 6) AS max_drawdown, round(annual_return / max_drawdown, 4) AS calmar, num_trades,
  {_FOLD.format(f="")} AS median_fold_sharpe, (SELECT round(min(sharpe), 6) FROM foldsharpe) AS min_fold_sharpe, {_FOLD.format(f="FILTER (kind = 'IS')")} AS is_fold_median_sharpe, {_FOLD.format(f="FILTER (kind = 'OOS')")} AS oos_fold_median_sharpe,
  (SELECT round(sharpe, 6) FROM foldsharpe WHERE fold = 'is_1') AS is_1, (SELECT round(sharpe, 6) FROM foldsharpe WHERE fold = 'oos_2') AS oos_2, (SELECT round({_SHARPE.format(x="ex")}, 6) FROM oos WHERE year(date) = 2001) AS y2001, (SELECT count(*) FROM oos) AS series_days
FROM ({_HEAD})"""


def _run(s, d, weights=None, **k):
    p = _flat(s, d)
    return bt.run_backtest(sg.quad_reversal(p) if weights is None else weights(p), p, CFG, **k)


@query(_RESULT)
def run_backtest_row(s, d):
    r = _run(s, d)
    cells = [F.round(c, 6).alias(c) for c in ("oos_sharpe", "oos_sharpe_lo", "oos_sharpe_hi", "is_sharpe", "max_drawdown")]
    folds = [F.round(c, 6).alias(c) for c in ("median_fold_sharpe", "min_fold_sharpe", "is_fold_median_sharpe", "oos_fold_median_sharpe")]
    maps = [F.round(F.col("is_fold_sharpes")["is_1"], 6).alias("is_1"), F.round(F.col("oos_fold_sharpes")["oos_2"], 6).alias("oos_2"), F.round(F.col("yearly_sharpe")[2001], 6).alias("y2001")]
    return r.select(*cells, F.round("calmar", 4).alias("calmar"), "num_trades", *folds, *maps, F.size(io.parse_series()).cast("long").alias("series_days"))


@query("SELECT reason AS crash_reason, 'crash' AS status_hint, CAST(NULL AS DOUBLE) AS oos_sharpe, CAST(NULL AS DOUBLE) AS max_drawdown, CAST(0 AS BIGINT) AS num_trades, CAST(0 AS INTEGER) AS folds, '' AS series, k FROM (VALUES ('a', 'leverage above the limit'), ('b', 'frozen weights'), ('c', 'mostly missing weights')) t(k, reason)")
def crash_result(s, d):
    def bad(p):
        w = sg.equal_weight(p)
        one = lambda k, x: w.withColumn("w", x).withColumn("k", F.lit(k))
        return one("a", F.col("w") * 4).unionByName(one("b", F.lit(0.0))).unionByName(one("c", F.lit(None).cast("double")))

    r = _run(s, d, bad, by=("k",))
    return r.select("k", "crash_reason", "status_hint", "oos_sharpe", "max_drawdown", "num_trades", F.size("fold_sharpes").alias("folds"), F.col("oos_daily_returns_json").alias("series"))


@query("SELECT date, round(borrow * 2.0, 8) AS borrow FROM (" + ORACLES["borrow_cost"].removeprefix(_PANELS) + ")")
def borrow_tier(s, d):
    p = _flat(s, d)
    cfg = replace(CFG, borrow_bps=borrow_bps("sp600_2024"))
    return bt.strat_returns(sg.long_short(p), p, cfg).select("date", F.round("borrow", 8).alias("borrow"))


_MASK = "SELECT metric, '<hidden, SHOW_OOS=0>' AS value FROM (VALUES ('oos_sharpe'), ('oos_sharpe_ci'), ('max_drawdown'), ('annual_return'), ('annual_vol'), ('turnover_annual'), ('calmar'), ('median_fold_sharpe'), ('min_fold_sharpe'), ('oos_fold_median_sharpe'), ('oos_fold_min_sharpe'), ('is_1'), ('is_2'), ('oos_1'), ('oos_2')) t(metric)"
_OPEN = f"""SELECT 'is_sharpe' AS metric, printf('%.6f', is_sharpe) AS value FROM ({_HEAD}) UNION ALL SELECT 'num_trades', CAST(num_trades AS VARCHAR) FROM ({_HEAD})
UNION ALL SELECT 'is_fold_median_sharpe', printf('%.6f', median(sharpe)) FROM foldsharpe WHERE kind = 'IS' UNION ALL SELECT 'is_fold_min_sharpe', printf('%.6f', min(sharpe)) FROM foldsharpe WHERE kind = 'IS'
UNION ALL SELECT 'status_hint', CASE WHEN num_trades < 50 THEN 'crash' WHEN max_drawdown > 0.35 OR turnover_annual > 50 THEN 'force_discard' ELSE 'keep_eligible' END FROM ({_HEAD})"""


@query(f"{_MASK} UNION ALL {_OPEN}")
def summary_hidden(s, d):
    return reports.summary(_run(s, d), False)


@query(f"""{_OPEN} UNION ALL SELECT 'oos_sharpe', printf('%.6f', oos_sharpe) FROM ({_HEAD}) UNION ALL SELECT 'max_drawdown', printf('%.4f', max_drawdown) FROM ({_HEAD}) UNION ALL SELECT 'annual_return', printf('%.4f', annual_return) FROM ({_HEAD})
UNION ALL SELECT 'annual_vol', printf('%.4f', annual_vol) FROM ({_HEAD}) UNION ALL SELECT 'turnover_annual', printf('%.2f', turnover_annual) FROM ({_HEAD}) UNION ALL SELECT fold, printf('%.6f', sharpe) FROM foldsharpe
UNION ALL SELECT 'oos_sharpe_' || year(date), printf('%.6f', {_SHARPE.format(x="ex")}) FROM oos GROUP BY year(date)""")
def summary_shown(s, d):
    return reports.summary(_run(s, d), True).where("metric not in ('oos_sharpe_ci', 'calmar', 'median_fold_sharpe', 'min_fold_sharpe', 'oos_fold_median_sharpe', 'oos_fold_min_sharpe')")


@query("SELECT date, round(coalesce(last_value(irx IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) / 100.0::DOUBLE / 252, 0.03::DOUBLE / 252), 12) AS rf FROM (SELECT DISTINCT date FROM flat) LEFT JOIN (SELECT date, (sum(x) % 500) / 100.0::DOUBLE AS irx FROM li GROUP BY 1 HAVING sum(x) % 6 = 0) USING (date)")
def risk_free(s, d):
    return bt.risk_free(_flat(s, d), fx.rates(s, d), CFG).select("date", F.round("rf", 12).alias("rf"))


@query("SELECT round(1 - count(close) / CAST((SELECT count(*) FROM dense) AS DOUBLE), 10) AS null_share, true AS some FROM flat")
def null_share(s, d):
    w = _flat(s, d).select("date", "ticker", F.col("close").alias("w"))
    return bt.null_share(w).select(F.round("null_share", 10).alias("null_share"), (F.col("null_share") >= 0).alias("some"))


# Null draws and sweeps: the reversal strategy as SQL over any panel.
def _strategy(t: str, source: str, key: str = "", short: int = 21, long: int = 63, vol: int = 63, size: int = 63, threshold: float = 0.1, gross: float = 0.5) -> str:
    k = f"{key}, " if key else ""
    rank = lambda x: _rank(x).replace("PARTITION BY date", f"PARTITION BY {k}date")
    using = f"({k}ticker, label)"
    return f""", {t}_a AS (SELECT {k}date, ticker, c, c / nullif(lag(c, 1) OVER p, 0) - 1 AS ret1, c / nullif(lag(c, {short}) OVER p, 0) - 1 AS s1, c / nullif(lag(c, {long}) OVER p, 0) - 1 AS s2 FROM {source} WINDOW p AS (PARTITION BY {k}ticker ORDER BY date)),
{t}_b AS (SELECT *, CASE WHEN count(ret1) OVER w = {vol} THEN stddev_samp(ret1) OVER w END AS vol, CASE WHEN count(ret1) OVER v = {size} THEN stddev_samp(ret1) OVER v END AS size_vol FROM {t}_a WINDOW w AS (PARTITION BY {k}ticker ORDER BY date ROWS {vol - 1} PRECEDING), v AS (PARTITION BY {k}ticker ORDER BY date ROWS {size - 1} PRECEDING)),
{t}_c AS (SELECT *, s1 / nullif(vol, 0) AS s3, s2 / nullif(vol, 0) AS s4 FROM {t}_b),
{t}_d AS (SELECT *, ({rank("s1")}) AS r1, ({rank("s2")}) AS r2, ({rank("s3")}) AS r3, ({rank("s4")}) AS r4 FROM {t}_c),
{t}_e AS (SELECT *, (r1 + r2 + r3 + r4) / 4.0 AS m FROM {t}_d),
{t}_f AS (SELECT *, CASE WHEN ({rank("m")}) <= {threshold}::DOUBLE THEN coalesce(1 / nullif(size_vol, 0), 0) ELSE 0 END AS q FROM {t}_e),
{t}_g AS (SELECT {k}date, ticker, c, ret1, coalesce(q / nullif(sum(q) OVER (PARTITION BY {k}date), 0), 0) * {gross}::DOUBLE AS w, date - CAST((isodow(date) + 2) % 7 AS INTEGER) AS label, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS ends FROM {t}_f),
{t}_h AS (SELECT {k}ticker, ends AS label, arg_max(w, date) AS w FROM {t}_g GROUP BY {k}ticker, ends),
{t}_i AS (SELECT {k}date, ticker, ret1, CASE WHEN c IS NOT NULL THEN coalesce(h.w, 0) ELSE 0 END AS target FROM {t}_g LEFT JOIN {t}_h h USING {using}),
{t}_j AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY {k}ticker ORDER BY date), 0) AS w_eff FROM {t}_i),
{t}_k AS (SELECT *, abs(coalesce(w_eff - lag(w_eff) OVER (PARTITION BY {k}ticker ORDER BY date), 0)) AS dw FROM {t}_j),
{t}_l AS (SELECT {k}date, sum(w_eff * coalesce(ret1, 0)) - sum(dw * 0.0005::DOUBLE) - sum(greatest(-w_eff, 0)) * (200.0::DOUBLE / 1e4 / 252) - 0.03::DOUBLE / 252 AS ex FROM {t}_k GROUP BY {k}date),
{t} AS (SELECT {k}{_SHARPE.format(x="ex")} AS sharpe FROM {t}_l WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'{f" GROUP BY {key}" if key else ""})"""


_SHUFFLED = _CRET + """, s0 AS (SELECT date, ticker, c, c / nullif(lag(c) OVER p, 0) - 1 AS r, row_number() OVER p - 1 AS i, first_value(c) OVER p AS c0 FROM (SELECT * FROM cd WHERE c IS NOT NULL) WINDOW p AS (PARTITION BY ticker ORDER BY date)),
s1 AS (SELECT k, ticker, r AS mixed, row_number() OVER (PARTITION BY k, ticker ORDER BY CAST('0x' || substr(md5('20200101|' || k || '|' || ticker || '|' || i), 1, 8) AS BIGINT), i) AS i FROM s0 CROSS JOIN (SELECT range AS k FROM range(200)) WHERE i > 0),
s2 AS (SELECT k, date, ticker, c0 * product(1 + coalesce(mixed, 0)) OVER (PARTITION BY k, ticker ORDER BY i ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT k, s0.* FROM s0 CROSS JOIN (SELECT range AS k FROM range(200))) LEFT JOIN s1 USING (k, ticker, i)),
s3 AS (SELECT k, d.date, t.ticker, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY k, t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT DISTINCT date FROM s0) d CROSS JOIN (SELECT DISTINCT ticker FROM s0) t CROSS JOIN (SELECT range AS k FROM range(200)) LEFT JOIN s2 USING (k, date, ticker))"""
ORACLES["null_shuffle_p"] = _PANELS + _SHUFFLED + _strategy("null_", "s3", "k") + _strategy("real_", "cd") + """
SELECT (SELECT sharpe FROM real_) AS real, count(sharpe) AS draws, 200 - count(sharpe) AS failed, avg(sharpe) AS mean, stddev_samp(sharpe) AS sd, quantile_cont(sharpe, 0.05) AS p05, quantile_cont(sharpe, 0.95) AS p95, avg(CAST(sharpe >= (SELECT sharpe FROM real_) AS DOUBLE)) AS p,
  CASE WHEN avg(CAST(sharpe >= (SELECT sharpe FROM real_) AS DOUBLE)) <= 0.05 THEN 'REJECT_NULL' ELSE 'FAIL_TO_REJECT' END AS status FROM null_ WHERE sharpe IS NOT NULL"""
_ROUNDED = ("real", "mean", "sd", "p05", "p95")
ORACLES["null_shuffle_p"] = ORACLES["null_shuffle_p"].replace("SELECT (SELECT sharpe FROM real_) AS real, count(sharpe)", "SELECT round(real, 6) AS real, draws, failed, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p05, 6) AS p05, round(p95, 6) AS p95, p, status FROM (SELECT (SELECT sharpe FROM real_) AS real, count(sharpe)") + ")"

_MOVED = {"short": (21, 17, 25), "long": (63, 50, 76), "vol": (63, 50, 76), "size": (63, 50, 76), "threshold": (0.1, 0.08, 0.12), "gross": (0.5, 0.4, 0.6)}
_NAMES = {"vol": "vol_days", "size": "size_days"}
_VARIANTS = [("base", {})] + [(f"{_NAMES.get(n, n)}={v:g}", {n: v}) for n, (_, *vs) in _MOVED.items() for v in vs]
_SWEEP = "".join(_strategy(f"v{i}", "dense", **p) for i, (_, p) in enumerate(_VARIANTS)) + ", sweep AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy_id, sharpe FROM v{i}" for i, (n, _) in enumerate(_VARIANTS)) + ")"
ORACLES["sensitivity_sweep"] = _PANELS + _SWEEP + " SELECT strategy_id, round(sharpe, 6) AS sharpe, round(sharpe - (SELECT sharpe FROM v0), 6) AS delta FROM sweep"


@query(_SWEEP + " SELECT round(max(abs(sharpe - (SELECT sharpe FROM v0))), 6) AS max_abs_delta, round(stddev_pop(sharpe - (SELECT sharpe FROM v0)), 6) AS sd, count(sharpe) AS variants, max(abs(sharpe - (SELECT sharpe FROM v0))) > 0.3 AS fragile FROM sweep WHERE strategy_id <> 'base'")
def sensitivity_summary(s, d):
    sweep = sim.sensitivity(_flat(s, d), sg.quad_reversal, {"short": 21, "long": 63, "vol_days": 63, "size_days": 63, "threshold": 0.1, "gross": 0.5}, CFG)
    return sim.sensitivity_summary(sweep).withColumns(r8("max_abs_delta", "sd", digits=6))


# The rest of the signals.
@query("SELECT date, ticker, round((ret21 - avg(ret21) OVER x) / nullif(stddev_samp(ret21) OVER x, 0), 7) AS z FROM rets WINDOW x AS (PARTITION BY date)")
def zscore(s, d):
    return pn.with_returns(_flat(s, d), (21,)).select("date", "ticker", F.round(sg.zscore("ret21"), 7).alias("z"))


@query("SELECT date, ticker, round(greatest(least(w, 0.1), -0.1), 8) AS w FROM daily_w")
def capped(s, d):
    return sg.capped(sg.quad_reversal(_flat(s, d), weekly=False), 0.1).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m', 0.5)} FROM (SELECT date, ticker, CASE WHEN k <= 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank('e')} AS k FROM (SELECT date, ticker, round(ret21 - avg(ret21) OVER (PARTITION BY date), 12) AS e FROM rets)))")
def residual_reversal(s, d):
    p = pn.with_returns(_flat(s, d), (21,))
    p = p.withColumn("excess", F.round(F.col("ret21") - F.avg("ret21").over(pn.across()), 12)).withColumn("rank", pn.rank_average("excess"))
    return sg.sized(p, F.col("rank") <= 0.1, F.lit(1.0), 0.5).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN r2 IS NOT NULL THEN pow(1 - r2, 2.0) ELSE 0 END AS m FROM ranks)")
def soft_tilt(s, d):
    return sg.soft_tilt(_flat(s, d)).withColumns(r8("w"))


_ADV = "(SELECT date, ticker, CASE WHEN count(close * volume) OVER v >= 1 THEN avg(close * volume) OVER v END AS adv, CASE WHEN count(volume) OVER n >= 1 THEN avg(volume) OVER n END AS near, CASE WHEN count(volume) OVER f >= 1 THEN avg(volume) OVER f END AS far FROM dense WINDOW v AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), n AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), f AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING))"


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN k > 1 - 0.25 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank('adv')} AS k FROM {_ADV}))")
def liquid(s, d):
    return sg.liquid(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN adv > 0 THEN pow(adv, 0.5) ELSE 0 END AS m FROM {_ADV})")
def root_adv(s, d):
    return sg.adv_sized(_flat(s, d), power=0.5).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN k > 1 - 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank('e')} AS k FROM (SELECT date, ticker, near / nullif(far, 0) AS e FROM {_ADV})))")
def volume_surge(s, d):
    return sg.volume_surge(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN c IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS m FROM dense)")
def equal_weight(s, d):
    return sg.equal_weight(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN k > 1 - 0.1 THEN coalesce(1 / nullif(vol, 0), 0) ELSE 0 END AS m FROM (SELECT date, ticker, vol, {_rank('e')} AS k FROM (SELECT date, ticker, vol, mom / nullif(vol, 0) AS e FROM vols)))")
def vol_momentum(s, d):
    return sg.vol_momentum(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m', 0.5)} FROM (SELECT date, ticker, CASE WHEN k <= 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank('e')} AS k FROM (SELECT date, ticker, a + b + c - greatest(a, b, c) - least(a, b, c) AS e FROM (SELECT date, ticker, {_rank('ret5')} AS a, {_rank('ret21')} AS b, {_rank('ret63')} AS c FROM rets) WHERE true)))".replace("a + b + c - greatest(a, b, c) - least(a, b, c)", "CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN a + b + c - greatest(a, b, c) - least(a, b, c) END"))
def median_rank(s, d):
    return sg.median_rank(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m', 0.5)} FROM (SELECT date, ticker, CASE WHEN z < -1 THEN -z ELSE 0 END AS m FROM (SELECT date, ticker, (ret21 - avg(ret21) OVER x) / nullif(stddev_samp(ret21) OVER x, 0) AS z FROM rets WINDOW x AS (PARTITION BY date)))")
def z_reversal(s, d):
    return sg.z_reversal(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN round(near, 9) > round(far, 9) THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, CASE WHEN count(c) OVER n >= 50 THEN avg(c) OVER n END AS near, CASE WHEN count(c) OVER f >= 200 THEN avg(c) OVER f END AS far FROM dense WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING), f AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING)))")
def golden_cross(s, d):
    return sg.golden_cross(_flat(s, d)).withColumns(r8("w"))


@query(f"SELECT date, ticker, {_normal('m')} FROM (SELECT date, ticker, CASE WHEN k > 1 - 0.2 AND ret126 > 0 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, ret126, {_rank('ret126')} AS k FROM rets))")
def dual_momentum(s, d):
    return sg.dual_momentum(_flat(s, d)).withColumns(r8("w"))


_MARKET = "(SELECT date, mkt, 1 - mkt / nullif(max(mkt) OVER (ORDER BY date ROWS 251 PRECEDING), 0) AS drawdown FROM mkt)"


@query(f"SELECT date, round(drawdown, 8) AS drawdown, drawdown < 0.002 AS open, round(greatest(0, 1 - drawdown / 0.002::DOUBLE), 6) AS factor FROM {_MARKET} WHERE abs(drawdown - 0.002) > 1e-9")
def market_drawdown_gate(s, d):
    g = sg.market_drawdown_gate(fx.market_proxy(s, d), 0.002).where("abs(drawdown - 0.002D) > 1e-9")
    return g.select("date", F.round("drawdown", 8).alias("drawdown"), "open", F.round("factor", 6).alias("factor"))


@query("SELECT date, round(spread, 9) AS spread, coalesce(spread >= mean, true) AS open FROM (SELECT date, spread, avg(spread) OVER (ORDER BY date ROWS 251 PRECEDING) AS mean FROM (SELECT date, stddev_samp(ret21) AS spread FROM rets GROUP BY 1)) WHERE spread IS NULL OR mean IS NULL OR abs(spread - mean) > 1e-9")
def dispersion_gate(s, d):
    g = sg.dispersion_gate(_flat(s, d))
    mean = F.avg("spread").over(Window.orderBy("date").rowsBetween(-251, 0))
    return g.withColumn("mean", mean).where("spread is null or mean is null or abs(spread - mean) > 1e-9").select("date", F.round("spread", 9).alias("spread"), "open")


@query("SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) - arg_max(n, (-c, n)) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) AS since_low FROM (SELECT date, ticker, c, CASE WHEN c IS NOT NULL THEN row_number() OVER (PARTITION BY ticker ORDER BY date) END AS n FROM dense)".replace("arg_max(n, (-c, n)) OVER", "arg_max(n, CASE WHEN c IS NOT NULL THEN (-c, n) END) OVER"))
def days_since_low(s, d):
    return sg.days_since_low(_flat(s, d).select("date", "ticker", "close")).select("date", "ticker", F.col("since_low").cast("long").alias("since_low"))


@query(f"SELECT date, ticker, {_normal('m', 0.5)} FROM (SELECT date, ticker, CASE WHEN k <= 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank('e')} AS k FROM (SELECT r.date, r.ticker, round(ret21 - beta * mlong, 11) AS e FROM rets r JOIN ("
  "SELECT r.date, r.ticker, CASE WHEN count(CASE WHEN ret1 IS NOT NULL AND mret IS NOT NULL THEN 1 END) OVER w = 63 THEN covar_samp(ret1, mret) OVER w / nullif(var_samp(CASE WHEN ret1 IS NOT NULL THEN mret END) OVER w, 0) END AS beta, mlong FROM rets r LEFT JOIN (SELECT date, mkt / nullif(lag(mkt) OVER (ORDER BY date), 0) - 1 AS mret, mkt / nullif(lag(mkt, 21) OVER (ORDER BY date), 0) - 1 AS mlong FROM mkt) m ON r.date = m.date WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date ROWS 62 PRECEDING)) b ON r.date = b.date AND r.ticker = b.ticker)))")
def beta_neutral(s, d):
    return sg.beta_neutral_reversal(_flat(s, d), fx.market_proxy(s, d)).withColumns(r8("w"))


@query("SELECT date, ticker, round(w * coalesce(factor, 1), 8) AS w FROM daily_w LEFT JOIN (SELECT date, CASE WHEN count(ret) OVER v >= 63 THEN least(2.0, coalesce(0.06::DOUBLE / nullif(stddev_samp(ret) OVER v * sqrt(252.0::DOUBLE), 0), 1)) END AS factor FROM daily WINDOW v AS (ORDER BY date ROWS 62 PRECEDING)) USING (date)")
def vol_target(s, d):
    p = _flat(s, d)
    return sg.vol_target(sg.quad_reversal(p, weekly=False), bt.strat_returns(sg.quad_reversal(p), p, CFG)).withColumns(r8("w")).select("date", "ticker", "w")


@query("SELECT date, ticker, round(sum(w * pow(0.5::DOUBLE, -i / 3.0::DOUBLE)) OVER p / sum(pow(0.5::DOUBLE, -i / 3.0::DOUBLE)) OVER p, 7) AS w FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM daily_w) WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)")
def smoothed(s, d):
    return sg.smoothed(sg.quad_reversal(_flat(s, d), weekly=False)).select("date", "ticker", F.round("w", 7).alias("w"))


def _cadence(name: str, ends: str, seen: str):
    @query(f"SELECT a.date, a.ticker, round(coalesce(b.w, 0), 8) AS w FROM daily_w a LEFT JOIN (SELECT ticker, {ends} AS label, arg_max(w, date) AS w FROM daily_w GROUP BY 1, 2) b ON a.ticker = b.ticker AND b.label = {seen}")
    def f(s, d):
        return sg.rebalanced(sg.quad_reversal(_flat(s, d), weekly=False), name).withColumns(r8("w")).select("date", "ticker", "w")

    QUERIES[f"cadence_{name}"], ORACLES[f"cadence_{name}"] = QUERIES.pop("f"), ORACLES.pop("f")


_cadence("wednesday", "date + CAST((3 - isodow(date) + 7) % 7 AS INTEGER)", "a.date - CAST((isodow(a.date) + 4) % 7 AS INTEGER)")
_cadence("month", "CAST(date_trunc('month', date) AS DATE)", "CAST(date_trunc('month', a.date) - INTERVAL 1 MONTH AS DATE)")
_cadence("quarter", "CAST(date_trunc('quarter', date) AS DATE)", "CAST(date_trunc('quarter', a.date) - INTERVAL 3 MONTH AS DATE)")


# Sources and sinks, there and back.
@query("SELECT date, ticker, close, volume, mkt FROM flat JOIN mkt USING (date)")
def panel_store(s, d):
    path, market = new_path(s, "panel"), new_path(s, "market")
    io.write_panel(_flat(s, d), path)
    fx.market_proxy(s, d).write.parquet(market)
    assert io.exists(s, path, market) and not io.exists(s, path + "-none")
    return io.read_panel(s, path, ("close", "volume")).join(F.broadcast(io.read_market(s, market)), "date")


@query("SELECT ticker, date, close FROM dense WHERE ticker IN (SELECT DISTINCT ticker FROM flat)")
def wide_panel(s, d):
    names = sorted(r[0] for r in s.read.parquet(f"{d}/nation.parquet").select("n_name").collect())
    wide = pn.densify(_flat(s, d).select("date", "ticker", "close")).groupBy("date").pivot("ticker", names).agg(F.first("close"))
    return io.from_wide(wide, "close").select("ticker", "date", "close")


@query("SELECT date, ticker, CASE WHEN day(date) % 2 = 0 THEN close ELSE close + 1 END AS close FROM flat WHERE ticker < 'F' UNION ALL SELECT date, ticker, close + 1 FROM flat WHERE ticker >= 'F' AND false UNION ALL SELECT date, ticker, close + 2 FROM flat WHERE ticker >= 'F'")
def batches(s, d):
    p = _flat(s, d).select("date", "ticker", "close")
    first = p.where("ticker < 'F'").withColumn("close", F.when(F.day("date") % 2 == 0, F.col("close")).otherwise(F.col("close") + 1))
    asked = p.select("ticker").distinct()
    return io.assemble(asked, first, lambda t: p.join(t, "ticker", "left_semi").withColumn("close", F.col("close") + 2).select("date", "ticker", "close"))[0]


@query("SELECT row_no, commit, round(oos_sharpe, 7) AS oos_sharpe, upper(status) AS status FROM log", base=_LOG)
def results_log(s, d):
    path = new_path(s, "results")
    log = fx.trial_log(s, d).select("commit", F.format_string("%.7f", "oos_sharpe").alias("oos_sharpe"), F.col("row_no").cast("string").alias("max_dd"), F.lit("x").alias("turnover"), F.concat(F.lit(" "), F.upper("status")).alias("status"), F.lit("thesis: t").alias("description"))
    log.write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="null")
    return io.read_results(s, path).select(F.col("max_dd").cast("int").alias("row_no"), "commit", F.round("oos_sharpe", 7).alias("oos_sharpe"), F.upper("status").alias("status"))


@query("SELECT date, round(ret, 10) AS ret FROM oos")
def series_json(s, d):
    text = io.export_series(_daily(s, d).where(bt.out_of_sample(CFG))).withColumnRenamed("json", "oos_daily_returns_json")
    return text.select(F.inline(io.parse_series())).select("date", "ret")


@query("SELECT universe_tag, CAST(count(*) AS BIGINT) AS n, CAST(count(oos_sharpe) AS BIGINT) AS with_sharpe FROM log GROUP BY 1", base=_LOG)
def audit_sink(s, d):
    path = new_path(s, "audit")
    io.audit_json(fx.trial_log(s, d).select("universe_tag", "oos_sharpe")).write.text(path)
    back = s.read.text(path).select(F.from_json("value", "universe_tag string, oos_sharpe double").alias("j")).select("j.*")
    return back.groupBy("universe_tag").agg(F.count("*").alias("n"), F.count("oos_sharpe").alias("with_sharpe"))


@query("SELECT p_partkey AS row_no, lower(trim('thesis: ' || p_type || ' size ' || p_size)) LIKE 'thesis:%' AS has_thesis, 'thesis: ' || p_type || ' size ' || p_size LIKE '%' || chr(9) || '%' AS bad, sha256('thesis: ' || p_type || ' size ' || p_size) AS digest FROM part", base="")
def description_rules(s, d):
    x = fx.descriptions(s, d)
    return x.select("row_no", F.lower(F.trim("description")).startswith("thesis:").alias("has_thesis"), F.col("description").contains("\t").alias("bad"), F.sha2("description", 256).alias("digest"))
