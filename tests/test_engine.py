"""Panel, signal, backtest, statistics, log and grader rules on hand-made cases, and every query against its SQL."""

import json
import math
import os
import random
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from strataframe import fixtures as fx
from strataframe import scratch
from strataframe.config import BacktestConfig, borrow_bps
from strataframe.functions import stats
from strataframe.operators import backtest as bt
from strataframe.operators import panel as pn
from strataframe.operators import signals as sg
from strataframe.operators import simulation as sim
from strataframe.operators import triallog as tl
from strataframe.plans import grader, reports
from strataframe.plans.budget import TimeBudget, result_of
from strataframe.queries import ORACLES, QUERIES
from strataframe.sources import io, logs

CFG = fx.CONFIG
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None or a != a) and (b is None or b != b) or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return str(a).removesuffix(" 00:00:00") == str(b).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", [n for n in ORACLES if n in ("quad_composite_weights", "bottom_k_weights", "strat_returns", "annual_stats", "fold_medians", "bootstrap_ci", "gate_audit_totals", "universe_report", "effective_n", "sweep_shapes", "membership_mask", "duplicate_ast", "status_counts", "frontier", "pool_sigma", "gate_audit", "grade_gates", "cross_universe", "gate_totals_all", "run_backtest_row", "crash_result", "summary_shown", "results_log", "panel_store", "vol_target", "days_since_low", "sensitivity_summary")])
def test_query_matches_sql(spark, sf_dir, db, name):
    rel = db.sql(ORACLES[name])
    key = lambda r: [f"{x:.4f}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00") for x in r]
    got = sorted([tuple(r[c] for c in rel.columns) for r in QUERIES[name](spark, sf_dir).collect()], key=key)
    want = sorted(rel.fetchall(), key=key)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def prices(spark, values, ticker="A", start="2024-03-25"):
    return spark.createDataFrame([(i, ticker, None if v is None else float(v)) for i, v in enumerate(values)], "i int, ticker string, close double").select(F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"), "ticker", "close")


def test_padded_change(spark):
    got = [r["ret1"] for r in pn.with_returns(prices(spark, [100, None, 110, None])).orderBy("date").collect()]
    assert got[0] is None and [round(x, 9) for x in got[1:]] == [0.0, 0.1, 0.0]


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("d", 1.0)], "ticker string, x double").withColumn("date", F.lit("2024-01-01").cast("date"))
    assert {r["ticker"]: r["r"] for r in df.withColumn("r", pn.rank_average("x")).collect()} == {"a": 1.0, "b": 0.5, "c": None, "d": 0.5}


def test_rolling_needs_all_values(spark):
    got = [r["s"] for r in prices(spark, [1, 2, None, 4]).withColumn("s", pn.rolling(F.stddev_samp, "close", 2)).orderBy("date").collect()]
    assert got[0] is None and round(got[1], 4) == 0.7071 and got[2:] == [None, None]


def test_friday_holiday_is_seen_on_monday(spark):
    df = prices(spark, [1, 2, 3, 4, None, None, None, 9]).where("close is not null").withColumnRenamed("close", "w")
    assert [r["w"] for r in pn.weekly_last(df).orderBy("date").collect()] == [0.0, 0.0, 0.0, 0.0, 4.0]


def test_hold_mask_lag(spark):
    p = prices(spark, [None, 10, 11, 12, 13])
    w = prices(spark, [1, None, None, 0.5, None]).withColumnRenamed("close", "w")
    e = bt.effective_weights(w, p, CFG).orderBy("date").collect()
    assert [r["target"] for r in e] == [0, 1, 1, 0.5, 0.5] and [r["w_eff"] for r in e] == [0, 0, 1, 1, 0.5] and [r["dw"] for r in e] == [0, 0, 1, 0, 0.5]


def test_scaling_and_zero_weights(spark, sf_dir):
    p = fx.panel_compound(spark, sf_dir).where("date < DATE'1996-06-01'")
    w = sg.residual_reversal(p)
    total = lambda x: bt.strat_returns(x, p, CFG).agg(F.sum("ret"), F.sum("cost")).first()
    one, two, none = total(w), total(w.withColumn("w", F.col("w") * 2)), total(w.withColumn("w", F.lit(0.0)))
    assert math.isclose(2 * one[0], two[0], rel_tol=1e-9) and math.isclose(2 * one[1], two[1], rel_tol=1e-9) and none[0] == 0


@pytest.mark.parametrize("name", [n for n in sg.SIGNALS if n not in ("liquid", "momentum")])
def test_no_look_ahead(spark, sf_dir, name):
    p, cut = fx.panel_flat(spark, sf_dir).where("date < DATE'1996-01-01'"), "1995-09-15"
    f = sg.SIGNALS[name]
    a = {(r["date"], r["ticker"]): r["w"] for r in f(p).where(F.col("date") <= cut).collect()}
    b = {(r["date"], r["ticker"]): r["w"] for r in f(p.where(F.col("date") <= cut)).collect()}
    assert all(math.isclose(a[k], v, abs_tol=1e-12) for k, v in b.items())


def test_oracle_sign_earns_nothing_after_the_lag(spark):
    p = fx.panel_compound(spark, "/root/testdata/sf0.01")
    free = replace(CFG, cost_bps=0.0, borrow_bps=0.0)  # costs alone would make it lose
    daily = bt.with_excess(bt.strat_returns(sg.oracle_sign(p), p, free), CFG)
    assert abs(bt.headline(daily, CFG).first()["oos_sharpe"]) <= 2.5


def test_degenerate_metrics(spark):
    df = spark.createDataFrame([(0.01,)] * 5, "ex double")
    assert df.agg(bt.sharpe(F.col("ex")).alias("s")).first()["s"] in (None,) or abs(df.agg(F.stddev_samp("ex")).first()[0]) < 1e-12
    assert df.limit(1).agg(bt.sharpe(F.col("ex")).alias("s")).first()["s"] is None


def test_run_backtest_of_many(spark, sf_dir):
    p = fx.panel_flat(spark, sf_dir)
    both = sg.residual_reversal(p).withColumn("strategy_id", F.lit("a")).unionByName(sg.residual_reversal(p).withColumn("w", F.lit(0.0)).withColumn("strategy_id", F.lit("b")))
    out = {r["strategy_id"]: r for r in bt.run_backtest(both, p, CFG, ("strategy_id",)).collect()}
    assert out["b"]["status_hint"] == "crash" and out["b"]["crash_reason"] == "frozen weights" and out["a"]["crash_reason"] is None
    assert set(out["a"]["fold_sharpes"]) == {"is_1", "is_2", "oos_1", "oos_2"} and set(out["a"]["yearly_sharpe"]) == {2000, 2001}


def test_guards_and_impact(spark, sf_dir):
    p = fx.panel_flat(spark, sf_dir)
    w = sg.residual_reversal(p).withColumn("w", F.col("w") * 20)
    g = bt.guards(w, bt.strat_returns(w, p, CFG), CFG).first()
    assert g["crash_reason"] == "leverage above the limit"
    flat = bt.strat_returns(w, p, CFG).agg(F.sum("cost")).first()[0]
    assert bt.strat_returns(w, p, replace(CFG, impact_slope_bps=20.0)).agg(F.sum("cost")).first()[0] > flat
    assert borrow_bps("xbi_2026") == 600.0 and borrow_bps("xlk_2026") == borrow_bps(None) == 200.0


def test_risk_free_is_no_asof_join(spark):
    cal = prices(spark, [1, 1, 1, 1], start="2024-01-05").where("dayofweek(date) not in (1)")
    rates = spark.createDataFrame([("2024-01-06", 2.52), ("2024-01-07", 5.04)], "d string, irx double").select(F.col("d").cast("date").alias("date"), "irx")
    got = [round(r["rf"] * 252, 6) for r in bt.risk_free(cal, rates, CFG).orderBy("date").collect()]
    assert got == [0.03, 0.0252, 0.0252]


def test_normal_and_expected_max(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.5, 0.975, 0.9999, 0.0, 1.0)], "p double")
    got = {r["p"]: r["z"] for r in df.withColumn("z", stats.norm_ppf(F.col("p"))).collect()}
    assert got[0.0] is None and got[1.0] is None and all(abs(stats.norm_cdf(z) - p) < 1e-8 for p, z in got.items() if z is not None)
    e = spark.range(1).select(stats.expected_max_sharpe(F.lit(0.2), F.lit(20)).alias("a"), stats.expected_max_sharpe(F.lit(0.0), F.lit(20)).alias("b"), stats.expected_max_sharpe(F.lit(0.2), F.lit(1)).alias("c")).first()
    assert round(e["a"], 4) == 0.3801 and e["b"] is None and e["c"] is None


def test_normal_column_against_the_error_function(spark):
    got = spark.range(-4000, 4001).select((F.col("id") / 100.0).alias("x")).withColumn("p", stats.norm_cdf_col(F.col("x"))).collect()
    assert all(math.isclose(r["p"], stats.norm_cdf(r["x"]), rel_tol=1e-6, abs_tol=1e-14) and abs(r["p"] - stats.norm_cdf(r["x"])) < 1e-14 for r in got)
    assert spark.range(1).select(stats.norm_cdf_col(F.lit(None).cast("double")).alias("p")).first()["p"] is None


def test_paired_test_of_a_series_with_itself(spark):
    a = prices(spark, [0.01, -0.02, 0.03] * 20).select("date", F.col("close").alias("ret"))
    assert stats.paired_sharpe_test(a, a).first()["z"] is None
    assert stats.paired_sharpe_test(a.limit(5), a).first()["z"] is None


def test_seed_columns_come_from_different_rows(spark):
    log = spark.createDataFrame([("u", "x", "c1", None, "t1", 1), ("u", "x", "c2", 2.0, "t1", 2)], "universe_tag string, branch_tag string, commit string, oos_sharpe double, written_at string, row_no long")
    r = tl.seeds(log).first()
    assert (r["seed_commit"], r["seed_sharpe"]) == ("c1", 2.0)


def test_earliest_duplicate_against_all_pairs(spark):
    """Own commits, repeated rows, null hashes and null commits."""
    rows = [("h", "b1", "c1", 1), ("h", "b2", "c2", 2), ("h", "b3", "c1", 3), ("g", "b1", "c5", 4), ("g", "b2", "c5", 5), (None, "b1", "c6", 6), ("h", "b4", None, 0), ("h", "b2", "c2", 7)]
    log = spark.createDataFrame(rows, "ast_sha256 string, branch_tag string, commit string, row_no long")
    got = {(r["commit"], r["ast_sha256"], r["seen_branch"], r["seen_commit"]) for r in tl.earliest_duplicate(log, log).collect()}
    want = set()
    for h, _, c, _ in rows:
        if h and c and (hits := [x for x in rows if x[0] == h and x[2] and x[2] != c]):
            x = min(hits, key=lambda x: x[3])
            want.add((c, h, x[1], x[2]))
    assert got == want and len(want) == 2


def test_bootstrap_and_sweep(spark, sf_dir):
    p = fx.panel_compound(spark, sf_dir).where("date < DATE'1996-01-01'")
    cfg = replace(CFG, oos_start="1995-06-01", oos_end="1995-12-31", bootstrap_draws=30)
    daily = bt.with_excess(bt.strat_returns(sg.residual_reversal(p), p, cfg), cfg).where(bt.out_of_sample(cfg))
    a, b = sim.bootstrap_interval(daily, cfg).first(), sim.bootstrap_interval(daily, cfg).first()
    assert a == b and a["lo"] <= a["hi"] and a["draws"] == 30
    assert sim.bootstrap_interval(daily.limit(20), cfg).count() == 0 or sim.bootstrap_interval(daily.limit(20), cfg).first()["lo"] is None
    assert sim.perturbed(10) == [8, 12] and sim.perturbed(0.9)[1] == 1.0 and set(sim.candidates({"a": 5, "b": 6, "c": 1.0, "d": 0.5, "e": True})) == {"b", "d"}
    sweep = sim.sensitivity(p, lambda q, days, share: sg.residual_reversal(q, days, share), {"days": 21, "share": 0.2}, cfg)
    s = sim.sensitivity_summary(sweep).first()
    assert s["variants"] == 4 and s["max_abs_delta"] >= 0


def test_sweep_query_moves_all_candidates(spark, sf_dir):
    p = fx.panel_flat(spark, sf_dir)
    alone = lambda **k: bt.with_excess(bt.strat_returns(sg.quad_reversal(p, **k), p, CFG), CFG).where(bt.out_of_sample(CFG)).agg(bt.sharpe(F.col("ex"), CFG.days_per_year).alias("s")).first()["s"]
    got = {r["strategy_id"]: r["sharpe"] for r in QUERIES["sensitivity_sweep"](spark, sf_dir).collect()}
    assert set(got) == {"base", "short=17", "short=25", *(f"{k}={v}" for k in ("long", "vol_days", "size_days") for v in (50, 76)), "threshold=0.08", "threshold=0.12", "gross=0.4", "gross=0.6"}
    assert math.isclose(got["base"], alone(), abs_tol=1e-6) and math.isclose(got["size_days=50"], alone(size_days=50), abs_tol=1e-6)


def test_no_draws_give_no_interval_and_no_p(spark, sf_dir):
    p = fx.panel_compound(spark, sf_dir).where("date < DATE'1996-01-01'")
    cfg = replace(CFG, oos_start="1995-06-01", oos_end="1995-12-31", bootstrap_draws=0)
    daily = bt.with_excess(bt.strat_returns(sg.residual_reversal(p), p, cfg), cfg).where(bt.out_of_sample(cfg))
    assert tuple(sim.bootstrap_interval(daily, cfg).first()) == (None, None, 0)
    r = sim.null_test(p, sg.residual_reversal, cfg, 0).first()
    assert (r["draws"], r["failed"], r["p"], r["status"]) == (0, 0, None, None)


def test_null_draws_pay_what_runs_pay(spark, sf_dir):
    """A draw's ratio is that of the same shuffled panel run alone, with borrow and impact."""
    p = fx.panel_compound(spark, sf_dir).where("date < DATE'1996-06-01'")
    cfg = replace(CFG, oos_start="1995-06-01", oos_end="1996-05-31", impact_slope_bps=20.0, borrow_bps=600.0)
    short = lambda q, by=(): sg.long_short(q, by=by)
    got = {r["k"]: r["s"] for r in sim.null_draws(p, short, cfg, 3).collect()}
    for k in range(3):
        one = sim.shuffled_panels(p, 3, cfg.seed).where(F.col("k") == k).drop("k")
        daily = bt.with_excess(bt.strat_returns(short(one), one, cfg), cfg).where(bt.out_of_sample(cfg))
        assert math.isclose(daily.agg(bt.sharpe(F.col("ex")).alias("s")).first()["s"], got[k], rel_tol=1e-9)
        assert daily.agg(F.sum("borrow")).first()[0] > 0


def test_null_draws_come_in_batches_and_small_plans(spark, sf_dir):
    """Batches change no ratio; the plan that is left holds the real run and the draws' ratios, not the shuffled panels."""
    p = fx.panel_compound(spark, sf_dir).where("date < DATE'1996-01-01'")
    cfg = replace(CFG, oos_start="1995-06-01", oos_end="1995-12-31")
    test = sim.null_test(p, sg.quad_reversal, cfg, 5)
    assert test._jdf.queryExecution().sparkPlan().toString().count("FileScan") <= 12
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    whole, ones = (dict(sim.null_draws(p, sg.quad_reversal, cfg, 5, rows).collect()) for rows in (10**9, 1))
    assert sorted(whole) == sorted(ones) == list(range(5)) and all(math.isclose(whole[k], ones[k], rel_tol=1e-9) for k in whole)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert math.isclose(test.first()["mean"], sum(whole.values()) / 5, rel_tol=1e-9)


def test_budget():
    with TimeBudget(5) as b:
        pass
    assert 0 <= b.elapsed < 5
    with pytest.raises(TimeoutError):
        with TimeBudget(-1):
            pass
    with pytest.raises(KeyError):
        with TimeBudget(-1):
            raise KeyError


def test_text_logs(spark, tmp_path, sf_dir):
    path = str(tmp_path / "oos.tsv")
    (tmp_path / "oos.tsv").write_text("commit\told\n1\t2\n")
    p = fx.panel_flat(spark, sf_dir)
    run = result_of(bt.run_backtest(sg.quad_reversal(p), p, CFG))
    logs.append_oos(path, "c1", run)
    logs.append_oos(path, "c2", {"status_hint": "crash"})
    assert (tmp_path / "oos.tsv.old").read_text().startswith("commit\told") and run["backtest_seconds"] > 0
    rows = {r["commit"]: r for r in io.read_oos_log(spark, path, list(logs.OOS_HEADER)).collect()}
    assert math.isclose(rows["c1"]["oos_sharpe_lo"], run["oos_sharpe_lo"], abs_tol=1e-6) and rows["c2"]["oos_sharpe"] is None and rows["c2"]["num_trades"] == 0
    assert set(json.loads(rows["c1"]["is_fold_sharpes_json"])) == {"is_1", "is_2"}
    (tmp_path / "oos.tsv").write_text("x\n")
    assert logs.set_aside_if_older(path, logs.OOS_HEADER) != path + ".old" and (tmp_path / "oos.tsv.old").exists()
    path = str(tmp_path / "results.tsv")
    assert logs.append_result(path, "c1", float("nan"), None, 1.239, "keep", "thesis: x") == "status=keep"
    assert (tmp_path / "results.tsv").read_text().splitlines()[1] == "c1\t0.000000\t0.0000\t1.24\tkeep\tthesis: x"
    path = str(tmp_path / "trial_cache_u.tsv")
    logs.append_trial(path, "h", "b", "c1", float("inf"), "keep", "2")
    with open(path, "a") as f:
        f.write("short\tline\n")
    got = io.read_cache(spark, path).orderBy("row_no").collect()
    assert got[0]["oos_sharpe"] is None and got[0]["malformed"] is None and got[1]["malformed"] == "short\tline"
    with io.log_lock(str(tmp_path / "l"), shared=True), io.log_lock(str(tmp_path / "l"), shared=True):
        pass
    assert io.missing_columns(spark.range(1), ("id", "x")) == ["x"]
    text = spark.createDataFrame([("a: 1\noos_sharpe:       0.391582\nb",), ("oos_sharpe: <hidden>",)], "value string")
    assert [r["oos_sharpe"] for r in reports.printed_sharpe(text).collect()] == [0.391582, None]


def test_running_best_over_many_stretches(spark):
    r = random.Random(4)
    rows = [(i, r.choice("uv"), r.choice(["keep", "keep", "discard"]), r.choice([None, r.random()])) for i in range(300)]
    log = spark.createDataFrame(rows, "row_no long, u string, status string, oos_sharpe double")
    for by in ((), ("u",)):
        want, best, last = {}, {}, {}
        for i, u, status, x in rows:
            k = u if by else 0
            if status == "keep" and x is not None:
                best[k] = max(best.get(k, x), x)
                want[i] = best[k], None if k not in last else x - last[k]
                last[k] = x
        assert {x["row_no"]: (x["best"], x["delta"]) for x in tl.running_best(log, by, 7).collect()} == want


def test_shuffle_keeps_each_names_returns(spark):
    p = prices(spark, [100, 110, 99, 104, 120])
    k = sim.shuffled_panels(p, 3, 7)
    ends = k.groupBy("k").agg(F.max_by("close", "date").alias("e"), F.min_by("close", "date").alias("s")).collect()
    assert all(math.isclose(r["e"], 120, rel_tol=1e-9) and r["s"] == 100 for r in ends)


def test_null_query_is_the_whole_test(spark, sf_dir):
    """200 draws of the reference's strategy, as null_test.py runs it; p is a share of the draws."""
    p = fx.panel_compound(spark, sf_dir)
    daily = bt.with_excess(bt.strat_returns(sg.quad_reversal(p), p, CFG), CFG).where(bt.out_of_sample(CFG))
    real = daily.agg(bt.sharpe(F.col("ex"), CFG.days_per_year).alias("s")).first()["s"]
    r = QUERIES["null_shuffle_p"](spark, sf_dir).first()
    assert r["draws"] == 200 and math.isclose(r["real"], real, abs_tol=1e-6)
    assert math.isclose(r["p"] * 200, round(r["p"] * 200), abs_tol=1e-9) and r["p05"] < r["mean"] < r["p95"] and r["sd"] > 0


GOOD = {"oos_sharpe": 2.0, "oos_sharpe_lo": 1.5, "is_fold_median_sharpe": 1.0, "oos_fold_median_sharpe": 0.5, "min_fold_sharpe": 0.1, "max_drawdown": 0.2, "turnover_annual": 10.0, "num_trades": 100}
BASE = {"oos_sharpe": 1.0, "is_fold_median_sharpe": 0.5}


@pytest.mark.parametrize("field,value,gate", [
    ("oos_sharpe", 1.1, "sharpe_over_hurdle"), ("is_fold_median_sharpe", 0.55, "is_fold_median"), ("oos_fold_median_sharpe", 0.0, "oos_fold_median"), ("min_fold_sharpe", None, "worst_fold"),
    ("max_drawdown", 0.36, "drawdown"), ("turnover_annual", 51.0, "turnover"), ("num_trades", 49, "trades"), ("oos_sharpe_lo", 0.9, "better_than_baseline"),
])
def test_each_gate_alone(field, value, gate):
    assert all(grader.gates(GOOD, BASE, 1.15, None, CFG).values())
    checks = grader.gates({**GOOD, field: value}, BASE, 1.15, None, CFG)
    assert [k for k, ok in checks.items() if not ok] == [gate]
    assert not grader.gates(GOOD, BASE, 1.15, 1.0, CFG)["better_than_baseline"] and grader.gates(GOOD, BASE, 1.15, 1.7, CFG)["better_than_baseline"]


def test_grade_order(spark):
    results = spark.createDataFrame([("c0", 1.0, "keep", 0)], "commit string, oos_sharpe double, status string, row_no long")
    cache = spark.createDataFrame([("h1", "b1", "c0", 1.0, "keep", "2", 0)], "ast_sha256 string, branch_tag string, commit string, oos_sharpe double, status string, hurdle_version string, row_no long")
    cols = ["commit", *GOOD, "status_hint", "row_no"]
    oos = spark.createDataFrame([("c0", *{**GOOD, **BASE}.values(), "keep_eligible", 0), ("c1", *GOOD.values(), "keep_eligible", 1), ("c2", *GOOD.values(), "crash", 2)], cols)
    run = lambda c, d="thesis: x", h=None, r=results, cfg=CFG: grader.grade(c, d, h, r, cache, oos, cfg)
    assert run("c1", "thesis: a\tb").code == 2 and run("c1", cfg=replace(CFG, trial_cap=1)).code == 4 and run("c1", h="h1").code == 3 and run("c0", h="h1").code == 0
    assert run("zz").code == 5 and run("c1", "no prefix").code == 2 and run("c1", "Thesis: y").status == "keep"
    assert run("c2").status == "discard" and run("c1", r=results.where("false")).status == "keep"
    assert grader.spec_hash(None) is None and grader.spec_hash({"a": 1, "b": 2}) == grader.spec_hash({"b": 2, "a": 1})


def test_logs_keep_commits_as_text(spark, tmp_path):
    (tmp_path / "results.tsv").write_text("commit\toos_sharpe\tmax_dd\tturnover\tstatus\tdescription\n6987e31\t0.5\tx\t2\t KEEP \tthesis: a\n")
    r = io.read_results(spark, str(tmp_path / "results.tsv")).first()
    assert (r["commit"], r["oos_sharpe"], r["max_dd"], r["status"]) == ("6987e31", 0.5, None, "keep")
    (tmp_path / "trial_cache_u1.tsv").write_text("ast_sha256\tbranch_tag\tcommit\toos_sharpe\tstatus\thurdle_version\twritten_at\nh\tb\t1e5\tnan\tkeep\t2\t2024\n")
    r = io.read_cache(spark, str(tmp_path / "trial_cache_*.tsv")).first()
    assert (r["universe_tag"], r["commit"], r["oos_sharpe"]) == ("u1", "1e5", None)
    assert io.read_cache(spark, str(tmp_path / "none.tsv")).count() == 0
    (tmp_path / "u.json").write_text('{"tickers": ["A", "B"]}')
    assert [tuple(x) for x in io.read_universe(spark, str(tmp_path / "u.json"), "t").collect()] == [("t", "A"), ("t", "B")]
    (tmp_path / "m.json").write_text('{"removals": [{"ticker": "A", "date": "2020-01-02"}, {"ticker": "B", "date": "bad"}]}')
    added, removed = io.read_schedule(spark, str(tmp_path / "m.json"))
    assert added.count() == 0 and [r["ticker"] for r in removed.collect()] == ["A"]
    with io.log_lock(str(tmp_path / "lock")):
        io.append_rows(spark.range(2), str(tmp_path / "t"))
    io.append_rows(spark.range(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_series_round_trip(spark):
    daily = prices(spark, [0.1, 0.123456789012]).select("date", F.col("close").alias("ret"))
    text = io.export_series(daily).withColumnRenamed("json", "oos_daily_returns_json")
    back = text.select(F.inline(io.parse_series())).collect()
    assert [r["ret"] for r in back] == [0.1, 0.123456789] and str(back[0]["date"]) == "2024-03-25"
    assert spark.range(1).select(F.lit("nan").alias("oos_daily_returns_json")).select(io.parse_series().alias("x")).first()["x"] is None


def test_masking(spark):
    m = spark.createDataFrame([(1.0, 2.0, 60)], "is_sharpe double, oos_sharpe double, num_trades long")
    assert reports.masked(m, False).first().asDict() == {"is_sharpe": "1.000000", "oos_sharpe": reports.HIDDEN, "num_trades": reports.HIDDEN}
    assert reports.summary_lines(m, True).count() == 3


def test_path_dependent_weights(spark):
    w = prices(spark, [1, 1, 0.9, 0.2]).withColumnRenamed("close", "w")
    assert [r["w"] for r in sg.throttled(w, 0.4).orderBy("date").collect()] == [1, 1, 1, 0.2]
    assert [round(r["w"], 6) for r in sg.smoothed(w, 1.0).orderBy("date").collect()][:2] == [1, 1]


def test_stream_of_trials(spark, tmp_path):
    from strataframe.streaming import log_tail

    log = spark.sql("select * from values ('h1', timestamp'2024-01-01 00:10:00', 'b', 1D), ('h1', timestamp'2024-01-01 00:20:00', 'b', 2D), ('h2', timestamp'2024-01-01 00:30:00', 'b', 3D) as t(ast_sha256, written_at, branch_tag, oos_sharpe)")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = log_tail.first_trials(log_tail.tail(spark, str(tmp_path / "in"), log.schema)).writeStream.format("memory").queryName("trials").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.sql("select ast_sha256 from trials").collect()) == ["h1", "h2"]


def test_written_tables_have_no_checksum_files(spark):
    table = scratch.written(spark.range(0, 1000, 1, 4), "plain")
    (folder,) = {os.path.dirname(f.removeprefix("file://")) for f in table.inputFiles()}
    assert sum(f.endswith(".parquet") for f in os.listdir(folder)) == 4
    assert not [f for f in os.listdir(folder) if f.endswith(".crc")]
    assert sorted(r[0] for r in table.collect()) == list(range(1000))


def test_defaults():
    c = BacktestConfig()
    assert (c.oos_start, c.embargo_days, c.bootstrap_draws, len(c.folds)) == ("2020-01-01", 21, 200, 5)
