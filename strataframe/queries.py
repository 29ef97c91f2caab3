"""Queries over the derived panels and logs, each beside the SQL that another engine can check it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import stats
from .operators import backtest as bt
from .operators import panel as pn
from .operators import signals as sg
from .operators import simulation as sim
from .operators import triallog as tl
from .plans import reports
from .sources import io

CFG = fx.CONFIG
IMPACT = replace(CFG, impact_slope_bps=20.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PCT = "(rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY date ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"


def _rank(x: str, percent: bool = True) -> str:
    r = _PCT.format(x=x)
    return f"CASE WHEN {x} IS NOT NULL THEN {r}" + (f" / count({x}) OVER (PARTITION BY date)" if percent else "") + " END"


_SHARPE = "avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252.0::DOUBLE)"
_PANELS = f"""
WITH li AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, CAST(round(l_discount * 100) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
flat AS (SELECT date, n_name AS ticker, 100.0::DOUBLE + (min(x) + max(x)) / 2.0::DOUBLE AS open, 100.0::DOUBLE + max(x) AS high, 100.0::DOUBLE + min(x) AS low,
  100.0::DOUBLE + CAST(sum(x) AS DOUBLE) / count(*) AS close, CAST(sum(q) AS DOUBLE) AS volume
  FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
compound AS (SELECT date, ticker, 100.0::DOUBLE * product(1 + (close - 105) / 100) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM flat),
mkt AS (SELECT date, 100.0::DOUBLE + CAST(sum(x) AS DOUBLE) / count(*) AS mkt FROM li GROUP BY 1),
dense AS (SELECT d.date, t.ticker, f.open, f.high, f.low, f.close, f.volume, last_value(f.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT DISTINCT date FROM flat) d CROSS JOIN (SELECT DISTINCT ticker FROM flat) t LEFT JOIN flat f ON f.date = d.date AND f.ticker = t.ticker),
rets AS (SELECT *, c / nullif(lag(c, 1) OVER p, 0) - 1 AS ret1, c / nullif(lag(c, 5) OVER p, 0) - 1 AS ret5, c / nullif(lag(c, 21) OVER p, 0) - 1 AS ret21, c / nullif(lag(c, 63) OVER p, 0) - 1 AS ret63,
  c / nullif(lag(c, 126) OVER p, 0) - 1 AS ret126, lag(c, 21) OVER p / nullif(lag(c, 252) OVER p, 0) - 1 AS mom FROM dense WINDOW p AS (PARTITION BY ticker ORDER BY date)),
vols AS (SELECT *, CASE WHEN count(ret1) OVER w = 63 THEN stddev_samp(ret1) OVER w END AS vol, CASE WHEN count(ret1) OVER v = 21 THEN stddev_samp(ret1) OVER v END AS vol21 FROM rets
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING), v AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)),
adj AS (SELECT *, ret21 / nullif(vol, 0) AS adj21, ret63 / nullif(vol, 0) AS adj63 FROM vols),
ranks AS (SELECT *, {_rank("ret21")} AS r1, {_rank("ret63")} AS r2, {_rank("adj21")} AS r3, {_rank("adj63")} AS r4, {_rank("vol")} AS vol_rank,
  {_rank("ret5", False)} AS b1, {_rank("ret21", False)} AS b2, {_rank("ret63", False)} AS b3, {_rank("ret126", False)} AS b4 FROM adj),
means AS (SELECT *, (r1 + r2 + r3 + r4) / 4.0 AS mean_rank, (b1 + b2 + b3 + b4) / 4.0 AS b_mean FROM ranks),
comp AS (SELECT *, {_rank("mean_rank")} AS composite, row_number() OVER (PARTITION BY date ORDER BY b_mean NULLS LAST, ticker) AS place FROM means),
raw AS (SELECT *, CASE WHEN composite <= 0.1 THEN coalesce(1 / nullif(vol, 0), 0) ELSE 0 END AS qraw, CASE WHEN place <= 14 AND b_mean IS NOT NULL THEN coalesce(1 / nullif(vol21, 0), 0) ELSE 0 END AS braw FROM comp),
daily_w AS (SELECT *, coalesce(qraw / nullif(sum(qraw) OVER x, 0), 0) * 0.5 AS w, coalesce(braw / nullif(sum(braw) OVER x, 0), 0) * 0.35 AS bw, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS label FROM raw WINDOW x AS (PARTITION BY date)),
labels_w AS (SELECT ticker, label, arg_max(w, date) AS w, arg_max(bw, date) AS bw FROM daily_w GROUP BY 1, 2),
weekly AS (SELECT a.date, a.ticker, a.c, a.ret1, a.vol_rank, coalesce(b.w, 0) AS w, coalesce(b.bw, 0) AS bw FROM daily_w a LEFT JOIN labels_w b ON a.ticker = b.ticker AND b.label = a.date - CAST((isodow(a.date) + 2) % 7 AS INTEGER)),
target AS (SELECT *, CASE WHEN c IS NOT NULL THEN w ELSE 0 END AS target FROM weekly),
lagged AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY ticker ORDER BY date), 0) AS w_eff FROM target),
eff AS (SELECT *, abs(coalesce(w_eff - lag(w_eff) OVER (PARTITION BY ticker ORDER BY date), 0)) AS dw FROM lagged),
day AS (SELECT date, sum(abs(w_eff)) AS gross, sum(w_eff * coalesce(ret1, 0)) AS pnl, sum(dw) AS turnover, sum(dw * 0.0005::DOUBLE) AS cost, sum(dw * coalesce((5.0 + 20.0 * vol_rank) / 1e4, 0.0005)) AS impact,
  sum(greatest(-w_eff, 0)) * (200.0::DOUBLE / 1e4 / 252) AS borrow, count(*) FILTER (dw > 1e-9) AS trades FROM eff GROUP BY date),
daily AS (SELECT *, pnl - cost - borrow AS ret, pnl - cost - borrow - 0.03::DOUBLE / 252 AS ex FROM day),
oos AS (SELECT * FROM daily WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'),
wealth AS (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM oos),
dd AS (SELECT date, equity, (max(equity) OVER h - equity) / max(equity) OVER h AS drawdown FROM wealth WINDOW h AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
folds AS (SELECT * FROM (VALUES ('is_1', DATE '1996-01-01', DATE '1997-12-31', 'IS'), ('is_2', DATE '1998-01-01', DATE '1999-12-31', 'IS'), ('oos_1', DATE '2000-01-01', DATE '2000-12-31', 'OOS'), ('oos_2', DATE '2001-01-01', DATE '2001-12-31', 'OOS')) t(fold, s, e, kind)),
infold AS (SELECT fold, kind, ex, row_number() OVER (PARTITION BY fold ORDER BY date) AS n FROM daily JOIN folds ON date BETWEEN s AND e),
foldsharpe AS (SELECT fold, kind, count(*) AS days, {_SHARPE.format(x="CASE WHEN n > 21 THEN ex END")} AS sharpe, {_SHARPE.format(x="ex")} AS sharpe0 FROM infold GROUP BY 1, 2)
"""
_LOG = """
WITH log AS (SELECT o_orderkey AS row_no, o_orderpriority AS universe_tag, md5(concat(CAST(o_custkey % 700 AS VARCHAR), '|', o_orderpriority)) AS ast_sha256, concat('b', CAST(o_custkey % 20 AS VARCHAR)) AS branch_tag,
  concat('c', CAST(o_orderkey AS VARCHAR)) AS commit, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 THEN o_totalprice / 100000.0::DOUBLE - 1 END AS oos_sharpe,
  CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'discard' ELSE 'crash' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '2' END AS hurdle_version, o_orderdate AS written_at FROM orders)
"""


def _ppf(p: str) -> str:
    def poly(x, cs, last=None):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out if last is None else f"({out} * {x} + 1.0::DOUBLE)"

    lo, hi, q = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    tail = lambda t: f"{poly(t, stats.ACKLAM_C)} / {poly(t, stats.ACKLAM_D, 1)}"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < 0.02425 THEN {tail(lo)} WHEN {p} > 1 - 0.02425 THEN -({tail(hi)}) ELSE {poly(r, stats.ACKLAM_A)} * {q} / {poly(r, stats.ACKLAM_B, 1)} END"


def _max_sharpe(sigma: str, n: str) -> str:
    g = f"{stats.EULER_GAMMA!r}::DOUBLE"
    return f"CASE WHEN {n} >= 2 AND {sigma} > 0 THEN {sigma} * ((1 - {g}) * ({_ppf(f'(1 - 1.0::DOUBLE / {n})')}) + {g} * ({_ppf(f'(1 - 1.0::DOUBLE / ({n} * 2.718281828459045::DOUBLE))')})) END"


def query(sql: str | None = None, base: str = _PANELS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = base + sql
        return f

    return add


def r8(*names: str, digits: int = 8) -> dict:
    return {n: F.round(n, digits) for n in names}


def _flat(s, d):
    return fx.panel_flat(s, d)


def _daily(s, d, cfg=CFG):
    p = _flat(s, d)
    return bt.with_excess(bt.strat_returns(sg.quad_reversal(p), p, cfg), cfg)


@query("SELECT date, ticker, close FROM dense")
def densify(s, d):
    return pn.densify(_flat(s, d).select("date", "ticker", "close"))


@query("SELECT date, ticker, c FROM dense")
def ffill_close(s, d):
    return pn.with_returns(_flat(s, d).select("date", "ticker", "close")).select("date", "ticker", "c")


@query("SELECT ticker, min(date) AS first_valid FROM flat WHERE close IS NOT NULL GROUP BY 1")
def first_valid(s, d):
    return _flat(s, d).where("close is not null").groupBy("ticker").agg(F.min("date").alias("first_valid"))


@query("SELECT ticker, min(date) AS first_valid FROM flat GROUP BY 1 HAVING min(date) <= DATE '1995-01-03'")
def universe_asof(s, d):
    return pn.universe_asof(_flat(s, d), "1995-01-03")


@query("""SELECT date, ticker, c IS NOT NULL AND NOT (ticker IN (SELECT n_name FROM nation WHERE n_nationkey BETWEEN 0 AND 4) AND date < DATE '1996-01-01')
  AND NOT (ticker IN (SELECT n_name FROM nation WHERE n_nationkey BETWEEN 20 AND 24) AND date > DATE '2001-01-01') AS active FROM dense""")
def membership_mask(s, d):
    added, removed = fx.schedule(s, d)
    return pn.membership(pn.densify(_flat(s, d).select("date", "ticker", "close")), added, removed).select("date", "ticker", "active")


@query("SELECT date, ticker, close * volume AS dollar_volume FROM flat")
def dollar_volume(s, d):
    return io.with_dollar_volume(_flat(s, d)).select("date", "ticker", "dollar_volume")


@query("SELECT date, ticker, round(ret1, 8) AS ret1 FROM rets WHERE ret1 IS NOT NULL ORDER BY abs(ret1) DESC, date, ticker LIMIT 10")
def top10_abs_returns(s, d):
    return io.top_moves(_flat(s, d)).withColumns(r8("ret1"))


@query("SELECT n_name AS ticker FROM nation WHERE n_name NOT IN (SELECT ticker FROM flat WHERE date = DATE '1995-01-02')")
def missing_tickers(s, d):
    asked = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("ticker"))
    return io.retry_missing(asked, _flat(s, d).where("date = DATE'1995-01-02'"))


@query("SELECT min(date) AS first, max(date) AS last, count(*) AS rows, count(DISTINCT ticker) AS tickers, avg(CAST(volume > 0 AS DOUBLE)) AS traded_share FROM flat")
def load_report(s, d):
    return io.load_report(_flat(s, d))


def _change(n):
    @query(f"SELECT date, ticker, round(ret{n}, 8) AS ret FROM rets")
    def f(s, d):
        return pn.with_returns(_flat(s, d), (n,)).select("date", "ticker", F.round(f"ret{n}", 8).alias("ret"))

    name = f"pct_change_{n}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


for _n in (1, 21, 63):
    _change(_n)


@query("SELECT date, ticker, round(vol, 8) AS vol FROM vols")
def rolling_std_63(s, d):
    return pn.with_returns(_flat(s, d)).select("date", "ticker", F.round(pn.rolling(F.stddev_samp, "ret1", 63), 8).alias("vol"))


@query("SELECT date, ticker, b2 AS rank FROM ranks")
def xs_rank_avg(s, d):
    return pn.with_returns(_flat(s, d), (21,)).select("date", "ticker", pn.rank_average("ret21", percent=False).alias("rank"))


@query("SELECT date, ticker, round(r2, 8) AS rank FROM ranks")
def xs_rank_pct(s, d):
    return pn.with_returns(_flat(s, d), (63,)).select("date", "ticker", F.round(pn.rank_average("ret63"), 8).alias("rank"))


@query("SELECT date, ticker, round(w, 8) AS w FROM weekly")
def quad_composite_weights(s, d):
    return sg.quad_reversal(_flat(s, d)).withColumns(r8("w")).select("date", "ticker", "w")


@query("SELECT date, ticker, round(w, 8) AS w FROM daily_w")
def quad_composite_daily(s, d):
    return sg.quad_reversal(_flat(s, d), weekly=False).withColumns(r8("w"))


@query("SELECT date, ticker, round(bw, 8) AS w FROM weekly")
def bottom_k_weights(s, d):
    return sg.bottom_k_reversal(_flat(s, d)).withColumns(r8("w")).select("date", "ticker", "w")


@query("SELECT a.date, a.ticker, b.v AS close FROM dense a LEFT JOIN (SELECT ticker, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS label, arg_max(close, date) AS v FROM dense WHERE close IS NOT NULL GROUP BY 1, 2) b ON a.ticker = b.ticker AND b.label = a.date - CAST((isodow(a.date) + 2) % 7 AS INTEGER) WHERE b.v IS NOT NULL")
def weekly_last_ffill(s, d):
    p = pn.densify(_flat(s, d).select("date", "ticker", "close"))
    return pn.weekly_last(p, "close").where("close <> 0").select("date", "ticker", "close")


@query("SELECT date, ticker, round(coalesce(coalesce(sign(ret1), 0) / nullif(sum(abs(coalesce(sign(ret1), 0))) OVER (PARTITION BY date), 0), 0), 8) AS w FROM rets")
def oracle_sign_weights(s, d):
    return sg.oracle_sign(_flat(s, d)).withColumns(r8("w"))


@query(f"""SELECT date, ticker, round(coalesce(m / nullif(sum(m) OVER (PARTITION BY date), 0), 0), 8) AS w FROM (
  SELECT date, ticker, CASE WHEN k > 1 - 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM (SELECT date, ticker, {_rank("mom")} AS k FROM rets))""")
def momentum_12_1(s, d):
    return sg.momentum(_flat(s, d), monthly=False).withColumns(r8("w"))


def _tail(rank: str, gross: float) -> str:
    return f"round(coalesce(m / nullif(sum(m) OVER (PARTITION BY date), 0), 0) * {gross}, 8) AS w"


@query(f"SELECT date, ticker, {_tail('vol_rank', 1.0)} FROM (SELECT date, ticker, CASE WHEN vol_rank <= 0.2 THEN coalesce(1 / nullif(vol, 0), 0) ELSE 0 END AS m FROM ranks)")
def low_volatility(s, d):
    return sg.low_volatility(_flat(s, d)).withColumns(r8("w"))


@query("""SELECT date, ticker, round(coalesce(u / nullif(sum(u) OVER x, 0), 0) * 0.5 - coalesce(v / nullif(sum(v) OVER x, 0), 0) * 0.5, 8) AS w FROM (
  SELECT date, ticker, CASE WHEN r2 > 1 - 0.1 THEN 1.0::DOUBLE ELSE 0 END AS u, CASE WHEN r2 <= 0.1 THEN 1.0::DOUBLE ELSE 0 END AS v FROM ranks) WINDOW x AS (PARTITION BY date)""")
def long_short(s, d):
    return sg.long_short(_flat(s, d)).withColumns(r8("w"))


@query("""SELECT date, ticker, round(beta, 6) AS beta FROM (SELECT r.date, r.ticker, CASE WHEN count(CASE WHEN ret1 IS NOT NULL AND mret IS NOT NULL THEN 1 END) OVER w = 63 THEN covar_samp(ret1, mret) OVER w / nullif(var_samp(CASE WHEN ret1 IS NOT NULL THEN mret END) OVER w, 0) END AS beta
  FROM rets r LEFT JOIN (SELECT date, mkt / nullif(lag(mkt) OVER (ORDER BY date), 0) - 1 AS mret FROM mkt) m ON r.date = m.date WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date ROWS 62 PRECEDING))""")
def beta_to_market(s, d):
    return sg.beta(_flat(s, d), fx.market_proxy(s, d)).select("date", "ticker", F.round("beta", 6).alias("beta"))


@query("SELECT date, round(ma, 8) AS ma, coalesce(mkt >= ma, true) AS open FROM (SELECT date, mkt, CASE WHEN count(mkt) OVER w >= 200 THEN avg(mkt) OVER w END AS ma FROM mkt WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)) WHERE ma IS NULL OR abs(mkt - ma) > 1e-9")
def ma200_gate(s, d):
    return sg.market_trend_gate(fx.market_proxy(s, d)).where("ma is null or abs(mkt - ma) > 1e-9").select("date", F.round("ma", 8).alias("ma"), "open")


@query("SELECT date, ticker, round(0.5 * ln(high / low) * ln(high / low) - (2 * 0.6931471805599453::DOUBLE - 1) * ln(close / open) * ln(close / open), 10) AS garman_klass, round(ln(high / low) * ln(high / low) / (4 * 0.6931471805599453::DOUBLE), 10) AS parkinson FROM dense")
def garman_klass(s, d):
    return sg.ohlc_measures(_flat(s, d)).select("date", "ticker", F.round("garman_klass", 10).alias("garman_klass"), F.round("parkinson", 10).alias("parkinson"))


@query("SELECT date, ticker, round(open / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 8) AS overnight, round(close / nullif(open, 0) - 1, 8) AS intraday, round((high - low) / close, 8) AS day_range FROM dense")
def overnight_intraday(s, d):
    return sg.ohlc_measures(_flat(s, d)).withColumns(r8("overnight", "intraday", "day_range")).select("date", "ticker", "overnight", "intraday", "day_range")


@query("""SELECT date, ticker, round(ma, 8) AS ma, round(c / nullif(hi, 0) - 1, 8) AS from_high, round((c - lo) / nullif(hi - lo, 0), 8) AS percent_k FROM (
  SELECT *, CASE WHEN count(c) OVER w >= 50 THEN avg(c) OVER w END AS ma, max(c) OVER w AS hi, min(c) OVER w AS lo FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING))""")
def trend_measures(s, d):
    return sg.trend_measures(_flat(s, d), 50).withColumns(r8("ma", "from_high", "percent_k")).select("date", "ticker", "ma", "from_high", "percent_k")


@query("SELECT date, ticker, round(w_eff, 8) AS w_eff, round(dw, 8) AS dw FROM eff")
def effective_weights(s, d):
    p = _flat(s, d)
    return bt.effective_weights(sg.quad_reversal(p), p, CFG).select("date", "ticker", F.round("w_eff", 8).alias("w_eff"), F.round("dw", 8).alias("dw"))


@query("SELECT date, round(turnover, 8) AS turnover, trades FROM daily")
def turnover_daily(s, d):
    return _daily(s, d).select("date", F.round("turnover", 8).alias("turnover"), "trades")


@query("SELECT date, round(cost, 10) AS cost FROM daily")
def tc_flat(s, d):
    return _daily(s, d).select("date", F.round("cost", 10).alias("cost"))


@query("SELECT date, round(impact, 10) AS cost FROM daily")
def tc_impact(s, d):
    return _daily(s, d, IMPACT).select("date", F.round("cost", 10).alias("cost"))


@query("""SELECT date, round(sum(greatest(-w, 0)) * (200.0::DOUBLE / 1e4 / 252), 10) AS borrow FROM (
  SELECT date, ticker, coalesce(lag(CASE WHEN c IS NOT NULL THEN w ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date), 0) AS w FROM (
    SELECT date, ticker, c, coalesce(u / nullif(sum(u) OVER x, 0), 0) * 0.5 - coalesce(v / nullif(sum(v) OVER x, 0), 0) * 0.5 AS w FROM (
      SELECT date, ticker, c, CASE WHEN r2 > 1 - 0.1 THEN 1.0::DOUBLE ELSE 0 END AS u, CASE WHEN r2 <= 0.1 THEN 1.0::DOUBLE ELSE 0 END AS v FROM ranks) WINDOW x AS (PARTITION BY date))) GROUP BY 1""")
def borrow_cost(s, d):
    p = _flat(s, d)
    return bt.strat_returns(sg.long_short(p), p, CFG).select("date", F.round("borrow", 10).alias("borrow"))


@query("SELECT date, round(pnl, 10) AS pnl, round(ret, 10) AS ret FROM daily")
def strat_returns(s, d):
    return _daily(s, d).select("date", F.round("pnl", 10).alias("pnl"), F.round("ret", 10).alias("ret"))


@query("SELECT date, round(equity, 8) AS equity, round(drawdown, 8) AS drawdown FROM dd")
def equity_curve(s, d):
    return bt.equity(_daily(s, d).where(bt.out_of_sample(CFG))).select("date", F.round("equity", 8).alias("equity"), F.round("drawdown", 8).alias("drawdown"))


_HEAD = f"""SELECT (SELECT {_SHARPE.format(x="ex")} FROM daily WHERE date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31') AS is_sharpe, {_SHARPE.format(x="ex")} AS oos_sharpe, pow(product(1 + ret), 252.0::DOUBLE / count(*)) - 1 AS annual_return,
  stddev_samp(ret) * sqrt(252.0::DOUBLE) AS annual_vol, avg(turnover) * 252 AS turnover_annual, CAST(sum(trades) AS BIGINT) AS num_trades, (SELECT max(drawdown) FROM dd) AS max_drawdown FROM oos"""


@query(f"SELECT round(is_sharpe, 6) AS is_sharpe, round(oos_sharpe, 6) AS oos_sharpe FROM ({_HEAD})")
def sharpe_is_oos(s, d):
    return bt.headline(_daily(s, d), CFG).select(F.round("is_sharpe", 6).alias("is_sharpe"), F.round("oos_sharpe", 6).alias("oos_sharpe"))


@query(f"SELECT round(annual_return, 6) AS annual_return, round(annual_vol, 6) AS annual_vol, round(max_drawdown, 6) AS max_drawdown, round(annual_return / max_drawdown, 4) AS calmar, round(turnover_annual, 6) AS turnover_annual, num_trades FROM ({_HEAD})")
def annual_stats(s, d):
    h = bt.headline(_daily(s, d), CFG)
    return h.select(*[F.round(c, 6).alias(c) for c in ("annual_return", "annual_vol", "max_drawdown")], F.round("calmar", 4).alias("calmar"), F.round("turnover_annual", 6).alias("turnover_annual"), "num_trades")


@query(f"SELECT round(max_drawdown, 6) AS max_drawdown FROM ({_HEAD})")
def max_drawdown(s, d):
    return bt.headline(_daily(s, d), CFG).select(F.round("max_drawdown", 6).alias("max_drawdown"))


@query(f"SELECT round(annual_return / max_drawdown, 4) AS calmar FROM ({_HEAD})")
def calmar(s, d):
    return bt.headline(_daily(s, d), CFG).select(F.round("calmar", 4).alias("calmar"))


@query(f"SELECT num_trades FROM ({_HEAD})")
def trade_count(s, d):
    return bt.headline(_daily(s, d), CFG).select("num_trades")


@query("SELECT CAST(least(floor((turnover - lo) * 40 / (hi - lo)), 39) AS INTEGER) AS bin, count(*) AS n FROM (SELECT round(turnover, 8) AS turnover FROM daily), (SELECT min(round(turnover, 8)) AS lo, max(round(turnover, 8)) AS hi FROM daily) GROUP BY 1")
def hist_turnover(s, d):
    return tl.histogram(_daily(s, d).select(F.round("turnover", 8).alias("turnover")), "turnover")


@query(f"SELECT CAST(year(date) AS INTEGER) AS year, round({_SHARPE.format(x='ex')}, 6) AS sharpe FROM oos GROUP BY 1")
def yearly_sharpe(s, d):
    return bt.yearly_sharpes(_daily(s, d), CFG).withColumns(r8("sharpe", digits=6))


@query("SELECT fold, kind, round(sharpe, 6) AS sharpe FROM foldsharpe")
def fold_sharpe_embargo(s, d):
    return bt.fold_sharpes(_daily(s, d), CFG).select("fold", "kind", F.round("sharpe", 6).alias("sharpe"))


@query("SELECT fold, days, round(sharpe0, 6) AS sharpe FROM foldsharpe")
def walkforward(s, d):
    return bt.fold_sharpes(_daily(s, d), CFG, embargo=0).select("fold", "days", F.round("sharpe", 6).alias("sharpe"))


@query("SELECT round(median(sharpe), 6) AS median, round(min(sharpe), 6) AS min, round(median(sharpe) FILTER (kind = 'IS'), 6) AS is_median, round(min(sharpe) FILTER (kind = 'IS'), 6) AS is_min, round(median(sharpe) FILTER (kind = 'OOS'), 6) AS oos_median, round(min(sharpe) FILTER (kind = 'OOS'), 6) AS oos_min FROM foldsharpe")
def fold_medians(s, d):
    m = bt.fold_medians(bt.fold_sharpes(_daily(s, d), CFG))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("SELECT (SELECT 1 - count(w) / CAST(count(*) AS DOUBLE) FROM weekly) AS null_share, round((SELECT max(gross) FROM daily), 8) AS max_gross, (SELECT count(DISTINCT h) FROM (SELECT date, string_agg(printf('%s:%.7f', ticker, abs(w_eff)), ',' ORDER BY ticker) AS h FROM eff WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' GROUP BY 1)) >= 2 AS moving")
def guards(s, d):
    p = _flat(s, d)
    w = sg.quad_reversal(p)
    return bt.guards(w, bt.strat_returns(w, p, CFG), CFG).select("null_share", F.round("max_gross", 8).alias("max_gross"), (F.col("oos_rows") >= 2).alias("moving"))


@query(f"SELECT CASE WHEN num_trades < 50 THEN 'crash' WHEN max_drawdown > 0.35 OR turnover_annual > 50 THEN 'force_discard' ELSE 'keep_eligible' END AS status_hint, num_trades FROM ({_HEAD})")
def status_hint(s, d):
    p = _flat(s, d)
    return bt.run_backtest(sg.quad_reversal(p), p, CFG).select("status_hint", "num_trades")


@query("SELECT p, round(" + _ppf("p") + ", 9) AS z FROM (SELECT CAST(range AS DOUBLE) / 1000 AS p FROM range(1, 1000))", base="")
def norm_ppf(s, d):
    return s.range(1, 1000).select((F.col("id").cast("double") / 1000).alias("p")).withColumn("z", F.round(stats.norm_ppf(F.col("p")), 9))


@query(f"SELECT universe_tag, n, round(sigma, 8) AS sigma, round({_max_sharpe('sigma', 'n')}, 7) AS sr0 FROM (SELECT universe_tag, coalesce(stddev_samp(oos_sharpe), 0) AS sigma, greatest(count(oos_sharpe), 2) AS n FROM log WHERE status <> 'crash' AND hurdle_version = '2' GROUP BY 1)", base=_LOG)
def expected_max_sharpe(s, d):
    p = tl.pool(fx.trial_log(s, d))
    return p.select("universe_tag", "n", F.round("sigma", 8).alias("sigma"), F.round(stats.expected_max_sharpe(F.col("sigma"), F.col("n")), 7).alias("sr0"))


def _series(s, d):
    return pn.with_returns(fx.panel_compound(s, d)).select(F.col("date").alias("t"), F.col("ticker").alias("id"), F.col("ret1").alias("r"))


_CRET = """, cd AS (SELECT d.date, t.ticker, last_value(f.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT DISTINCT date FROM compound) d CROSS JOIN (SELECT DISTINCT ticker FROM compound) t LEFT JOIN compound f ON f.date = d.date AND f.ticker = t.ticker),
cr AS (SELECT date, ticker, c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM cd),
pairs AS (SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, corr(x.r, y.r) AS rho FROM cr x JOIN cr y ON x.date = y.date AND x.ticker < y.ticker WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60)
"""


@query(_CRET + "SELECT a, b, n, round(rho, 7) AS rho FROM pairs")
def corr_pairs(s, d):
    return stats.correlations(_series(s, d)).withColumns(r8("rho", digits=7))


@query(_CRET + "SELECT n, round(rho, 7) AS rho, round(greatest(1, least(n, n / (1 + (n - 1) * greatest(rho, 0)))), 6) AS effective_n FROM (SELECT CAST((SELECT count(DISTINCT ticker) FROM cr) AS DOUBLE) AS n, avg(rho) AS rho FROM pairs)")
def effective_n(s, d):
    return stats.effective_trials(_series(s, d)).withColumns({**r8("rho", digits=7), **r8("effective_n", digits=6)})


@query(_CRET + """, m AS (SELECT count(*) AS n, avg(x.r) / stddev_samp(x.r) AS sa, avg(y.r) / stddev_samp(y.r) AS sb, corr(x.r, y.r) AS rho FROM cr x JOIN cr y ON x.date = y.date WHERE x.ticker = (SELECT min(ticker) FROM cr) AND y.ticker = (SELECT max(ticker) FROM cr) AND x.r IS NOT NULL AND y.r IS NOT NULL)
SELECT n, round(sa * sqrt(252.0::DOUBLE), 6) AS sharpe_a, round(sb * sqrt(252.0::DOUBLE), 6) AS sharpe_b, round((sa - sb) / sqrt((2 - 2 * rho + 0.5 * (sa * sa + sb * sb) - 0.5 * sa * sb * (1 + rho * rho)) / n), 6) AS z FROM m""")
def jk_memmel_z(s, d):
    x = _series(s, d).select(F.col("t").alias("date"), "id", F.col("r").alias("ret"))
    ends = x.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    pick = lambda e: x.join(F.broadcast(ends), F.col("id") == F.col(e)).select("date", "ret")
    return stats.paired_sharpe_test(pick("lo"), pick("hi")).drop("p").withColumns(r8("sharpe_a", "sharpe_b", "z", digits=6))


@query("""
, pos AS (SELECT row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n, ex FROM oos),
steps AS (SELECT k, pos, n, pos = 0 OR CAST('0x' || substr(md5('20200101|jump|' || k || '|' || pos), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.05 AS jump, CAST(floor(CAST('0x' || substr(md5('20200101|to|' || k || '|' || pos), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * n) AS BIGINT) AS t FROM pos CROSS JOIN (SELECT range AS k FROM range(200))),
path AS (SELECT k, (last_value(CASE WHEN jump THEN t END IGNORE NULLS) OVER w + pos - last_value(CASE WHEN jump THEN pos END IGNORE NULLS) OVER w) % n AS at FROM steps WINDOW w AS (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING)),
draws AS (SELECT k, """ + _SHARPE.format(x="ex") + """ AS s FROM path JOIN pos ON pos.pos = path.at GROUP BY k)
SELECT round(quantile_cont(s, 0.05), 6) AS lo, round(quantile_cont(s, 0.95), 6) AS hi, count(s) AS draws FROM draws""")
def bootstrap_ci(s, d):
    return sim.bootstrap_interval(_daily(s, d).where(bt.out_of_sample(CFG)), CFG).withColumns(r8("lo", "hi", digits=6))


@query()
def null_shuffle_p(s, d):
    return sim.null_test(fx.panel_compound(s, d), sg.quad_reversal, CFG).withColumns(r8("real", "mean", "sd", "p05", "p95", digits=6))


@query()
def sensitivity_sweep(s, d):
    return sim.sensitivity(_flat(s, d), sg.quad_reversal, {"short": 21, "long": 63, "vol_days": 63, "size_days": 63, "threshold": 0.1, "gross": 0.5}, CFG).withColumns(r8("sharpe", "delta", digits=6))


@query("SELECT upper(status) AS status, count(*) AS n, round((SELECT count(*) FILTER (status = 'keep') / CAST(count(*) FILTER (status <> 'crash') AS DOUBLE) FROM log), 8) AS keep_rate FROM log GROUP BY 1", base=_LOG)
def status_counts(s, d):
    return tl.status_counts(fx.trial_log(s, d)).withColumns(r8("keep_rate"))


@query("SELECT row_no, round(max(oos_sharpe) OVER (ORDER BY row_no), 8) AS best, round(oos_sharpe - lag(oos_sharpe) OVER (ORDER BY row_no), 8) AS delta FROM log WHERE status = 'keep' AND oos_sharpe IS NOT NULL", base=_LOG)
def running_best(s, d):
    return tl.running_best(fx.trial_log(s, d)).select("row_no", F.round("best", 8).alias("best"), F.round("delta", 8).alias("delta"))


@query("SELECT row_no, commit, round(oos_sharpe, 8) AS oos_sharpe FROM log WHERE status <> 'crash' ORDER BY row_no LIMIT 1", base=_LOG)
def baseline_seed(s, d):
    return tl.baseline(fx.trial_log(s, d)).select("row_no", "commit", F.round("oos_sharpe", 8).alias("oos_sharpe"))


@query("SELECT ast_sha256, max(row_no) AS row_no, arg_max(commit, row_no) AS commit FROM log GROUP BY 1", base=_LOG)
def latest_per_key(s, d):
    return tl.latest_per_key(fx.trial_log(s, d), "ast_sha256").select("ast_sha256", "row_no", "commit")


@query("SELECT l.row_no, round(CASE WHEN t.s IS NOT NULL AND t.s <> 0 THEN t.s ELSE l.oos_sharpe END, 8) AS oos_sharpe FROM log l LEFT JOIN (SELECT commit, CASE WHEN row_no % 3 = 0 THEN 0 ELSE oos_sharpe * 2 END AS s FROM log) t USING (commit)", base=_LOG)
def repair_sharpe(s, d):
    log = fx.trial_log(s, d)
    other = log.select("commit", "row_no", F.when(F.col("row_no") % 3 == 0, 0.0).otherwise(F.col("oos_sharpe") * 2).alias("oos_sharpe"))
    return tl.repaired(log, other).select("row_no", F.round("oos_sharpe", 8).alias("oos_sharpe"))


@query(""", firsts AS (SELECT ast_sha256, arg_min(branch_tag, row_no) AS b1, arg_min(commit, row_no) AS c1 FROM log GROUP BY 1),
others AS (SELECT l.ast_sha256, arg_min(l.branch_tag, l.row_no) AS b2, arg_min(l.commit, l.row_no) AS c2 FROM log l JOIN firsts f ON l.ast_sha256 = f.ast_sha256 AND l.commit <> f.c1 GROUP BY 1)
SELECT p.commit, p.ast_sha256, CASE WHEN p.commit <> c1 THEN b1 ELSE b2 END AS seen_branch, CASE WHEN p.commit <> c1 THEN c1 ELSE c2 END AS seen_commit
FROM (SELECT DISTINCT commit, ast_sha256 FROM log) p JOIN firsts USING (ast_sha256) LEFT JOIN others USING (ast_sha256) WHERE p.commit <> c1 OR c2 IS NOT NULL""", base=_LOG)
def duplicate_ast(s, d):
    log = fx.trial_log(s, d)
    return tl.earliest_duplicate(log, log.select("commit", "ast_sha256")).select("commit", "ast_sha256", "seen_branch", "seen_commit")


@query("SELECT round(count(*) FILTER (status = 'keep') / CAST(count(*) FILTER (status <> 'crash') AS DOUBLE), 8) AS keep_rate FROM log", base=_LOG)
def keep_rate(s, d):
    return tl.status_counts(fx.trial_log(s, d)).select(F.round("keep_rate", 8).alias("keep_rate")).distinct()


@query("SELECT universe_tag, round(coalesce(stddev_samp(oos_sharpe) FILTER (status <> 'crash'), 0), 8) AS sigma, greatest(count(oos_sharpe) FILTER (status <> 'crash'), 2) AS n FROM log GROUP BY 1", base=_LOG)
def pool_sigma(s, d):
    return tl.pool(fx.trial_log(s, d), None).select("universe_tag", F.round("sigma", 8).alias("sigma"), "n")


@query("SELECT row_no, universe_tag, round(max(oos_sharpe) OVER w, 8) AS best FROM log WHERE status = 'keep' AND oos_sharpe IS NOT NULL WINDOW w AS (PARTITION BY universe_tag ORDER BY row_no)", base=_LOG)
def frontier(s, d):
    return tl.running_best(fx.trial_log(s, d), ("universe_tag",)).select("row_no", "universe_tag", F.round("best", 8).alias("best"))


@query("SELECT row_no, universe_tag, round(oos_sharpe - lag(oos_sharpe) OVER (PARTITION BY universe_tag ORDER BY row_no), 8) AS delta FROM log WHERE status = 'keep' AND oos_sharpe IS NOT NULL", base=_LOG)
def delta_vs_prev_kept(s, d):
    return tl.running_best(fx.trial_log(s, d), ("universe_tag",)).select("row_no", "universe_tag", F.round("delta", 8).alias("delta"))


_AUDIT = f""", seeds AS (SELECT universe_tag, branch_tag, arg_min(commit, (written_at, row_no)) AS seed_commit, arg_min(oos_sharpe, (written_at, row_no)) FILTER (oos_sharpe IS NOT NULL) AS seed_sharpe FROM log GROUP BY 1, 2),
pools AS (SELECT *, coalesce(stddev_samp(CASE WHEN status <> 'crash' AND hurdle_version = '2' THEN oos_sharpe END) OVER w, 0) AS sigma, greatest(count(CASE WHEN status <> 'crash' AND hurdle_version = '2' THEN oos_sharpe END) OVER w, 2) AS n FROM log WINDOW w AS (PARTITION BY universe_tag ORDER BY written_at, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
audit AS (SELECT row_no, universe_tag, sigma, n, greatest(coalesce({_max_sharpe("sigma", "n")}, 0), 0) AS sr0, oos_sharpe - (seed_sharpe + 0.15) AS margin FROM pools JOIN seeds USING (universe_tag, branch_tag) WHERE oos_sharpe IS NOT NULL AND seed_sharpe IS NOT NULL AND commit <> seed_commit)
"""


@query(_AUDIT + "SELECT row_no, n, round(sigma, 7) AS sigma, round(sr0, 6) AS sr0, round(margin, 7) AS margin FROM audit", base=_LOG)
def expanding_pool(s, d):
    a = tl.gate_audit(fx.trial_log(s, d))
    return a.select("row_no", "n", F.round("sigma", 7).alias("sigma"), F.round("sr0", 6).alias("sr0"), F.round("margin", 7).alias("margin"))


@query(_AUDIT + "SELECT row_no, universe_tag, margin > 0 AS pass_plain, margin - sr0 > 0 AS pass_deflated FROM audit", base=_LOG)
def gate_audit(s, d):
    a = tl.gate_audit(fx.trial_log(s, d))
    return a.select("row_no", "universe_tag", (F.col("margin") > 0).alias("pass_plain"), (F.col("margin_deflated") > 0).alias("pass_deflated"))


@query(_AUDIT + "SELECT universe_tag, count(*) AS trials, count(*) FILTER (margin > 0) AS pass_plain, count(*) FILTER (margin - sr0 > 0) AS pass_deflated, round(avg(sr0), 6) AS sr0_mean, round(median(sr0), 6) AS sr0_median, round(quantile_cont(sr0, 0.9), 6) AS sr0_p90, round(median(margin - sr0), 6) AS margin_median FROM audit GROUP BY 1", base=_LOG)
def gate_audit_totals(s, d):
    t = tl.gate_totals(tl.gate_audit(fx.trial_log(s, d)))
    return t.withColumns(r8("sr0_mean", "sr0_median", "sr0_p90", "margin_median", digits=6))


@query(f"""SELECT universe_tag, n_trials, n_live, n_keeps, round(best_sharpe, 8) AS best_sharpe, best_commit, round(sr0, 6) AS sr0, round((best_sharpe - sr0) * sqrt(1259.0::DOUBLE) / sqrt(1 + 0.5 * best_sharpe * best_sharpe), 5) AS z, count(*) FILTER (n_live >= 2) OVER () AS cohorts FROM (
  SELECT *, {_max_sharpe("sigma", "n_live")} AS sr0 FROM (SELECT universe_tag, count(*) AS n_trials, count(*) FILTER (status <> 'crash') AS n_live, count(*) FILTER (status = 'keep') AS n_keeps, stddev_samp(oos_sharpe) FILTER (status <> 'crash') AS sigma,
  max(oos_sharpe) FILTER (status <> 'crash') AS best_sharpe, arg_max(commit, (oos_sharpe, -row_no)) FILTER (status <> 'crash') AS best_commit FROM log WHERE oos_sharpe IS NOT NULL GROUP BY 1))""", base=_LOG)
def universe_report(s, d):
    r = tl.universe_report(fx.trial_log(s, d))
    return r.drop("sigma").withColumns({**r8("best_sharpe"), **r8("sr0", digits=6), **r8("z", digits=5)})


@query(r"SELECT shape, count(*) AS n, min(row_no) AS first_row, max(row_no) AS last_row FROM (SELECT p_partkey AS row_no, regexp_replace(regexp_replace(regexp_replace(lower(trim('thesis: ' || p_type || ' size ' || p_size)), '\bthesis:\s*', '', 'g'), '-?\d+(\.\d+)?', 'N', 'g'), '\s+', ' ', 'g') AS shape FROM part) GROUP BY 1 HAVING count(*) >= 2", base="")
def sweep_shapes(s, d):
    return tl.sweep_shapes(fx.descriptions(s, d))


@query("SELECT CAST(least(floor((oos_sharpe - lo) * 40 / (hi - lo)), 39) AS INTEGER) AS bin, count(*) AS n FROM log, (SELECT min(oos_sharpe) AS lo, max(oos_sharpe) AS hi FROM log) WHERE oos_sharpe IS NOT NULL GROUP BY 1", base=_LOG)
def hist_sharpe(s, d):
    return tl.histogram(fx.trial_log(s, d), "oos_sharpe")


from . import queries_more  # noqa: E402, F401
