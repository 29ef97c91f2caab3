"""Settings of a backtest; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass

#: Yearly short-borrow cost in basis points by universe.
BORROW_BPS = {"sp100_2024": 150.0, "sp500_2024": 200.0, "ndx100_2024": 150.0, "sp400_2024": 250.0, "sp600_2024": 400.0, "xbi_2026": 600.0}
DEFAULT_BORROW_BPS = 200.0


@dataclass(frozen=True)
class Fold:
    name: str
    start: str
    end: str
    kind: str


#: The dates, folds, costs, limits and seed that results are compared under.
@dataclass(frozen=True)
class BacktestConfig:
    is_start: str = "2010-01-01"
    is_end: str = "2019-12-31"
    oos_start: str = "2020-01-01"
    oos_end: str = "2024-12-31"
    folds: tuple[Fold, ...] = (
        Fold("fold_2014_2015", "2014-01-01", "2015-12-31", "IS"),
        Fold("fold_2016_2017", "2016-01-01", "2017-12-31", "IS"),
        Fold("fold_2018_2019", "2018-01-01", "2019-12-31", "IS"),
        Fold("fold_2020_2021", "2020-01-01", "2021-12-31", "OOS"),
        Fold("fold_2022_2023", "2022-01-01", "2023-12-31", "OOS"),
    )
    days_per_year: int = 252
    embargo_days: int = 21
    cost_bps: float = 5.0
    impact_slope_bps: float = 0.0
    borrow_bps: float = DEFAULT_BORROW_BPS
    risk_free: float = 0.03
    pad_returns: bool = True
    max_gross: float = 3.0
    max_drawdown: float = 0.35
    max_turnover: float = 50.0
    min_trades: int = 50
    max_null_share: float = 0.99
    trade_epsilon: float = 1e-9
    bootstrap_draws: int = 200
    bootstrap_block: int = 20
    bootstrap_min_days: int = 40
    confidence: float = 0.9
    seed: int = 20200101
    hurdle: float = 0.15
    fold_margin: float = 0.10
    p_limit: float = 0.05
    trial_cap: int = 20
    hurdle_version: str | None = "2"


def borrow_bps(universe: str | None) -> float:
    """The universe's tier, or the flat rate."""
    return BORROW_BPS.get(universe or "", DEFAULT_BORROW_BPS)
