"""Text logs on the driver's machine, one row at a time (S18 to S22). Callers hold io.log_lock(), which locks one machine, over
the read, the check and the append."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

RESULTS_HEADER = ("commit", "oos_sharpe", "max_dd", "turnover", "status", "description")
CACHE_HEADER = ("ast_sha256", "branch_tag", "commit", "oos_sharpe", "status", "hurdle_version", "written_at")
#: The columns of the metrics log.
OOS_HEADER = (
    "commit", "oos_sharpe", "oos_sharpe_lo", "oos_sharpe_hi", "is_sharpe", "max_drawdown", "annual_return", "annual_vol", "turnover_annual", "calmar", "num_trades", "status_hint",
    "yearly_sharpe_json", "median_fold_sharpe", "min_fold_sharpe", "fold_sharpes_json", "is_fold_median_sharpe", "is_fold_min_sharpe", "oos_fold_median_sharpe", "oos_fold_min_sharpe",
    "is_fold_sharpes_json", "oos_fold_sharpes_json", "oos_daily_returns_json",
)


def number(value: float | None, digits: int, missing: str) -> str:
    """A finite number with so many decimals, else `missing`."""
    return missing if value is None or not math.isfinite(float(value)) else f"{float(value):.{digits}f}"


def oos_values(commit: str, result: Mapping) -> list[str]:
    """The row of the metrics log for a result of run_backtest(): six decimals, nan for what is missing, maps as JSON."""
    out = [commit]
    for name in OOS_HEADER[1:]:
        key = name.removesuffix("_json")
        if name == "num_trades":
            out.append(str(int(result.get(name) or 0)))
        elif name in ("status_hint", "oos_daily_returns_json"):
            out.append(str(result.get(name) or ""))
        elif name.endswith("_json"):
            out.append(json.dumps({str(k): v for k, v in (result.get(key) or {}).items()}))
        else:
            out.append(number(result.get(name), 6, "nan"))
    return out


def set_aside_if_older(path: str, header: Sequence[str]) -> str | None:
    """Move a log with another header to a backup that overwrites none; its path, or None if there is nothing to move."""
    if not os.path.exists(path) or os.path.getsize(path) == 0:
        return None
    with open(path, encoding="utf-8") as f:
        if f.readline().rstrip("\n").split("\t") == list(header):
            return None
    backup = path + ".old"
    if os.path.exists(backup):
        backup += f".{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    os.replace(path, backup)
    return backup


def append(path: str, header: Sequence[str], values: Sequence[str]) -> None:
    """One row, after the header if the log is new or empty, on disk when this returns."""
    with open(path, "a", encoding="utf-8", newline="") as f:
        if f.tell() == 0:
            f.write("\t".join(header) + "\n")
        f.write("\t".join(values) + "\n")
        f.flush()
        os.fsync(f.fileno())


def append_oos(path: str, commit: str, result: Mapping) -> None:
    """A run's metrics; a log of an older header is set aside first."""
    set_aside_if_older(path, OOS_HEADER)
    append(path, OOS_HEADER, oos_values(commit, result))


def append_result(path: str, commit: str, oos_sharpe, max_dd, turnover, status: str, description: str) -> str:
    """A graded run; missing figures read zero. Returns the trailer that a loop can read."""
    append(path, RESULTS_HEADER, [commit, number(oos_sharpe, 6, "0.000000"), number(max_dd, 4, "0.0000"), number(turnover, 2, "0.00"), status, description])
    return f"status={status}"


def append_trial(path: str, ast_sha256: str, branch_tag: str, commit: str, oos_sharpe, status: str, hurdle_version: str) -> None:
    """A trial for the shared cache; a ratio that is missing or not finite reads nan."""
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    append(path, CACHE_HEADER, [ast_sha256, branch_tag, commit, number(oos_sharpe, 6, "nan"), status, str(hurdle_version), now])
