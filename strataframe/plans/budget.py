"""A wall-clock budget around actions (X11)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


class TimeBudget:
    """Raises TimeoutError after the block if it took longer than `seconds`, unless the block itself failed."""

    def __init__(self, seconds: float = 300.0):
        self.seconds, self.started, self.ended = float(seconds), None, None

    def __enter__(self) -> "TimeBudget":
        self.started, self.ended = time.monotonic(), None
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.ended = time.monotonic()
        if kind is None and self.elapsed > self.seconds:
            raise TimeoutError(f"took {self.elapsed:.1f} s of {self.seconds:.0f} s")
        return False

    @property
    def elapsed(self) -> float:
        return 0.0 if self.started is None else (self.ended or time.monotonic()) - self.started


def result_of(run: DataFrame, seconds: float = 300.0) -> dict:
    """The one row of a run as a dict, with backtest_seconds, inside the budget."""
    with TimeBudget(seconds) as budget:
        row = run.first()
    return {**(row.asDict() if row else {}), "backtest_seconds": budget.elapsed}
