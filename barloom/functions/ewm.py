"""Recursive exponential smoothing with window functions only.

``y[0] = x[0]``, ``y[t] = (1 - alpha) * y[t-1] + alpha * x[t]`` is a fold, which Spark has no
built-in for. With ``u[0] = x[0]`` and ``u[t] = alpha * x[t]`` it is the weighted sum
``y[t] = sum(d**i * u[t-i])``, ``d = 1 - alpha``, and that sum can be built by widening: if ``s``
covers the last ``m`` rows, then ``s[t] + d**m * s[t-m] + d**2m * s[t-2m] + ...`` covers a multiple
of ``m``. With four terms a level, five levels reach 1024 rows. The number of levels follows from
the smallest decay: a level is left out only when its weights are zero as doubles.

Every level is one Window operator of ``lag`` calls over the panel's own partitioning and order, so
there is no Python worker, no array per ticker and no extra exchange, and it spills like any window.
The levels can be merged with those of other features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.frames import by_ticker, levels

RADIX = 4
#: The smallest double above zero.
NO_WEIGHT = math.ulp(0.0)


@dataclass(frozen=True)
class Smoothing:
    """``alpha`` is the weight of the newest value."""

    value: str
    alpha: float
    min_periods: int = 1

    @classmethod
    def span(cls, value: str, span: int, min_periods: int = 1) -> "Smoothing":
        return cls(value, 2.0 / (span + 1), min_periods)

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha

    def reach(self) -> int:
        """How many rows back a weight is still large enough to count."""
        return 1 if self.decay <= 0 else math.ceil(math.log(NO_WEIGHT) / math.log(self.decay))


def row_exprs(spec: WindowSpec | None = None) -> dict[str, Column]:
    """The row number the smoothing levels need; it belongs to a level before them."""
    return {"_row": F.row_number().over(spec or by_ticker())}


def ewm_levels(specs: dict[str, Smoothing], spec: WindowSpec | None = None) -> list[dict[str, Column]]:
    """Levels that add one smoothed column per entry. The inputs must exist and not be null."""
    w = spec or by_ticker()
    first = F.col("_row") == 1
    steps = [{n: F.when(first, F.col(s.value).cast("double")).otherwise(F.col(s.value) * s.alpha) for n, s in specs.items()}]
    width, furthest = 1, max(s.reach() for s in specs.values())
    while width < furthest:
        steps.append({n: _widen(n, s.decay, width, w) for n, s in specs.items() if width < s.reach()})
        width *= RADIX
    guarded = {n: F.when(F.col("_row") >= s.min_periods, F.col(n)) for n, s in specs.items() if s.min_periods > 1}
    return [*steps, guarded] if guarded else steps


def ewm(df: DataFrame, specs: dict[str, Smoothing], spec: WindowSpec | None = None) -> DataFrame:
    """Add one smoothed column per entry of ``specs``. The inputs must not be null."""
    return levels(df, row_exprs(spec), *ewm_levels(specs, spec)).drop("_row")


def _widen(name: str, decay: float, width: int, w: WindowSpec) -> Column:
    total = F.lit(0.0)
    for k in range(RADIX - 1, 0, -1):
        weight = decay ** (k * width)
        if weight >= NO_WEIGHT:
            total = total + F.lag(name, k * width, 0.0).over(w) * F.lit(weight)
    return total + F.col(name)


def twice_smoothed(inner: Column, outer: Column, inner_decay: float, outer_decay: float) -> Column:
    """Smoothing of a smoothed series from the two single smoothings of the raw series.

    With decays ``a`` (inner) and ``b`` (outer) it is ``p * inner + (1 - p) * outer`` with
    ``p = (1 - b) * a / (a - b)``; both sides start at the first value and follow the same recursion.
    """
    p = (1 - outer_decay) * inner_decay / (inner_decay - outer_decay)
    return inner * p + outer * (1 - p)
