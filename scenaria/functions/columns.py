"""Column -> Column helpers shared by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Running sums are taken in decimal so they do not depend on summation order.
RUNNING_SUM_TYPE = "decimal(38,10)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """``num / den`` with NULL for a zero (or NULL) denominator, as ``x / NULLIF(y, 0)``."""
    return F.try_divide(_c(num), _c(den))


def pct_change(cur, prev) -> Column:
    """Period-over-period change in percent: (cur - prev) / prev * 100, NULL-safe."""
    cur, prev = _c(cur), _c(prev)
    return safe_div(cur - prev, prev) * F.lit(100.0)


def adaptive_round(x, threshold: float = 10000.0, coarse: int = 0, fine: int = 4) -> Column:
    """Round large magnitudes coarsely and small ones finely (abs(x) > threshold)."""
    x = _c(x)
    return F.when(F.abs(x) > F.lit(threshold), F.round(x, coarse)).otherwise(F.round(x, fine))


def round_by_output(x, output_col, coarse_outputs: Iterable[str], coarse: int = 0, fine: int = 4) -> Column:
    """Per-output rounding: money outputs to ``coarse`` digits, ratios to ``fine`` digits."""
    x = _c(x)
    return F.when(_c(output_col).isin(list(coarse_outputs)), F.round(x, coarse)).otherwise(F.round(x, fine))


def linear_crossing(period, prev_gap, step) -> Column:
    """Fractional period where a linear path crosses a level.

    ``(period - 1) + prev_gap / step``: the crossing lies ``prev_gap / step`` of
    the way through the step that ends at ``period``.
    """
    return (_c(period) - F.lit(1)) + safe_div(prev_gap, step)


def exact_running_sum(x, window) -> Column:
    """Running sum over ``window`` computed in decimal and returned as double.

    A double running sum depends on the order the engine adds terms in; a
    decimal one does not, so results are reproducible across engines and
    retries.
    """
    return F.sum(_c(x).cast(RUNNING_SUM_TYPE)).over(window).cast("double")
