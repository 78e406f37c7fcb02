"""Generic scalar helpers (F2, F3, F4) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: Column, digits: int = 4) -> Column:
    """round to ``digits`` dp, half-even on the binary value of x*10^d.

    ``rint`` keeps the tie rule of the reference's float rounding and gives
    the same bits as DuckDB's ``round_even``; ``bround`` rounds the shortest
    decimal string instead and disagrees on ~0.2 % of microsecond data.
    ``+ 0.0`` folds -0.0 into 0.0.
    """
    scale = float(10 ** digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, 0 when den is 0 (ANSI mode would raise on x/0)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def safe_pct(num: Column, den: Column) -> Column:
    """100*num/den rounded to 2 dp, 0 when den is 0."""
    return round4(safe_ratio(num * F.lit(100.0), den), 2)


def stable_round(c: Column, digits: int = 4, guard: int = 9) -> Column:
    """Round an aggregate to ``digits`` dp after snapping it to ``guard`` dp.

    Sums and moments depend on the order rows arrive in, so two engines (or
    two runs) can differ in the last ulp. When the exact result sits on a
    decimal tie (common for statistics of 4-dp inputs) that ulp decides the
    rounding; snapping to 9 dp first removes it.
    """
    return round4(round4(c, guard), digits)
