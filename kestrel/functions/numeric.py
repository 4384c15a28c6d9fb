"""Numeric helpers shared by all operators.

Rounding follows the reference's array-library rule: scale, round half to
even on the scaled double, unscale (0.125 -> 0.12 at 2 dp, 1/16 -> 0.062 at
3 dp). ``sql_round`` writes the same rule for the DuckDB oracle so both
engines perform identical IEEE operations. Adding 0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def ratio_round(num, den, digits: int) -> Column:
    """round(num / den, digits) computed as rint(num * 10^k / den) / 10^k.

    ``num`` and ``den`` are exact integers (counts, or sums in hundredths), so
    the only inexact step is one IEEE division -- identical in every engine.
    """
    scale = float(10 ** digits)
    q = (_c(num).cast("double") * F.lit(scale)) / _c(den).cast("double")
    return F.rint(q) / F.lit(scale) + F.lit(0.0)


def cents_ratio_round(num_cents, den, digits: int = 2) -> Column:
    """round((num_cents / 100) / den, digits) for sums kept in hundredths."""
    n = _c(num_cents).cast("double")
    d = _c(den).cast("double")
    if digits >= 2:
        q = (n * F.lit(float(10 ** (digits - 2)))) / d
    else:
        q = n / (d * F.lit(float(10 ** (2 - digits))))
    return F.rint(q) / F.lit(float(10 ** digits)) + F.lit(0.0)


def cents(x) -> Column:
    """Decimal with two places -> exact long count of hundredths."""
    return (_c(x) * F.lit(100)).cast("long")


def to_int_flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int with NULL treated as 0 (``int(a == b)``)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


# ---- SQL text for the DuckDB oracle -------------------------------------

def sql_round(expr: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(round_even(({expr}) * {scale}.0, 0) / {scale}.0 + 0.0)"


def sql_ratio_round(num: str, den: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(round_even((cast({num} as double) * {scale}.0) / cast({den} as double), 0) / {scale}.0 + 0.0)"


def sql_cents_ratio_round(num_cents: str, den: str, digits: int = 2) -> str:
    n, d = f"cast({num_cents} as double)", f"cast({den} as double)"
    if digits >= 2:
        q = f"({n} * {float(10 ** (digits - 2))!r}) / {d}"
    else:
        q = f"{n} / ({d} * {float(10 ** (2 - digits))!r})"
    return f"(round_even({q}, 0) / {float(10 ** digits)!r} + 0.0)"


def half_up_ratio(num: str, den: str, digits: int) -> Column:
    """round(num / den, digits), half away from zero, for non-negative integer
    column names -- the database ROUND(numeric) rule, computed exactly with
    integer division."""
    scale = 10 ** digits
    return F.expr(f"(2 * ({num}) * {scale} + ({den})) div (2 * ({den}))").cast("double") / F.lit(float(scale))


def sql_half_up_ratio(num: str, den: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(cast((2 * ({num}) * {scale} + ({den})) // (2 * ({den})) as double) / {float(scale)!r})"
