"""Exact numeric helpers shared by operators and their SQL twins.

Rounding of a ratio of integers is done in integer arithmetic (half up),
so the same value comes out of any engine regardless of float tie rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a, b) -> Column:
    """Exact floor division of non-negative longs (SQL ``div``), null when ``b`` is 0.

    A double quotient is at most one off; two long comparisons correct it.
    """
    a, b = _c(a).cast("long"), _c(b).cast("long")
    q0 = F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("long")
    return (F.when(b == 0, F.lit(None).cast("long"))
            .when(q0 * b > a, q0 - 1)
            .when((q0 + 1) * b <= a, q0 + 1)
            .otherwise(q0))


def ratio_round(num, den, digits: int) -> Column:
    """``round(num/den, digits)`` half-up for non-negative integers, null when den is 0.

    SQL twin: ``((num*2*10^d + den) // (2*den)) / 10^d``.
    """
    n, d = _c(num).cast("long"), _c(den).cast("long")
    scale = 10 ** digits
    return int_div(n * (2 * scale) + d, d * 2) / F.lit(float(scale))


def safe_div(num, den) -> Column:
    """Division that yields null instead of raising when ``den`` is 0 (ANSI on)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def cents(amount) -> Column:
    return F.round(_c(amount) * 100).cast("long")


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def fixed(x, digits: int = 3) -> Column:
    """``'%.{digits}f' % x`` with Python's rounding of the exact binary value (non-negative ``x``).

    Java's formatter rounds the shortest decimal string half-up (0.1235 -> 0.124) while the exact
    double is 0.12349999... (-> 0.123).  ``x * 10^d = p + e`` exactly (Dekker split, no FMA needed),
    so the tie test against ``n + 0.5`` is exact; exact ties go to the even neighbour.
    """
    x = _c(x).cast("double")
    s = float(10 ** digits)
    c = x * 134217729.0
    xh = c - (c - x)
    xl = x - xh
    p = x * s
    e = (xh * s - p) + xl * s
    n = F.floor(p).cast("long")
    t = (p - (n + 0.5)) + e
    r = F.when(t > 0, n + 1).when(t < 0, n).otherwise(F.when(n % 2 == 0, n).otherwise(n + 1))
    scale = 10 ** digits
    return F.concat(int_div(r, F.lit(scale)).cast("string"), F.lit("."),
                    F.lpad((r % scale).cast("string"), digits, "0"))
