"""Column expressions with the null, tie and rounding rules the operators need.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------------ time


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since the epoch; accepts TIMESTAMP and TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_millis(_c(ts).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds ``end - start`` as a double, kept to the microsecond."""
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / F.lit(1e6)


def day_of(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def month_of(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def span_days(first: Column | str, last: Column | str) -> Column:
    """Whole calendar days from the day of ``first`` to the day of ``last``."""
    return F.datediff(_c(last).cast("timestamp"), _c(first).cast("timestamp"))


# ------------------------------------------------------------------ numbers


def floor_div(x: Column | str, width: Column | float | int) -> Column:
    """Floor division (toward minus infinity), as BIGINT; ``div`` would truncate."""
    return F.floor(_c(x) / (width if isinstance(width, Column) else F.lit(width))).cast("bigint")


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round half to even, the rule temporal cut positions use."""
    return F.bround(_c(x), digits)


def nan_to_null(x: Column | str) -> Column:
    """NaN sorts above all numbers and equals itself in Spark, so it never stays in a column."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c), c)


def finite(x: Column | str) -> Column:
    """True for real numbers only: not NULL, not NaN, not infinite."""
    c = _c(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` as a double, NULL where ``b`` is zero."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


# ------------------------------------------------------------------ labels and predicates


def three_valued(state: Column | str, positives: Iterable[str], negative: str) -> Column:
    """1.0 for a positive state, 0.0 for the baseline state, NULL for every other state."""
    s = _c(state)
    return F.when(s.isin(list(positives)), F.lit(1.0)).when(s == negative, F.lit(0.0))


def is_not(state: Column | str, value: str) -> Column:
    """``state <> value`` that keeps rows whose state is NULL."""
    return ~_c(state).eqNullSafe(F.lit(value))


def in_half_open(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """``lo <= x < hi``."""
    return (_c(x) >= _c(lo)) & (_c(x) < _c(hi))


def same_sign(*cols: Column) -> Column:
    """All signs equal (a NULL makes it NULL, hence not true)."""
    first, *rest = [F.signum(c) for c in cols]
    out = F.lit(True)
    for other in rest:
        out = out & (first == other)
    return out


# ------------------------------------------------------------------ arrays


def prefix_stddev_pop(values: Column | str, n: int) -> Column:
    """Population standard deviation of the first ``n`` array elements.

    NULL elements are skipped; an empty prefix gives NULL.  The row's own array
    bounds the work, so no exchange is needed.
    """
    head = F.filter(F.slice(_c(values), 1, n), lambda v: v.isNotNull())
    head = F.transform(head, lambda v: v.cast("double"))
    size = F.size(head)
    total = F.aggregate(head, F.lit(0.0), lambda acc, v: acc + v)
    mean = F.try_divide(total, size.cast("double"))
    # second pass around the mean avoids the cancellation of E[x^2] - E[x]^2
    squares = F.aggregate(head, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.sqrt(F.try_divide(squares, size.cast("double")))


# ------------------------------------------------------------------ reproducible draws


def hash_u32(*parts: Column | str | int, word: int = 0) -> Column:
    """Unsigned 32-bit draw from ``md5(part|part|...)`` as BIGINT.

    ``word`` picks one of the four 32-bit words of the digest.  md5 exists in
    every SQL engine, which is what makes draws checkable elsewhere.
    """
    cols = [F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts]
    digest = F.md5(F.concat_ws("|", *cols))
    return F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")


def draw_below(u32: Column, n: Column) -> Column:
    """Map a 32-bit draw to ``0 .. n-1`` by multiply-and-shift."""
    return F.shiftright(u32 * n, 32)
