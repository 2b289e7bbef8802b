"""Scalar Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal / scientific number, optional sign and surrounding blanks.
# Guards the string->double cast so that JVM-only spellings ("12.5d",
# "0x1p3") are not accepted as numbers.
NUMBER_TEXT = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
# First number-like token inside free text (fixed pattern of the reference).
NUMBER_TOKEN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_upper(c: str | Column) -> Column:
    return F.upper(F.trim(_c(c)))


def norm_eq(c: str | Column, value: str) -> Column:
    """trim + upper equality; null never matches."""
    return F.coalesce(norm_upper(c) == F.lit(value), F.lit(False))


def contains_upper(c: str | Column, token: str) -> Column:
    """Case-folded substring test; null never matches."""
    return F.coalesce(F.upper(_c(c)).contains(token), F.lit(False))


def regex_contains(c: str | Column, pattern: str) -> Column:
    """Case-sensitive regex search anywhere in the value; null -> false."""
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def nan_to_null(c: str | Column) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: str | Column) -> Column:
    """Coerce text to double; anything that is not a plain number -> null."""
    c = _c(c).cast("string")
    return F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))


def to_int(c: str | Column) -> Column:
    """Coerce text to a whole number (nullable int); fractional -> null.

    Plain integers take the direct cast; only other number spellings go
    through the guarded double parse."""
    s = F.trim(_c(c).cast("string"))
    d = to_double(s)
    return F.coalesce(s.try_cast("int"), F.when(d == F.floor(d), d.try_cast("int")))


def extract_number(c: str | Column) -> Column:
    """Direct parse wins; else the first number-like token; empty -> null."""
    s = F.trim(_c(c).cast("string"))
    token = F.regexp_extract(s, NUMBER_TOKEN, 0)
    return F.coalesce(to_double(s), F.when(token != "", token.try_cast("double")))


def is_finite(c: str | Column) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clip(c: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """Clip to [lo, hi] keeping null (greatest/least alone would skip null)."""
    c = _c(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, _c(lo)), _c(hi)))


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round half away from zero on the scaled double: round(x * 10^d) / 10^d.

    Spelled out (instead of ``round``, which rounds the decimal text of the
    double) so that exact ties resolve the same way as in SQL engines that
    scale in binary; non-finite values pass through.
    """
    c = _c(c).cast("double")
    m = float(10 ** digits)
    v = c * F.lit(m)
    r = F.signum(v) * F.floor(F.abs(v) + F.lit(0.5)).cast("double")
    return (F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), c)
             .when(F.abs(v) < F.lit(2.0 ** 52), r / F.lit(m))
             .otherwise(v / F.lit(m)))


def first_present(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate that is a column name (plan-shaping helper)."""
    cols = set(columns)
    return next((c for c in candidates if c in cols), None)


# Fixed coefficients of the rational approximation of the standard normal
# quantile function (Acklam, 2003; relative error below 1.2e-9).
_PA = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_PB = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
       6.680131188771972e+01, -1.328068155288572e+01]
_PC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
       -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_PD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
       3.754408661907416e+00]
P_LOW = 0.02425


def _horner(coeffs: Sequence[float], x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for k in coeffs[1:]:
        acc = acc * x + F.lit(k)
    return acc


def probit(p: str | Column) -> Column:
    """Standard normal quantile as a Column expression."""
    p = _c(p)
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lower = _horner(_PC, q_lo) / (_horner(_PD, q_lo) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    upper = -_horner(_PC, q_hi) / (_horner(_PD, q_hi) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    central = _horner(_PA, r) * q / (_horner(_PB, r) * r + F.lit(1.0))
    return (F.when(p < P_LOW, lower)
             .when(p > F.lit(1.0 - P_LOW), upper)
             .otherwise(central))
