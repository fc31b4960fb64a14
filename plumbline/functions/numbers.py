"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Name, digits: int = 4) -> Column:
    """Half up; 1e-9 is added so that ties don't hang on the order of summation."""
    return F.round(col(x) + F.lit(1e-9), digits)


def ratio(part: Name, whole: Name) -> Column:
    """part / max(whole, 1)."""
    return col(part).cast("double") / F.greatest(col(whole), F.lit(1)).cast("double")


def f1(precision: Name, recall: Name) -> Column:
    p, r = col(precision), col(recall)
    return F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-10))


def mean_or_zero(x: Name) -> Column:
    """Aggregate: the mean, 0 for no rows."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


#: Coefficients of the usual error-function polynomial.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Name, exact: bool = False) -> Column:
    """Normal distribution function by the error-function polynomial, 0 and 1 beyond -8 and 8.

    Published figures put z itself in the polynomial, where z / sqrt(2) belongs, with exp(-z * z / 2); that stays the
    default, so that p-values are comparable. exact=True scales correctly.
    """
    z = col(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(z) / F.lit(2.0**0.5 if exact else 1.0))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + F.lit(a)) * t
    y = F.lit(1.0) - poly * F.exp(-z * z / F.lit(2.0))
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(F.lit(0.5) * (F.lit(1.0) + F.signum(z) * y))


def percent(x: Name, digits: int = 0) -> Column:
    """Text like 12% or 12.5%, ties to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(col(x) * 100, digits))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a digest of the key: the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
