"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int) -> Column:
    """Round half up in plain double arithmetic.

    ``F.round`` on doubles goes through a decimal per row; this stays in generated code and
    gives bit-identical results in any engine with IEEE doubles.
    """
    scale = float(10**digits)
    return F.floor(as_col(x) * scale + 0.5).cast("double") / scale


def cents(x) -> Column:
    """Two-decimal amount as an integer, so that sums do not depend on their order."""
    return F.floor(as_col(x) * 100.0 + 0.5).cast("bigint")


def finite(x) -> Column:
    """NULL for NaN and infinities: the library knows one missing value only."""
    c = as_col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(num, den) -> Column:
    """num / den as double, NULL when the denominator is 0 or missing."""
    d = as_col(den).cast("double")
    return F.when(d != 0.0, as_col(num).cast("double") / d)
