"""Rounding to the nearest decimal of a double's exact value, ties to even: what round(x, digits) gives in Python.

x * 10^d is rounded itself, so it can look like a tie where there is none. The product's error is a double, too, and is
found by splitting x in two halves of 26 bits (134217729 is 2^27 + 1); only in a seeming tie does its sign decide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_sql(x: str, digits: int) -> str:
    """SQL for x, a double, rounded. x is written out several times and should be short."""
    scale = f"{10**digits}D"
    high = f"(134217729D * {x} - (134217729D * {x} - {x}))"
    product = f"({x} * {scale})"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    return f"(rint(case when {product} - floor({product}) = 0.5D then {product} + 0.25D * signum({error}) else {product} end) / {scale})"


def rounded(x: Column, digits: int) -> Column:
    """x rounded, made once."""
    return F.element_at(F.transform(F.array(x.cast("double")), lambda v: _rounded(v, float(10**digits))), 1)


def _rounded(v: Column, scale: float) -> Column:
    high = 134217729.0 * v - (134217729.0 * v - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    return F.rint(F.when(product - F.floor(product) == 0.5, product + 0.25 * F.signum(error)).otherwise(product)) / scale


def rate(count: Column | str, total: Column | str, per: int) -> Column:
    """count occurrences per `per` of total, 4 places; 0.0 without a total. Strings are SQL expressions: a plan with
    hundreds of rates is built in one call for each."""
    if isinstance(count, str) and isinstance(total, str):
        x = f"(cast({count} as double) * {per}D / cast({total} as double))"
        return F.expr(f"case when {total} > 0 then {rounded_sql(x, 4)} else 0D end")
    return F.when(total > 0, rounded(count.cast("double") * float(per) / total.cast("double"), 4)).otherwise(F.lit(0.0))


def ratio(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    if isinstance(a, str) and isinstance(b, str):
        return F.expr(f"case when {b} > 0 then {rounded_sql(f'(cast({a} as double) / cast({b} as double))', digits)} else 0D end")
    return F.when(b > 0, rounded(a.cast("double") / b.cast("double"), digits)).otherwise(F.lit(0.0))


def whole(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(x).cast("int")
