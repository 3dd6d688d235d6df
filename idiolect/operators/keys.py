"""Joins of groups: a null key, as that of a writer without a name, is a group like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right where their keys are equal or both null: left's columns, then right's others."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same: Column = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    both = left.join(named, same, how)
    return both if how in ("left_semi", "left_anti") else both.drop(*(f"__{k}" for k in keys))
