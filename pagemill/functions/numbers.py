"""Scalar functions of numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """x, 0 to some thousands, at so many decimal places: the nearest to its exact binary value, of two as near the even one.

    The built-in function rounds the shortest decimal that names x, so that 2.675, which is a little less, gives 2.68. Here
    twice the scaled value is an odd number at most a rounding error away where that matters; x is split in two parts
    whose products are exact, and the sign of what is left decides.
    """
    twice = float(2 * 10**places)
    k = F.rint(x * twice)
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits
    rest = (high * twice - k) + (x - high) * twice
    low = F.floor(k / 2)
    up = (rest > 0) | ((rest == 0) & (low % 2 == 1))
    return F.when((k % 2 == 1) & up, low + 1).otherwise(low) / float(10**places)


def sql_rounded(x: str, places: int) -> str:
    """rounded() as DuckDB's SQL."""
    twice, exact = f"{2 * 10**places}::DOUBLE", f"({x})::DOUBLE"
    k = f"round_even({exact} * {twice}, 0)"
    high = f"({exact} * 134217729::DOUBLE - ({exact} * 134217729::DOUBLE - {exact}))"
    rest = f"(({high} * {twice} - {k}) + ({exact} - {high}) * {twice})"
    low = f"floor({k} / 2)"
    return f"((CASE WHEN {k} % 2 = 1 AND ({rest} > 0 OR ({rest} = 0 AND {low} % 2 = 1)) THEN {low} + 1 ELSE {low} END) / {10**places}::DOUBLE)"
