"""Columns that are evaluated once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, as withColumns gives them, but as a generator of one row. Filters and projections that use a column of a
    plain projection are planned below it with its whole expression in place of each use; nothing moves below a generator."""
    kept = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*kept, made).select(*df.columns, *(k for k in columns if k not in df.columns))
