"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with a column that filters and generators above don't compute again, as they do with what a projection holds."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
