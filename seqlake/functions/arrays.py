"""One row per array element, with the array worked out once.

A plain ``posexplode`` makes the optimizer add a filter on the size of the array, which works the
array out a second time, and again for each step of its making. The outer form has no such filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_with_place(df: DataFrame, keep: list[str], array: Column, place: str, value: str) -> DataFrame:
    """``keep`` and one row per element: its place from 0, and its value. An empty array gives none."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(place, value))
    return rows.filter(F.col(place).isNotNull())
