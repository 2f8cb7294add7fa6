"""Sorting results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.operators.columns import ref, value_of


def sort_keys(df: DataFrame, by: Iterable[tuple[str, bool] | dict | str]) -> list[tuple[str, bool]]:
    """``(name, ascending)`` pairs the table can be sorted by; unknown names are left out."""
    pairs = []
    for item in by:
        if isinstance(item, dict):
            pairs.append((item["col"], item.get("asc", True)))
        elif isinstance(item, str):
            pairs.append((item, True))
        else:
            pairs.append(tuple(item))
    return [(name, asc) for name, asc in pairs if name in df.columns]


def tie_breaker(df: DataFrame) -> Column:
    """A hash of the row, to spread rows with equal sort keys over tasks."""
    unhashable = (T.MapType, T.VariantType)
    return F.xxhash64(*[ref(f.name) for f in df.schema.fields if not isinstance(f.dataType, unhashable)])


def sort_rows(
    df: DataFrame, by: Iterable[tuple[str, bool] | dict | str], spread_ties: bool = True
) -> DataFrame:
    """Sort by several columns, text without regard to case, missing values last both ways.

    The order of ties is open. ``spread_ties`` orders them by a row hash, because a
    range-partitioned sort puts rows with equal sort keys into one task: with a
    value that a third of the rows share, that task would get all of them.
    """
    keys = sort_keys(df, by)
    if not keys:
        return df
    values, order = {}, []
    for i, (name, ascending) in enumerate(keys):
        value = value_of(df, name)
        if isinstance(df.schema[name].dataType, T.StringType):
            value = F.lower(value)
        values[f"__s{i}"] = value
        key = F.col(f"__s{i}")
        order.append(key.asc_nulls_last() if ascending else key.desc_nulls_last())
    if spread_ties:
        values["__tie"] = tie_breaker(df)
        order.append(F.col("__tie"))
    # As columns the keys are computed once per row, within orderBy once per comparison.
    return df.withColumns(values).orderBy(order).drop(*values)
