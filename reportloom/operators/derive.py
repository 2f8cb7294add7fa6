"""Derived columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Formula = Column | str | None


def as_column(formula: Formula) -> Column:
    """A ``Column``, SQL text, or nothing for an empty column."""
    if formula is None:
        return F.lit(None).cast("string")
    return formula if isinstance(formula, Column) else F.expr(formula)


def _may_name(formula: Formula, names: Iterable[str]) -> bool:
    """Whether a formula may refer to one of the columns; a ``Column`` tells by how it is written."""
    said = ("" if formula is None else str(formula)).lower()
    return any(name.lower() in said for name in names)


def derive(df: DataFrame, items: Iterable[tuple[str, Formula] | str]) -> DataFrame:
    """Add or overwrite columns from left to right; a later formula sees the earlier ones.

    An item is ``(name, formula)``, or just a name for an empty column. Formulas that name no column made in the same
    step share one projection.
    """
    level: dict[str, Column] = {}
    for item in items:
        name, formula = (item, None) if isinstance(item, str) else item
        if _may_name(formula, level) or name.lower() in (made.lower() for made in level):
            df, level = df.withColumns(level), {}
        level[name] = as_column(formula)
    return df.withColumns(level) if level else df
