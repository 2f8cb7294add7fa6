"""Grouped aggregates and pivot tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.functions.aggregates import (
    AGGREGATES,
    MEDIAN,
    NEVER_NULL,
    check_function,
    is_moment,
    mean_moment,
)
from reportloom.operators.columns import present, ref, value_of
from reportloom.operators.lookup import COLLISION_SUFFIX
from reportloom.operators.median import group_medians
from reportloom.plans.staging import settle

_CELL = "__cell"
_KEY_SEPARATOR = "\u0001"


def _check(df: DataFrame, group_by: Sequence[str], pivot: Sequence[str], values: Mapping[str, str]):
    if not values:
        raise ValueError("nothing to aggregate")
    if not group_by and not pivot:
        raise ValueError("values need group or pivot columns")
    for fn in values.values():
        check_function(fn)
    missing = [c for c in [*group_by, *pivot, *values] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    both = [c for c in [*group_by, *pivot] if c in values]
    if both:
        raise ValueError(f"keys cannot be values too: {both}")


def _aggregate(df: DataFrame, name: str, fn: str, order: Sequence[Column]) -> Column:
    if fn in ("mean", "avg") and is_moment(df.schema[name].dataType):
        return mean_moment(ref(name))
    return AGGREGATES[fn](value_of(df, name), order)


def _grouped(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, str], order_by: Sequence[str]
) -> DataFrame:
    """One row per key combination: keys and values in name order, nulls not yet filled.

    Rows with a null key are out, and so are groups that have nothing but nulls to show.
    """
    df = df.where(reduce(lambda a, b: a & b, [present(df, k) for k in keys]))
    order = [value_of(df, c) for c in order_by]
    names = sorted(values)
    plain = [n for n in names if values[n] != MEDIAN]
    medians = {n: f"__v_{n}" for n in names if values[n] == MEDIAN}
    aggregates = [_aggregate(df, n, values[n], order).alias(f"__v_{n}") for n in plain]
    result = df.groupBy(*[ref(k) for k in keys]).agg(*aggregates) if plain else None
    if medians:
        found = group_medians(df, keys, medians)
        result = found if result is None else result.join(found, list(keys), "left")
    cells = [ref(f"__v_{n}") for n in names]
    if not any(values[n] in NEVER_NULL for n in names):
        result = result.where(F.coalesce(*[c.cast("string") for c in cells]).isNotNull())
    return result.select(*[ref(k) for k in keys], *[c.alias(n) for c, n in zip(cells, names)])


def _zero_filled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numeric results without a value become 0; text and dates stay null."""

    def filled(field: T.StructField) -> Column:
        if field.name in keys or not isinstance(field.dataType, T.NumericType):
            return ref(field.name)
        return F.coalesce(ref(field.name), F.lit(0).cast(field.dataType)).alias(field.name)

    return df.select([filled(f) for f in df.schema.fields])


def group_agg(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Group by ``keys`` and apply one function per value column.

    Null keys are dropped, numeric results without a value are 0, value columns keep
    their names and come in name order. ``order_by`` serves ``first`` and ``last``.
    """
    _check(df, keys, (), values)
    return _zero_filled(_grouped(df, keys, values, order_by), keys)


def _cell_id(columns: Sequence[Column]) -> Column:
    # The leading mark keeps the id, which becomes a column name, from being empty.
    return F.concat_ws(_KEY_SEPARATOR, F.lit("p"), *[c.cast("string") for c in columns])


def _distinct_names(taken: Sequence[str], names: Iterable[str]) -> list[str]:
    """Names with repeats marked: keys such as (a_b, c) and (a, b_c) spell the same name."""
    seen = {t.lower() for t in taken}
    result = []
    for name in names:
        while name.lower() in seen:
            name += COLLISION_SUFFIX
        seen.add(name.lower())
        result.append(name)
    return result


def _combinations(cells: DataFrame, pivot: Sequence[str]) -> list:
    """Pivot key combinations that occur, in typed order. They become columns, so the caller wants them on the driver."""
    columns = [ref(p) for p in pivot]
    return cells.select(*columns, F.col(_CELL)).distinct().orderBy(*columns).collect()


def pivot_long(
    df: DataFrame,
    group_by: Sequence[str],
    pivot_cols: Sequence[str],
    values: Mapping[str, str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The cells of a pivot table one below the other: group keys, pivot keys, ``measure`` and ``value``.

    For pivot keys that are too many to be columns. Cells that occur have a row per value column; numbers
    without a value are 0; differing types of results meet as ``double``, or as text.
    """
    _check(df, group_by, pivot_cols, values)
    keys = [*group_by, *pivot_cols]
    cells = _zero_filled(_grouped(df, keys, values, order_by), keys)
    return _measures(cells, [ref(k) for k in keys], sorted(values), "measure", "value")


def pivot_table(
    df: DataFrame,
    group_by: Sequence[str],
    pivot_cols: Sequence[str],
    values: Mapping[str, str],
    pivot_values: Sequence | None = None,
    renames: Mapping[str, str] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Group keys down, values of ``pivot_cols`` across, one column ``value_pivot`` each.

    The result's columns depend on the data. With ``pivot_values`` (plain values, or
    tuples for several pivot columns) the plan stays lazy and other pivot values are
    filtered out at the scan. Without, the aggregated cells are written once to the
    staging folder, and both the column list and the result are read from there, so
    the source is not read twice.
    """
    _check(df, group_by, pivot_cols, values)
    if not pivot_cols:
        return rename_pivot(group_agg(df, group_by, values, order_by), renames or {})
    pivot_types = [df.schema[p].dataType for p in pivot_cols]

    wanted = None
    if pivot_values is not None:
        tuples = [v if isinstance(v, tuple) else (v,) for v in pivot_values]
        schema = T.StructType([T.StructField(p, t) for p, t in zip(pivot_cols, pivot_types)])
        listed = df.sparkSession.createDataFrame(tuples, schema)
        wanted = listed.withColumn(_CELL, _cell_id([ref(p) for p in pivot_cols])).collect()
        for i, p in enumerate(pivot_cols):
            df = df.where(ref(p).isin(list({t[i] for t in tuples})))

    df = df.withColumn(_CELL, _cell_id([ref(p) for p in pivot_cols]))
    if wanted is not None:
        if len(pivot_cols) > 1:
            df = df.where(F.col(_CELL).isin([row[_CELL] for row in wanted]))
        cells = _grouped(df, [*group_by, _CELL], values, order_by)
    else:
        cells = settle(_grouped(df, [*group_by, *pivot_cols, _CELL], values, order_by), "pivot")
        wanted = _combinations(cells, pivot_cols)

    ids = [row[_CELL] for row in wanted]
    labels = ["_".join(str(row[p]) for p in pivot_cols) for row in wanted]
    names = sorted(values)
    if group_by:
        result = _spread(cells, group_by, names, ids, labels)
    else:
        result = _spread_values(cells, names, ids, labels)
    return rename_pivot(result, renames or {})


def _spread(cells: DataFrame, group_by, names, ids, labels) -> DataFrame:
    # A cell occurs once, so max only moves it into place.
    moved = cells.groupBy(*[ref(g) for g in group_by]).pivot(_CELL, ids)
    wide = moved.agg(*[F.max(ref(n)).alias(f"v{i}") for i, n in enumerate(names)])
    # Spark leaves the aggregate's name out when there is only one.
    mark = "" if len(names) == 1 else "_v{}"
    columns = [ref(cell + mark.format(i)) for i in range(len(names)) for cell in ids]
    wanted = [f"{name}_{label}".strip("_") for name in names for label in labels]
    columns = [c.alias(n) for c, n in zip(columns, _distinct_names(group_by, wanted))]
    return _zero_filled(wide.select(*[ref(g) for g in group_by], *columns), group_by)


def _measures(cells: DataFrame, keys: Sequence[Column], names: Sequence[str], title: str, value: str) -> DataFrame:
    """One row per cell and value column: the keys, the column's name and its value in a common type."""
    types = {cells.schema[n].dataType.simpleString() for n in names}
    numeric = all(isinstance(cells.schema[n].dataType, T.NumericType) for n in names)
    common = types.pop() if len(types) == 1 else "double" if numeric else "string"
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias(title), ref(n).cast(common).alias(value)) for n in names])
    )
    return cells.select(*keys, pairs.alias("__pair")).select(*keys, f"__pair.{title}", f"__pair.{value}")


def _spread_values(cells: DataFrame, names, ids, labels) -> DataFrame:
    """Without group keys: one row per value column, named in ``index``."""
    long = _measures(cells, [F.col(_CELL)], names, "index", "v")
    wide = long.groupBy("index").pivot(_CELL, ids).agg(F.max("v"))
    titles = _distinct_names(["index"], [label.strip("_") for label in labels])
    wide = wide.select("index", *[ref(c).alias(t) for c, t in zip(ids, titles)])
    return _zero_filled(wide, ["index"])


def _renamed(name: str, renames: Mapping[str, str], columns: Sequence[str]) -> str:
    """The new name of one column: by the last rename that fits it. A rename of a whole name fits that column only."""
    for old, new in reversed(list(renames.items())):
        if old == name:
            return new
        if old in columns:
            continue
        if name.startswith(old + "_"):
            return new + name[len(old) :]
        if name.endswith("_" + old):
            return name[: -len(old)] + new
    return name


def pivot_renames(columns: Sequence[str], renames: Mapping[str, str]) -> dict[str, str]:
    """Column renames meant by ``{old: new}``.

    ``old`` is a whole name, or the part before or after an underscore of any number of names.
    """
    meant = {name: _renamed(name, renames, columns) for name in columns}
    return {name: new for name, new in meant.items() if new != name}


def rename_pivot(df: DataFrame, renames: Mapping[str, str] | Iterable[tuple[str, str]]) -> DataFrame:
    """Rename columns of a pivot table by the rules of :func:`pivot_renames`."""
    mapping = pivot_renames(df.columns, dict(renames))
    return df.select([ref(c).alias(mapping.get(c, c)) for c in df.columns]) if mapping else df
