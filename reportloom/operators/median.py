"""Exact medians by counting, so that no task ever holds a group.

Equal values are counted before the shuffle and written once to the staging folder. Everything else reads that table:
counting finds the stretch of values that holds the middle, first among 4,096 stretches per power of two (at any magnitude), then,
in the stretch found, among 2**20 equal parts; the values of the last sliver are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.functions.aggregates import from_micros, is_moment, micros
from reportloom.operators.columns import present, ref, value_of
from reportloom.plans.staging import settle

_PER_POWER_OF_TWO = 4096
_PARTS = 2**20
#: Apart by more than the stretches of one power of two, and above the powers of two of all doubles.
_STEP, _POWERS = 8192, 1100


def _carried(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column as it is counted: whole numbers and moments as bigint, decimals as they are, all else as double."""
    dtype, value = df.schema[name].dataType, value_of(df, name)
    if is_moment(dtype):
        return micros(value), "bigint"
    if isinstance(dtype, T.LongType):
        return value, "bigint"
    if isinstance(dtype, T.DecimalType):
        return value, dtype.simpleString()
    return value.cast("double"), "double"


def _between(low: Column, high: Column, dtype: T.DataType) -> Column:
    """The middle of two neighbours: a time for moments, a decimal for decimals, else a double."""
    if is_moment(dtype):
        wide = low.cast("decimal(38,0)") + high.cast("decimal(38,0)")
        return from_micros(F.floor(wide / 2).cast("bigint"))
    if isinstance(dtype, T.LongType):
        return ((low.cast("decimal(20,0)") + high.cast("decimal(20,0)")) / 2).cast("double")
    if isinstance(dtype, T.DecimalType):
        # One digit more where 38 hold it; else the half is rounded.
        scale = dtype.scale + 1 if dtype.precision < 38 else dtype.scale
        half = ((high - low).cast("decimal(38,0)") / 2 if dtype.scale == 0 else (high - low) / 2).cast(f"decimal(38,{scale})")
        return (low.cast(f"decimal(38,{scale})") + half).cast(f"decimal(38,{scale})")
    total = low + high
    return F.when(F.abs(total) == float("inf"), low / 2 + high / 2).otherwise(total / 2)


def group_medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """``keys`` and the exact median of each value column under its result name.

    Medians of numbers are doubles, of decimals decimals with one more digit where 38 suffice, of dates and times times. Groups without any
    value are absent. Columns counted alike go through one pass, whose counts are written here.
    """
    groups = [f"__g{i}" for i in range(len(keys))]
    rows = df.where(reduce(lambda a, b: a & b, [present(df, k) for k in keys]))
    grouped = [ref(k).alias(g) for k, g in zip(keys, groups)]
    alike: dict[str, list[tuple[str, str, Column]]] = {}
    for name, result in values.items():
        column, carrier = _carried(df, name)
        alike.setdefault(carrier, []).append((name, result, column))
    found = None
    for items in alike.values():
        pairs = [F.struct(F.lit(result).alias("of"), column.alias("v")) for _, result, column in items]
        counted = rows.select(*grouped, F.inline(F.array(*pairs))).where(F.col("v").isNotNull())
        counted = settle(counted.groupBy(*groups, "of", "v").agg(F.count(F.lit(1)).alias("n")), "medians")
        middles = _middles(counted, [*groups, "of"])
        own = [
            F.max(F.when(F.col("of") == result, _between(F.col("low_v"), F.col("high_v"), df.schema[name].dataType))).alias(result)
            for name, result, _ in items
        ]
        medians = middles.groupBy(*groups).agg(*own)
        found = medians if found is None else found.join(medians, groups, "full")
    return found.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], *[ref(r) for r in values.values()])


def _stretch(x: Column) -> Column:
    """Number of the stretch that holds a double; in the order of the doubles, from the power of two and the part of it."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * _PER_POWER_OF_TWO)
    place = F.when(size == float("inf"), F.lit(2 * _POWERS * _STEP)).otherwise((power + _POWERS) * _STEP + part)
    return F.when(x == 0, F.lit(0)).when(x < 0, -place).otherwise(place).cast("bigint")


def _around_middle(counted: DataFrame, within: Sequence[str], by: str) -> DataFrame:
    """Rows whose run of ranks touches the middle; ``start`` becomes the ranks before the row."""
    ahead = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum("n").over(ahead), F.lit(0))
    placed = counted.withColumn("start", start)
    return placed.where((F.col("start") < F.col("high")) & (F.col("start") + F.col("n") >= F.col("low")))


def _middles(counted: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The two middle values (the same one twice, for odd numbers) of each group of counted values."""
    x = F.col("v").cast("double")
    rows = counted.withColumn("coarse", _stretch(x))
    stretches = rows.groupBy(*groups, "coarse").agg(
        F.sum("n").alias("n"), F.min(x).alias("from_x"), F.max(x).alias("to_x")
    )
    total = F.sum("n").over(Window.partitionBy(*groups))
    ranked = stretches.select(
        "*",
        F.floor((total + 1) / 2).alias("low"),
        F.floor((total + 2) / 2).alias("high"),
        F.lit(0).cast("bigint").alias("start"),
    )
    middle = _around_middle(ranked, groups, "coarse").drop("n")
    width = F.nullif(F.col("to_x") - F.col("from_x"), F.lit(0.0))
    fine = F.coalesce(F.floor((x - F.col("from_x")) / width * _PARTS), F.lit(0))
    part = [*groups, "coarse", "fine"]
    inside = rows.join(middle, [*groups, "coarse"]).withColumn("fine", fine)
    parts = inside.groupBy(*part, "low", "high", "start").agg(F.sum("n").alias("n"))
    found = _around_middle(parts, [*groups, "coarse"], "fine").select(*part, "start")
    values = _around_middle(inside.drop("start").join(found, part), part, "v")
    return values.groupBy(*groups).agg(F.min("v").alias("low_v"), F.max("v").alias("high_v"))
