"""Aggregate functions by report name. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_EPOCH = "timestamp_ntz'1970-01-01'"


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def micros(value: Column) -> Column:
    """Microseconds of a date or time since 1970, as its clock shows it."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), value.cast("timestamp_ntz"))


def from_micros(number: Column) -> Column:
    return F.timestamp_add("MICROSECOND", number, F.expr(_EPOCH))


def mean_moment(value: Column) -> Column:
    """The mean of dates or times, as a time."""
    return from_micros(F.floor(F.avg(micros(value).cast("decimal(20,0)"))).cast("bigint"))


def _ordered(pick) -> Callable[[Column, Sequence[Column]], Column]:
    def build(value: Column, order: Sequence[Column]) -> Column:
        if not order:
            raise ValueError("'first' and 'last' need order_by: Spark rows have no order of their own")
        # The value breaks ties, and rows without a value are passed over.
        return pick(value, F.when(value.isNotNull(), F.struct(*order, value)))

    return build


def _sum(value: Column, order) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _log_product(value: Column, order) -> Column:
    """Natural logarithm of the product, which may itself lie beyond the doubles: -inf of 0, NaN of a negative product."""
    size = F.coalesce(F.sum(F.ln(F.abs(value.cast("double")))), F.lit(0.0))
    zero, negative = F.count_if(value == 0) > 0, F.count_if(value < 0) % 2 == 1
    return F.when(zero, F.lit(float("-inf"))).when(negative, F.lit(float("nan"))).otherwise(size)


def _product(value: Column, order) -> Column:
    plain = F.product(value)
    # A running product may leave the doubles where the whole one lies within them; its logarithm does not.
    lost = (F.abs(plain) == float("inf")) | (plain == 0) | F.isnan(plain)
    sign = F.when(F.count_if(value < 0) % 2 == 1, -1.0).otherwise(1.0)
    again = sign * F.exp(F.sum(F.ln(F.abs(value.cast("double")))))
    found = F.when(lost & (F.count_if(value == 0) == 0), again).otherwise(plain)
    return F.coalesce(found, F.lit(1.0))


def _sem(value: Column, order) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def _skew(value: Column, order) -> Column:
    n = F.count(value).cast("double")
    adjusted = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value)
    flat = F.when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(adjusted)
    return F.when(n >= 3, flat)


# Function names a report may use. ``median`` is planned by
# ``operators.median`` because the built-in one holds a whole group in one buffer.
AGGREGATES: dict[str, Callable[[Column, Sequence[Column]], Column]] = {
    "sum": _sum,
    "mean": lambda c, o: F.avg(c),
    "avg": lambda c, o: F.avg(c),
    "count": lambda c, o: F.count(c),
    "min": lambda c, o: F.min(c),
    "max": lambda c, o: F.max(c),
    "nunique": lambda c, o: F.count_distinct(c),
    "std": lambda c, o: F.stddev_samp(c),
    "var": lambda c, o: F.var_samp(c),
    "first": _ordered(F.min_by),
    "last": _ordered(F.max_by),
    "size": lambda c, o: F.count(F.lit(1)),
    "prod": _product,
    "log_prod": _log_product,
    "sem": _sem,
    "skew": _skew,
    "approx_nunique": lambda c, o: F.approx_count_distinct(c),
    "approx_median": lambda c, o: F.percentile_approx(c, 0.5),
}

MEDIAN = "median"

# Functions that give a value even for a group of nulls only.
NEVER_NULL = {"sum", "count", "nunique", "size", "prod", "log_prod", "approx_nunique"}


def check_function(name: str) -> None:
    if name != MEDIAN and name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join([*AGGREGATES, MEDIAN])}")
