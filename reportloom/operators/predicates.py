"""Row conditions.

A builder such as ``eq("city", "Oslo")`` returns a condition: a function that
looks at a table's column types and gives the boolean ``Column``. Missing values
fail every condition except ``ne``, ``not_in``, ``not_contains`` and ``is_null``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable
from datetime import date, datetime
from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.operators.columns import is_float, present, ref
from reportloom.operators.lookup import mark_rows

Condition = Callable[[DataFrame], Column]

_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
_DATE = re.compile(r"\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})([ T].*?)?\s*")
# Signs that part a pasted list, plain and full width.
LIST_SEPARATORS = "\t\n,;，；"
#: Values up to which a list stands in the plan itself.
SHORT_LIST = 1000


def _number(value) -> int | float | Decimal | None:
    """The value as a number, digit for digit: text without an exponent never passes through a float."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float, Decimal)):
        return value
    if isinstance(value, str) and _NUMBER.fullmatch(value):
        if re.fullmatch(r"\s*[+-]?\d+\s*", value):
            return int(value)
        return float(value) if "e" in value.lower() else Decimal(value.strip())
    return None


def _as_float(number: int | float | Decimal) -> float:
    try:
        return float(number)
    except OverflowError:
        return math.copysign(math.inf, number)


def _number_literal(number: int | float | Decimal, dtype: T.DataType) -> Column:
    """A literal that compares with the column without losing digits of either."""
    if is_float(dtype) or isinstance(number, float):
        return F.lit(_as_float(number))
    if isinstance(number, int):
        if -(2**63) <= number < 2**63:
            return F.lit(number)
        number = Decimal(number)
    sign, digits, exponent = number.as_tuple()
    # Spark's decimals have 38 digits; no column value has more, so order alone matters beyond.
    if not isinstance(exponent, int) or max(len(digits), -exponent, len(digits) + exponent) > 38:
        return F.lit(_as_float(number))
    scale = max(0, -exponent)
    return F.lit(str(number)).cast(f"decimal({max(len(digits) + max(exponent, 0), scale, 1)},{scale})")


def _moment(value) -> str | None:
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    found = _DATE.fullmatch(str(value))
    if not found:
        return None
    year, month, day, rest = found.groups()
    try:
        return datetime.fromisoformat(f"{year}-{month:0>2}-{day:0>2}{rest or ''}").isoformat()
    except ValueError:
        return None


def _literal(df: DataFrame, name: str, value) -> Column | None:
    """The value as a literal comparable with the column, or None when nothing can equal it."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        number = _number(value)
        return None if number is None else _number_literal(number, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        moment = _moment(value)
        # A date column against a time of day compares as time, not as a cut date.
        wanted = "timestamp_ntz" if isinstance(dtype, T.DateType) else dtype.simpleString()
        return None if moment is None else F.lit(moment).cast(wanted)
    if isinstance(dtype, T.BooleanType):
        return F.lit(bool(value)) if isinstance(value, (bool, int, float)) and value in (0, 1) else None
    return F.lit(str(value))


def _ordering(symbol: str) -> Callable[[str, object], Condition]:
    def build(name: str, value) -> Condition:
        def condition(df: DataFrame) -> Column:
            dtype = df.schema[name].dataType
            literal = _literal(df, name, value)
            if literal is None or (isinstance(dtype, T.StringType) and not isinstance(value, str)):
                raise TypeError(f"{name!r} ({dtype.simpleString()}) cannot be ordered against {value!r}")
            column = ref(name)
            if symbol == "<":
                return column < literal
            if symbol == "<=":
                return column <= literal
            test = column > literal if symbol == ">" else column >= literal
            # Spark sorts NaN above every number; here it is a missing value.
            return test & ~F.isnan(column) if is_float(dtype) else test

        return condition

    return build


gt = _ordering(">")
ge = _ordering(">=")
lt = _ordering("<")
le = _ordering("<=")


def eq(name: str, value) -> Condition:
    """Equal. A number against text compares as text."""

    def condition(df: DataFrame) -> Column:
        literal = _literal(df, name, value)
        return F.lit(False) if literal is None else ref(name) == literal

    return condition


def ne(name: str, value) -> Condition:
    """Not equal; missing values stay."""

    def condition(df: DataFrame) -> Column:
        literal = _literal(df, name, value)
        return F.lit(True) if literal is None else ~ref(name).eqNullSafe(literal)

    return condition


def between(name: str, low, high) -> Condition:
    """Within a range, both ends included."""
    return all_of(ge(name, low), le(name, high))


def _text(df: DataFrame, name: str) -> Column:
    return ref(name) if isinstance(df.schema[name].dataType, T.StringType) else ref(name).cast("string")


def contains(name: str, text: str, regex: bool = True) -> Condition:
    """Text found in the column, as a regular expression unless ``regex=False``."""

    def condition(df: DataFrame) -> Column:
        column = _text(df, name)
        return F.coalesce(column.rlike(text) if regex else column.contains(text), F.lit(False))

    return condition


def not_contains(name: str, text: str, regex: bool = True) -> Condition:
    """Text not found in the column; missing values stay."""
    return lambda df: ~contains(name, text, regex)(df)


def starts_with(name: str, text: str) -> Condition:
    return lambda df: _text(df, name).startswith(text)


def ends_with(name: str, text: str) -> Condition:
    return lambda df: _text(df, name).endswith(text)


def _value_table(df: DataFrame, name: str, values: list) -> DataFrame | None:
    """The values that can equal the column, as a table of one column ``value`` in the column's own kind of type.

    None for types whose lists cannot be long, or whose values compare with numbers of another width.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        scale, whole = (dtype.scale, dtype.precision - dtype.scale) if isinstance(dtype, T.DecimalType) else (0, 19)
        numbers = [number for v in values if (number := _number(v)) is not None]
        exact = [Decimal(repr(n)) if isinstance(n, float) else Decimal(n) for n in numbers]
        found = [text for n in exact if (text := _digits(n, whole, scale)) is not None]
        wanted = dtype.simpleString() if isinstance(dtype, T.DecimalType) else "bigint"
    elif isinstance(dtype, T.DoubleType):
        found = [str(_as_float(number)) for v in values if (number := _number(v)) is not None]
        found += ["-0.0", "0.0"] if {"-0.0", "0.0"} & set(found) else []
        wanted = "double"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        found = [moment for v in values if (moment := _moment(v)) is not None]
        wanted = "timestamp_ntz" if isinstance(dtype, T.DateType) else dtype.simpleString()
    elif isinstance(dtype, T.StringType):
        found, wanted = [str(v) for v in values], "string"
    else:
        return None
    rows = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(found)], "value string")
    table = rows.select(F.col("value").try_cast(wanted).alias("value"))
    # Dates meet times of day as times.
    return table.where(F.col("value") == F.date_trunc("day", "value")).select(F.col("value").cast("date").alias("value")) if isinstance(dtype, T.DateType) else table


def _digits(number: Decimal, whole: int, scale: int) -> str | None:
    """The number in plain digits, if it has at most ``whole`` of them before the point and ``scale`` behind it."""
    if not number.is_finite() or number.adjusted() >= whole:
        return None
    cut = number.quantize(Decimal(1).scaleb(-scale), context=Context(prec=80))
    return format(cut, "f") if cut == number else None


def in_table(name: str, values: DataFrame, value_name: str) -> Condition:
    """Equal to a value of another table's column; like every condition it may stand inside ``any_of`` and ``all_of``.

    ``filter_rows`` joins a mark to the rows before it looks at the whole condition, so the values may be as many as rows.
    """
    mark = f"__in_{uuid.uuid4().hex}"

    def condition(df: DataFrame) -> Column:
        return ref(mark)

    condition.marks = {mark: lambda df: mark_rows(df, [name], values, [value_name], mark)}
    return condition


def not_in_table(name: str, values: DataFrame, value_name: str) -> Condition:
    """Equal to no value of another table's column; missing values stay."""
    return _negated(in_table(name, values, value_name))


def is_in(name: str, values: Iterable) -> Condition:
    """Equal to a value of a list. A list of more than ``SHORT_LIST`` values becomes a table that meets the rows in a join."""
    listed = list(values)
    mark = f"__in_{uuid.uuid4().hex}"

    def condition(df: DataFrame) -> Column:
        if mark in df.columns:
            return ref(mark)
        literals = [lit for v in listed if (lit := _literal(df, name, v)) is not None]
        return ref(name).isin(literals) if literals else F.lit(False)

    def marked(df: DataFrame) -> DataFrame:
        found = _value_table(df, name, listed)
        return df if found is None else mark_rows(df, [name], found, ["value"], mark)

    condition.marks = {mark: marked} if len(listed) > SHORT_LIST else {}
    return condition


def not_in(name: str, values: Iterable) -> Condition:
    """Equal to no value of a list; missing values stay."""
    return _negated(is_in(name, values))


def _negated(inside: Condition) -> Condition:
    def condition(df: DataFrame) -> Column:
        return ~F.coalesce(inside(df), F.lit(False))

    condition.marks = inside.marks
    return condition


def is_null(name: str) -> Condition:
    return lambda df: ~present(df, name) if is_float(df.schema[name].dataType) else ref(name).isNull()


def not_null(name: str) -> Condition:
    return lambda df: present(df, name)


def sql(text: str) -> Condition:
    """Free SQL condition with SQL's own null rules."""
    return lambda df: F.expr(text)


def _joined(sign: Callable[[Column, Column], Column], conditions: tuple[Condition, ...]) -> Condition:
    def condition(df: DataFrame) -> Column:
        return reduce(sign, [c(df) for c in conditions])

    condition.marks = {mark: join for c in conditions for mark, join in getattr(c, "marks", {}).items()}
    return condition


def all_of(*conditions: Condition) -> Condition:
    return _joined(lambda a, b: a & b, conditions)


def any_of(*conditions: Condition) -> Condition:
    return _joined(lambda a, b: a | b, conditions)


# Operator names accepted in a specification.
OPERATORS: dict[str, Callable[..., Condition]] = {
    "==": eq,
    "!=": ne,
    ">": gt,
    ">=": ge,
    "<": lt,
    "<=": le,
    "contains": contains,
    "not contains": not_contains,
    "startswith": starts_with,
    "endswith": ends_with,
    "in": is_in,
    "not in": not_in,
    "between": between,
    "isna": is_null,
    "notna": not_null,
}


def condition_from(spec: dict | str) -> Condition:
    """Condition of a plain specification.

    SQL text; ``{"col", "op", "value"}``; or ``{"all": [...]}`` / ``{"any": [...]}``.
    """
    if isinstance(spec, str):
        return sql(spec)
    if "all" in spec:
        return all_of(*[condition_from(s) for s in spec["all"]])
    if "any" in spec:
        return any_of(*[condition_from(s) for s in spec["any"]])
    name, op, value = spec["col"], spec["op"], spec.get("value")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}; known: {', '.join(OPERATORS)}")
    if op in ("isna", "notna"):
        return OPERATORS[op](name)
    if op == "between":
        return between(name, *value)
    if op in ("in", "not in") and isinstance(value, str):
        value = split_values(value)
    return OPERATORS[op](name, value)


def filter_rows(df: DataFrame, condition: Condition | Column | dict | str | None) -> DataFrame:
    """Rows that meet a condition given in any accepted form."""
    if isinstance(condition, Column):
        return df.where(condition)
    if not condition:
        return df
    if isinstance(condition, (dict, str)):
        condition = condition_from(condition)
    marked = df
    for join in getattr(condition, "marks", {}).values():
        marked = join(marked)
    found = marked.where(condition(marked))
    return found.select(*[ref(c) for c in df.columns]) if marked is not df else found


def split_values(text: str) -> list[str]:
    """Values of a pasted list: cut, trimmed, without empties and repeats, in order."""
    parts = (part.strip() for part in re.split(f"[{LIST_SEPARATORS}]", text))
    return list(dict.fromkeys(part for part in parts if part))


def split_value_table(df: DataFrame, name: str, result: str = "value") -> DataFrame:
    """The same clean-up for lists held in a table column: one row per distinct value."""
    parts = F.explode(F.split(ref(name), f"[{LIST_SEPARATORS}]"))
    cleaned = F.regexp_replace(F.col(result), r"(?U)^\s+|\s+$", "").alias(result)
    return df.select(parts.alias(result)).select(cleaned).where(F.col(result) != "").distinct()
