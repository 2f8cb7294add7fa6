"""The formula catalogue: one helper per kind of derived column.

Arguments that name a column may be a name or a ``Column``. Missing values stay
missing unless a helper says otherwise; text that is not a number, and division by
zero, give a missing value instead of an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportloom.operators.columns import ref
from reportloom.operators.infer import INTEGER_TEXT, NUMBER_TEXT, parse_moment

Operand = Column | str

# Signs that make a pattern more than the text it is.
_PATTERN_SIGNS = frozenset("\\.^$|?*+()[]{}")


def _col(operand: Operand) -> Column:
    return ref(operand) if isinstance(operand, str) else operand


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _number(operand: Operand, wanted: str, pattern: str) -> Column:
    """The column as a number. Text is tested first: a failed conversion costs an exception,
    and Spark would also take text such as ``1d``. ``typeof`` is constant, so one branch remains."""
    column = _col(operand)
    number = column.try_cast(wanted)
    return F.when(F.typeof(column) != "string", number).when(column.cast("string").rlike(pattern), number)


def _int(operand: Operand) -> Column:
    return _number(operand, "bigint", INTEGER_TEXT)


def _float(operand: Operand) -> Column:
    return _number(operand, "double", NUMBER_TEXT)


def _moment(operand: Operand) -> Column:
    """Time of a typed or text column; text with slashes costs a second look only where needed."""
    column = _col(operand)
    typed = column.try_cast("timestamp_ntz")
    return F.when(F.typeof(column) != "string", typed).otherwise(
        F.coalesce(typed, parse_moment(column.cast("string")))
    )


# --- new and constant columns (1-4)


def blank() -> Column:
    return F.lit(None).cast("string")


def empty_text() -> Column:
    return F.lit("")


def constant(value) -> Column:
    return F.lit(value)


# --- arithmetic (5-12)


def add_ints(a: Operand, b: Operand) -> Column:
    return F.try_add(_int(a), _int(b))


def subtract(a: Operand, b: Operand) -> Column:
    return _float(a) - _float(b)


def multiply(a: Operand, b: Operand) -> Column:
    return _float(a) * _int(b)


def divide(a: Operand, b: Operand) -> Column:
    return F.try_divide(_float(a), _int(b))


def scale(a: Operand, factor: float) -> Column:
    return _float(a) * F.lit(factor)


def add_then_scale(a: Operand, b: Operand, factor: float) -> Column:
    return add_ints(a, b) * F.lit(factor)


def remainder(a: Operand, divisor) -> Column:
    """Remainder with the sign of the divisor."""
    a, divisor = _col(a), _lit(divisor)
    rest = F.try_mod(a, divisor)
    return F.when((rest != 0) & ((rest < 0) != (divisor < 0)), rest + divisor).otherwise(rest)


# --- text (13-23)


def join_text(a: Operand, b: Operand) -> Column:
    return F.concat(_col(a), _col(b))


def join_with(separator: str, a: Operand, b: Operand) -> Column:
    return F.concat(_col(a).cast("string"), F.lit(separator), _col(b).cast("string"))


def head_text(a: Operand, n: int) -> Column:
    return F.left(_col(a).cast("string"), F.lit(n))


def tail_text(a: Operand, n: int) -> Column:
    return F.right(_col(a).cast("string"), F.lit(n))


def slice_text(a: Operand, start: int, stop: int) -> Column:
    """Characters from ``start`` up to before ``stop``, counted from 0."""
    return F.substring(_col(a).cast("string"), start + 1, stop - start)


def upper(a: Operand) -> Column:
    return F.upper(_col(a))


def lower(a: Operand) -> Column:
    return F.lower(_col(a))


def strip(a: Operand) -> Column:
    """Without white space at the ends, full-width blanks and tabs included; most texts have none, which two signs tell."""
    column = _col(a)
    first, last = (F.substring(column, place, 1) for place in (1, -1))
    bare = first.between("!", "~") & last.between("!", "~")
    return F.when(bare, column).otherwise(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def replace_text(a: Operand, old: str, new: str) -> Column:
    return F.replace(_col(a), F.lit(old), F.lit(new))


def has_text(a: Operand, pattern: str) -> Column:
    """Whether a pattern is found; one without signs of its own is looked for as the text it is."""
    return _col(a).rlike(pattern) if _PATTERN_SIGNS & set(pattern) else _col(a).contains(pattern)


def text_length(a: Operand) -> Column:
    return F.char_length(_col(a))


# --- conditions and defaults (24-30)


def choose(condition: Column, yes, no) -> Column:
    """Two-way choice; a condition that is null counts as not met."""
    return F.when(condition, _lit(yes)).otherwise(_lit(no))


def choose_first(cases: Sequence[tuple[Column, object]], default) -> Column:
    """Nested choice: the value of the first condition that is met."""
    result = F
    for condition, value in cases:
        result = result.when(condition, _lit(value))
    return result.otherwise(_lit(default))


def number_or(a: Operand, default: float = 0) -> Column:
    """The column as a number, with a default for missing and unreadable values."""
    return F.coalesce(_float(a), F.lit(float(default)))


def default_for(a: Operand, value) -> Column:
    return F.coalesce(_col(a), _lit(value))


def label_missing(a: Operand, missing, given) -> Column:
    return choose(_col(a).isNull(), missing, given)


# --- dates (31-38)


def to_date(a: Operand) -> Column:
    return _moment(a)


def year(a: Operand) -> Column:
    return F.year(_moment(a))


def month(a: Operand) -> Column:
    return F.month(_moment(a))


def day(a: Operand) -> Column:
    return F.dayofmonth(_moment(a))


def year_month(a: Operand) -> Column:
    return F.date_format(_moment(a), "yyyy-MM")


def weekday(a: Operand) -> Column:
    """Day of the week, Monday = 0."""
    return F.weekday(_moment(a))


def _elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end, rounded down also when negative."""
    apart, day = end - start, F.make_dt_interval(F.lit(1))
    days = F.call_function("div", apart, day)
    return days - (apart < day * days).cast("bigint")


def days_apart(end: Operand, start: Operand) -> Column:
    """Days from start to end, null where either is missing."""
    return _elapsed_days(_moment(start), _moment(end))


def days_since(a: Operand, as_of: Column | str | None = None) -> Column:
    """Days from a date to ``as_of`` (a ``Column`` or text), by default to now."""
    if isinstance(as_of, str):
        as_of = F.lit(as_of)
    now = F.current_timestamp() if as_of is None else as_of
    return _elapsed_days(_moment(a), now.try_cast("timestamp_ntz"))


def days_between(end: Operand, start: Operand) -> Column:
    """Days from start to end, 0 where either is missing."""
    return F.coalesce(days_apart(end, start), F.lit(0))


# --- cleaning and conversion (39-45)


def to_int(a: Operand) -> Column:
    return _int(a)


def to_float(a: Operand) -> Column:
    return _float(a)


def to_text(a: Operand) -> Column:
    return _col(a).cast("string")


def round_half_even(a: Operand, digits: int = 0) -> Column:
    return F.bround(_col(a), digits)


def ceil_quotient(a: Operand, divisor) -> Column:
    return F.ceil(F.try_divide(_col(a), _lit(divisor)))


def floor_quotient(a: Operand, divisor) -> Column:
    return F.floor(F.try_divide(_col(a), _lit(divisor)))


# --- combinations (46-50)


def first_given(a: Operand, b: Operand) -> Column:
    return F.coalesce(_col(a), _col(b))


def mask_middle(a: Operand, head: int = 3, tail: int = 4, mask: str = "****") -> Column:
    return F.concat(head_text(a, head), F.lit(mask), tail_text(a, tail))


def digit_from_end(a: Operand, place: int) -> Column:
    """The digit ``place`` characters from the end, as a number."""
    return _int(F.substring(_col(a).cast("string"), -place, 1)).cast("int")


def parity(a: Operand, odd, even) -> Column:
    return choose(F.pmod(_col(a), F.lit(2)) == 1, odd, even)


# Number in the catalogue -> helper. 32-34 and the like differ only by arguments.
CATALOGUE = {
    1: blank, 2: blank, 3: constant, 4: constant,
    5: add_ints, 6: subtract, 7: multiply, 8: divide, 9: scale, 10: scale,
    11: add_then_scale, 12: remainder,
    13: join_text, 14: join_with, 15: head_text, 16: tail_text, 17: slice_text,
    18: upper, 19: lower, 20: strip, 21: replace_text, 22: has_text, 23: text_length,
    24: choose, 25: choose_first, 26: choose, 27: number_or, 28: choose,
    29: default_for, 30: label_missing,
    31: to_date, 32: year, 33: month, 34: day, 35: year_month, 36: weekday,
    37: days_since, 38: days_between,
    39: default_for, 40: to_int, 41: to_float, 42: to_text, 43: round_half_even,
    44: ceil_quotient, 45: floor_quotient,
    46: first_given, 47: head_text, 48: mask_middle, 49: digit_from_end, 50: slice_text,
}
