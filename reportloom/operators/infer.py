"""Numbers and dates out of text columns, decided over the whole column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.operators.columns import ref

# What counts as a whole number, a number, the start of a date.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_TEXT = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
DATE_SHARE = 0.5
DECIMAL_DIGITS = 38


def parse_moment(text: Column) -> Column:
    """Date or date and time written ``y-m-d`` or ``y/m/d``; anything else is null."""
    dashed = F.regexp_replace(text, r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.when(text.rlike(DATE_TEXT), dashed.try_cast("timestamp_ntz"))


_WHOLE = ("bigint", "int", f"decimal({DECIMAL_DIGITS},0)")
_KINDS = ("empty", "whole", "wide", "huge", "number", "moment", "text")


def _kind(text: Column) -> Column:
    """What one value looks like; each value is looked at once, the cheapest test first."""
    return (
        F.when(text == "", "empty")
        # No number or date begins with a sign beyond the digits, and no number ends with one.
        .when(text >= ":", "text")
        .when(F.substring(text, -1, 1).between(":", "~"), F.when(text.rlike(DATE_TEXT), "moment").otherwise("text"))
        .when(
            text.rlike(INTEGER_TEXT),
            F.when(text.try_cast("bigint").isNotNull(), "whole")
            .when(text.try_cast(f"decimal({DECIMAL_DIGITS},0)").isNotNull(), "wide")
            .otherwise("huge"),
        )
        .when(text.rlike(NUMBER_TEXT), "number")
        .when(text.rlike(DATE_TEXT), "moment")
        .when(text.isNotNull(), "text")
    )


def infer_schema(df: DataFrame, keep_text: Iterable[str] = ()) -> dict[str, str]:
    """Type found for each text column: one aggregate over all of them, one row to the driver.

    Numbers win when every value parses (empty text counts as missing), then dates
    when at least half of the values look like one. Columns left as text are not listed.
    """
    kept = set(keep_text)
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in kept
    ]
    if not names:
        return {}
    kinds = df.select([_kind(ref(c)).alias(f"kind{i}") for i, c in enumerate(names)])
    seen = kinds.agg(
        *[
            F.count_if(F.col(f"kind{i}") == kind).alias(f"{kind}{i}")
            for i in range(len(names))
            for kind in _KINDS
        ]
    ).first()
    found = {}
    for i, name in enumerate(names):
        empty, whole, wide, huge, number, moment, text = (seen[f"{kind}{i}"] for kind in _KINDS)
        numbers = whole + wide + huge + number
        if not moment and not text:
            if not numbers or huge or number:
                found[name] = "double"
            else:
                found[name] = f"decimal({DECIMAL_DIGITS},0)" if wide else "bigint"
        elif moment >= (empty + numbers + moment + text) * DATE_SHARE:
            found[name] = "timestamp_ntz"
    return found


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Convert text columns to known number types or ``timestamp_ntz``; what does not parse becomes null."""

    def converted(name: str) -> Column:
        wanted = types.get(name)
        if wanted is None:
            return ref(name)
        if wanted == "timestamp_ntz":
            return parse_moment(ref(name)).alias(name)
        # A failed conversion costs an exception, so text that cannot be a number is not tried.
        pattern = INTEGER_TEXT if wanted in _WHOLE else NUMBER_TEXT
        return F.when(ref(name).rlike(pattern), ref(name).try_cast(wanted)).alias(name)

    return df.select([converted(c) for c in df.columns])


def infer_types(
    df: DataFrame, keep_text: Iterable[str] = (), types: dict[str, str] | None = None
) -> DataFrame:
    """Text columns as the numbers or dates they hold.

    With ``types`` (from an earlier :func:`infer_schema`, say) nothing is scanned.
    """
    return apply_types(df, infer_schema(df, keep_text) if types is None else types)
