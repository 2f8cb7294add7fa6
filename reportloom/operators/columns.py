"""Addressing, projecting and naming columns. Nothing here runs a job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value.
FALLBACK_OUTPUT_NAME = "TASK"


def ref(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def value_of(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, the way every operator here sees missing values."""
    return F.nanvl(ref(name), F.lit(None)) if is_float(df.schema[name].dataType) else ref(name)


def present(df: DataFrame, name: str) -> Column:
    """True where the column holds a value. Kept as plain ``IS NOT NULL`` so it reaches the scan."""
    filled = ref(name).isNotNull()
    return filled & ~F.isnan(ref(name)) if is_float(df.schema[name].dataType) else filled


def column_letter(position: int) -> str:
    """Spreadsheet letter of a zero-based position: 0 is A, 25 is Z, 26 is AA."""
    block, offset = divmod(position, 26)
    tail = chr(ord("A") + offset)
    return tail if block == 0 else column_letter(block - 1) + tail


def letter_position(letters: str) -> int:
    """Zero-based position of a spreadsheet letter."""
    total = 0
    for power, char in enumerate(reversed(letters.upper())):
        total += (ord(char) - ord("A") + 1) * 26**power
    return total - 1


class _Places:
    """Positions of a table's columns by exact name, by name without case, and by letter."""

    def __init__(self, columns: Sequence[str]) -> None:
        self.count = len(columns)
        self.exact = {name: i for i, name in enumerate(columns)}
        self.folded: dict[str, list[int]] = {}
        for i, name in enumerate(columns):
            self.folded.setdefault(name.lower(), []).append(i)

    def named(self, token: str) -> int | None:
        alike = self.folded.get(token.lower(), [])
        return self.exact.get(token, alike[0] if len(alike) == 1 else None)

    def letter(self, token: str) -> int | None:
        """Position of a letter address of up to three letters, bare or with brackets; it may be past the end."""
        bare = token.strip().removeprefix("[").removesuffix("]").strip()
        plain = bare.isascii() and bare.isalpha() and len(bare) <= 3
        return letter_position(bare) if plain else None

    def meant(self, token: str, by_letter: bool) -> range | list[int]:
        """Positions that a token stands for; none if it fits nothing."""
        low, colon, high = token.partition(":")
        ends = [self.letter(low), self.letter(high)] if colon else [None]
        if None not in ends:
            span = range(min(ends), min(max(ends) + 1, self.count))
            if span:
                return span
        letter = self.letter(token)
        if letter is not None and letter >= self.count:
            letter = None
        name = self.named(token)
        first, second = (letter, name) if by_letter else (name, letter)
        return [i for i in (second if first is None else first,) if i is not None]


def resolve_columns(
    spec: str | Iterable[str] | None, columns: Sequence[str], by_letter: bool = False
) -> list[str]:
    """Names meant by a selector such as ``"id + B:D, [F]"``.

    A text selector is cut at ``+`` and ``,``; a list holds one token per item,
    which also reaches names containing those signs. Each token is a letter
    range, an exact name, a name in other case if only one fits, or a letter.
    ``by_letter`` puts letters before names.
    """
    if spec is None:
        return []
    places = _Places(columns)
    listed = not isinstance(spec, str)
    chosen: list[int] = []
    for raw in list(spec) if listed else re.split(r"[+,]", spec):
        if listed and not by_letter and raw in places.exact:
            chosen.append(places.exact[raw])
            continue
        token = raw.strip()
        if token[:1] in ("'", '"') and len(token) > 1 and token.endswith(token[0]):
            token = token[1:-1].strip()
        if not token:
            continue
        found = places.meant(token, by_letter)
        if not found:
            raise ValueError(f"unknown column {token!r}; available: {', '.join(columns)}")
        chosen.extend(found)
    return [columns[i] for i in dict.fromkeys(chosen)]


def select_columns(df: DataFrame, spec: str | Iterable[str], by_letter: bool = False) -> DataFrame:
    """Project onto the columns named by a selector."""
    return df.select([ref(c) for c in resolve_columns(spec, df.columns, by_letter)])


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep and re-order columns; names the table lacks are left out."""
    have = set(df.columns)
    return df.select([ref(c) for c in names if c in have])


def list_columns(df: DataFrame, counted: bool = False) -> DataFrame:
    """Letter, name and type of each column, read from the schema alone.

    With ``counted`` also ``filled``, the number of rows that have a value there, from one aggregate over all rows.
    """
    fields = df.schema.fields
    rows = [(column_letter(i), field.name, field.dataType.simpleString()) for i, field in enumerate(fields)]
    spark, schema = df.sparkSession, "letter string, name string, type string"
    if not counted:
        return spark.createDataFrame(rows, schema)
    filled = df.agg(*[F.count_if(present(df, field.name)).alias(f"c{i}") for i, field in enumerate(fields)]).first()
    return spark.createDataFrame([(*row, n) for row, n in zip(rows, filled)], schema + ", filled long")


def repeated_name(names: Iterable[str]) -> str | None:
    """First name that occurs twice when case is ignored, as Spark resolves names."""
    seen: set[str] = set()
    for name in names:
        if name.lower() in seen:
            return name
        seen.add(name.lower())
    return None


def project_detail(df: DataFrame, col_map: Iterable[tuple[str, str] | dict]) -> DataFrame:
    """Project ``(source, result)`` pairs in order; a source the table lacks becomes empty text."""
    pairs = [(p["src"], p["dst"]) if isinstance(p, dict) else tuple(p) for p in col_map]
    twice = repeated_name(dst for _, dst in pairs)
    if twice is not None:
        raise ValueError(f"result column {twice!r} is named twice")
    have = set(df.columns)
    return df.select([(ref(src) if src in have else F.lit("")).alias(dst) for src, dst in pairs])


def clean_output_name(name: str) -> str:
    """Name usable as a folder, in full: runs of other signs become ``_``."""
    return re.sub(r"\W+", "_", name).strip("_") or FALLBACK_OUTPUT_NAME


def cleaned_output_names(names: Column) -> Column:
    """``clean_output_name`` for a column of names."""
    joined = F.regexp_replace(names, r"(?U)\W+", "_")
    bare = F.regexp_replace(joined, "^_+|_+$", "")
    return F.when(bare == "", F.lit(FALLBACK_OUTPUT_NAME)).otherwise(bare)
