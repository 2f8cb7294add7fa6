"""Reading one table: Parquet with its types, CSV as text, a sheet of a book."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reportloom.operators.columns import keep_columns, ref
from reportloom.sources.listing import list_children

# Charsets Spark reads without further ado.
_PLAIN_CHARSETS = {
    "US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32",
}

BAD_ROWS = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED"}


def clean_header(names: Iterable[str]) -> list[str]:
    """Names of a header row; a blank one is called ``Unnamed_`` and its position."""
    return [
        f"Unnamed_{i}" if name == f"_c{i}" or not name.strip() else name
        for i, name in enumerate(names)
    ]


def csv_reader(spark: SparkSession, encoding: str | None = None, bad_rows: str = "keep"):
    """Reader for CSV with a header row, every column as text."""
    reader = (
        spark.read.format("csv")
        .option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        # An empty cell is null, a quoted empty one is empty text: the null text itself
        # must then be one that no file spells.
        .option("nullValue", "\u0000")
        .option("mode", BAD_ROWS[bad_rows])
    )
    if encoding:
        if encoding.upper() not in _PLAIN_CHARSETS:
            # Other charsets of the Java runtime, GBK among them, are behind this switch.
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", encoding)
    return reader


def read_csv_files(
    spark: SparkSession,
    paths: Sequence[str],
    header: Sequence[str],
    encoding: str | None = None,
    bad_rows: str = "keep",
    multiline: bool = False,
) -> DataFrame:
    """CSV files that share a header, every column as text. Nothing is read while planning.

    With ``multiline`` quoted cells may hold line breaks; each file is then read whole by one task. Without, a
    line is a row: files are split between tasks, and a quote left open spoils its own line only.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = csv_reader(spark, encoding, bad_rows).option("multiLine", multiline)
    return reader.schema(schema).load(list(paths))


def csv_header(spark: SparkSession, path: str, encoding: str | None = None) -> list[str]:
    """Column names of a CSV table; only the first line is read."""
    return clean_header(csv_reader(spark, encoding).load(path).columns)


def scan_csv(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] | None = None,
    encoding: str | None = None,
    bad_rows: str = "keep",
    multiline: bool = False,
) -> DataFrame:
    """CSV with every column as text; requested columns it lacks are left out.

    Short rows are filled with nulls and long ones cut; ``bad_rows='drop'`` drops both.
    For ``multiline`` see :func:`read_csv_files`.
    """
    header = csv_header(spark, path, encoding)
    df = read_csv_files(spark, [path], header, encoding, bad_rows, multiline)
    return df if columns is None else keep_columns(df, columns)


def table_format(path: str) -> str:
    """``csv`` or ``parquet`` by the path's ending; a plain folder holds Parquet."""
    return "csv" if path.rstrip("/").lower().endswith(".csv") else "parquet"


def scan_table(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] | None = None,
    encoding: str | None = None,
    bad_rows: str = "keep",
    multiline: bool = False,
) -> DataFrame:
    """Table at a path. A requested column that a Parquet table lacks is an error."""
    if path.lower().endswith((".xlsx", ".xls")):
        raise ValueError(f"workbook files are not decoded; export the sheets to a folder: {path}")
    if table_format(path) == "csv":
        return scan_csv(spark, path, columns, encoding, bad_rows, multiline)
    df = spark.read.parquet(path)
    return df if columns is None else df.select([ref(c) for c in columns])


def list_sheets(spark: SparkSession, book: str) -> list[str]:
    """Sheets of a book in name order: the tables directly inside a folder."""
    return sorted(child.stem for child in list_children(spark, book))


def pick_sheet(names: list[str], sheet: int | str) -> str:
    """A sheet by position or name."""
    if isinstance(sheet, int) and not isinstance(sheet, bool) and 0 <= sheet < len(names):
        return names[sheet]
    if sheet in names:
        return sheet
    raise ValueError(f"no sheet {sheet!r}; the book has {names}")


def scan_sheet(
    spark: SparkSession,
    book: str,
    sheet: int | str = 0,
    columns: Iterable[str] | None = None,
    encoding: str | None = None,
    bad_rows: str = "keep",
    multiline: bool = False,
) -> DataFrame:
    """One sheet of a book; requested columns it lacks are left out."""
    children = {child.stem: child.path for child in list_children(spark, book)}
    path = children[pick_sheet(sorted(children), sheet)]
    df = scan_table(spark, path, None, encoding, bad_rows, multiline)
    return df if columns is None else keep_columns(df, columns)

