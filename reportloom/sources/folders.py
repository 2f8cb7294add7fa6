"""Merging the tables of a folder that have the required columns."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reportloom.operators.columns import ref
from reportloom.operators.combine import append_tables
from reportloom.plans.errors import STEP_ERRORS, reason
from reportloom.sources.headers import csv_headers
from reportloom.sources.listing import Child, list_children, template_of
from reportloom.sources.tables import pick_sheet, read_csv_files, scan_table

_FOOTER_READERS = 16


def _book_sheets(spark: SparkSession, children: list[Child], sheet: int | str) -> list:
    """Each child with the table it stands for: itself, or the given sheet of a book."""

    def table(child: Child):
        if child.suffix in (".csv", ".parquet"):
            return child, child
        try:
            sheets = {s.stem: s for s in list_children(spark, child.path)}
            return child, sheets[pick_sheet(sorted(sheets), sheet)]
        except ValueError as error:
            return child, error

    return [table(child) for child in children]


def _schemas(spark: SparkSession, tables: list[Child], encoding: str | None) -> list[T.StructType | str]:
    """Schema of each table, or what is wrong with it: from header lines, all in two jobs, and footers, one by one; no data is read."""
    headers = csv_headers(spark, [t for t in tables if t.suffix == ".csv"], encoding)

    def schema(table: Child) -> T.StructType | str:
        names = headers.get(table.path)
        if isinstance(names, str):
            return names
        if names is not None:
            return T.StructType([T.StructField(name, T.StringType()) for name in names])
        try:
            return scan_table(spark, table.path).schema
        except STEP_ERRORS as error:
            return reason(error)

    with ThreadPoolExecutor(_FOOTER_READERS) as readers:
        return list(readers.map(schema, tables))


def merge_folder(
    spark: SparkSession,
    folder: str,
    required: Sequence[str] | None = None,
    sheet: int | str = 0,
    encoding: str | None = None,
    bad_rows: str = "keep",
    multiline: bool = False,
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Tables of a folder stacked on the ``required`` columns, and ``(name, reason)`` of those left out.

    ``required`` defaults to the columns of the newest table. Header lines of CSV tables are found by two jobs, however many
    tables there are; tables with the same header then share one scan, since a scan over CSV files with different column
    orders would mix the columns up.
    """
    children = list_children(spark, folder, books=True)
    template_of(children)
    skipped: list[tuple[str, str]] = []
    tables: list[tuple[Child, Child]] = []
    for child, table in _book_sheets(spark, children, sheet):
        if isinstance(table, Exception):
            skipped.append((child.name, str(table)))
        else:
            tables.append((child, table))

    schemas = _schemas(spark, [table for _, table in tables], encoding)
    if not required:
        if not schemas or isinstance(schemas[-1], str):
            raise ValueError("the newest table cannot be read; name the required columns")
        required = schemas[-1].names
    groups: dict[tuple, list[str]] = {}
    for (child, table), schema in zip(tables, schemas):
        if isinstance(schema, str):
            skipped.append((child.name, schema))
            continue
        lacking = [c for c in required if c not in schema.names]
        if lacking:
            skipped.append((child.name, f"lacks {', '.join(lacking)}"))
            continue
        if table.suffix == ".csv":
            key = ("csv", tuple(schema.names))
        else:
            key = ("parquet", tuple(schema[c].dataType for c in required))
        groups.setdefault(key, []).append(table.path)
    if not groups:
        raise ValueError(f"no table of {folder!r} has the columns {list(required)}")

    scans = []
    for (kind, shape), paths in groups.items():
        if kind == "csv":
            scan = read_csv_files(spark, paths, shape, encoding, bad_rows, multiline)
        else:
            fields = [T.StructField(c, t) for c, t in zip(required, shape)]
            scan = spark.read.schema(T.StructType(fields)).parquet(*paths)
        scans.append(scan.select([ref(c) for c in required]))
    return append_tables(scans), skipped


def skipped_table(spark: SparkSession, skipped: Sequence[tuple[str, str]]) -> DataFrame:
    """The skip list of :func:`merge_folder` as a table."""
    return spark.createDataFrame(list(skipped), "name string, reason string")
