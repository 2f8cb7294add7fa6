"""Writing results and converting sources to Parquet."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.plans.errors import STEP_ERRORS, reason
from reportloom.plans.staging import new_path, settle
from reportloom.sources.headers import csv_headers
from reportloom.sources.listing import Child, list_children
from reportloom.sources.tables import list_sheets, pick_sheet, read_csv_files, scan_sheet, scan_table

# Fixed value: data rows of one sheet (the header takes the 1,048,576th).
SHEET_ROWS = 1_048_575

SHEET_COLUMN = "sheet_no"

_WRITE_JOBS = 8

#: Modes in which a table is written anew or not at all.
_FRESH = ("overwrite", "error", "errorifexists")


def _writer(df: DataFrame, file_format: str, mode: str):
    writer = df.write.format(file_format).mode(mode)
    return writer.option("header", True).option("escape", '"') if file_format == "csv" else writer


def write_output(
    df: DataFrame,
    path: str,
    max_rows: int = SHEET_ROWS,
    file_format: str = "parquet",
    mode: str = "errorifexists",
    numbered_sheets: bool = False,
) -> int:
    """Write one result and return its number of rows, counted while writing.

    Every file holds at most ``max_rows`` rows and all tasks write side by side. With
    ``numbered_sheets`` the rows are cut, in the result's order, into folders
    ``sheet_no=1, 2, ...`` of exactly ``max_rows`` rows (the last may be shorter).
    """
    if numbered_sheets and SHEET_COLUMN in (name.lower() for name in df.columns):
        raise ValueError(f"a result with numbered sheets cannot have a column {SHEET_COLUMN!r} of its own; rename it")
    counted = Observation()
    df = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    if numbered_sheets:
        numbered = _numbered(df, max_rows)
        _writer(numbered, file_format, mode).partitionBy(SHEET_COLUMN).save(path)
    else:
        _writer(df, file_format, mode).option("maxRecordsPerFile", max_rows).save(path)
    return counted.get["rows"]


def with_positions(df: DataFrame, position: str) -> DataFrame:
    """The rows in the result's order with their places in it, counted from 0.

    The sorted result is written once with the number of each task and row in it, so positions cannot shift when a task
    runs again. Row counts per task (one row each) then turn them into positions in the whole result.
    """
    spark = df.sparkSession
    table = new_path(spark, "sheets")
    df.select(
        "*", F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__row")
    ).write.parquet(table)
    rows = spark.read.parquet(table)
    ahead = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    tasks = tasks.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    # Settled, the few rows are broadcast for certain and the result is not shuffled to meet them.
    tasks = settle(tasks, "tasks")
    place = F.col("__before") + F.col("__row") - F.col("__first")
    return rows.join(tasks, "__task").select(*df.columns, place.alias(position))


def _numbered(df: DataFrame, max_rows: int) -> DataFrame:
    """Rows with the number of their sheet. What was written by one task stays in order and together; a sheet that
    reaches over the border of two tasks gets a file from each."""
    placed = with_positions(df, "__place")
    numbered = placed.withColumn(SHEET_COLUMN, F.floor(F.col("__place") / max_rows).cast("int") + 1)
    return numbered.sortWithinPartitions(SHEET_COLUMN, "__place").select(*df.columns, SHEET_COLUMN)


def convert_table(
    spark: SparkSession, src: str, dst: str, sheets: Iterable[int | str] | str | None = None,
    encoding: str | None = None, bad_rows: str = "keep", mode: str = "overwrite",
) -> DataFrame:
    """Convert one CSV table, or chosen sheets of a book, to Parquet tables in ``dst``.

    Returns a report (file, ok, rows, detail). A table becomes ``base.parquet``, a sheet
    ``base_sheet.parquet``. An unusable sheet is reported and the others go on.
    """
    base = src.rstrip("/").rsplit("/", 1)[-1]
    if base.lower().endswith(".csv"):
        sources = [(base[: -len(".csv")], lambda: scan_table(spark, src, None, encoding, bad_rows))]
        records = []
    else:
        sources, records = _sheet_sources(spark, src, base, sheets, encoding, bad_rows)
    records += [_convert(read, f"{dst.rstrip('/')}/{name}.parquet", mode) for name, read in sources]
    return _report(spark, records)


def _sheet_sources(spark, src, base, sheets, encoding, bad_rows):
    names = list_sheets(spark, src)
    wanted = names if sheets in (None, "ALL") else [sheets] if isinstance(sheets, (int, str)) else sheets
    sources, bad = [], []
    for sheet in wanted:
        try:
            name = pick_sheet(names, sheet)
        except ValueError as error:
            bad.append((f"{base}_{sheet}.parquet", False, None, str(error)))
            continue
        title = f"{base}_{name}"
        sources.append((title, lambda n=name: scan_sheet(spark, src, n, None, encoding, bad_rows)))
    return sources, bad


def _convert(read, path: str, mode: str) -> tuple:
    name = path.rsplit("/", 1)[-1]
    try:
        return name, True, write_output(read(), path, max_rows=0, mode=mode), ""
    except STEP_ERRORS as error:
        return name, False, None, reason(error)


def _report(spark: SparkSession, records: list[tuple]) -> DataFrame:
    return spark.createDataFrame(records, "file string, ok boolean, rows bigint, detail string")


def convert_folder(
    spark: SparkSession, src: str, dst: str, sheets: int | str = 0,
    encoding: str | None = None, bad_rows: str = "keep", mode: str = "overwrite",
) -> DataFrame:
    """Convert every CSV table and book of a folder to Parquet; Parquet tables are left alone.

    ``sheets`` is ``'ALL'``, a position (cut to the last sheet) or a name. Sources with the same header are converted together, by one scan
    and one write without a shuffle, and their rows are counted together; so the number of jobs grows with the number of different
    headers, not with that of sources. Sheets that are Parquet tables, sources that want the same output, and the sources of
    a conversion that failed as a whole are converted one by one; a failed source is reported and the others go on.
    """
    wanted, records = _folder_sources(spark, src, sheets)
    outputs = Counter(name.lower() for name, _ in wanted)
    together = [(name, c) for name, c in wanted if c.suffix == ".csv" and outputs[name.lower()] == 1 and mode in _FRESH]
    headers = csv_headers(spark, [child for _, child in together], encoding)
    groups: dict[tuple, list[tuple[str, Child]]] = {}
    for name, child in together:
        if isinstance(headers[child.path], list) and headers[child.path]:
            groups.setdefault((child.nested, *headers[child.path]), []).append((name, child))
    grouped = {child.path for sources in groups.values() for _, child in sources}

    def one(source: tuple[str, Child]) -> list[tuple]:
        name, child = source
        return [_convert(lambda: scan_table(spark, child.path, None, encoding, bad_rows), f"{dst.rstrip('/')}/{name}.parquet", mode)]

    def many(kind: tuple) -> list[tuple]:
        sources = groups[kind]
        try:
            if len(sources) > 1:
                return _convert_together(spark, sources, kind[1:], dst, encoding, bad_rows, mode)
        except STEP_ERRORS:
            pass
        return [record for source in sources for record in one(source)]

    with ThreadPoolExecutor(_WRITE_JOBS) as jobs:
        records += [row for rows in jobs.map(many, groups) for row in rows]
        alone = [source for source in wanted if source[1].path not in grouped]
        single = [source for source in alone if outputs[source[0].lower()] == 1]
        records += [row for rows in jobs.map(one, single) for row in rows]
    # What wants the same output follows one another, so that the last in the folder's order stays.
    records += [row for source in alone if outputs[source[0].lower()] > 1 for row in one(source)]
    return _report(spark, records)


def _folder_sources(spark, src: str, sheets: int | str) -> tuple[list[tuple[str, Child]], list[tuple]]:
    """Output name and table of each source of a folder, and report lines of those that have none."""
    wanted: list[tuple[str, Child]] = []
    bad: list[tuple] = []
    books = []
    for child in list_children(spark, src, books=True):
        if child.suffix == ".csv":
            wanted.append((child.stem, child))
        elif child.suffix != ".parquet":
            books.append(child)

    def inside(book: Child) -> dict[str, Child]:
        try:
            return {sheet.stem: sheet for sheet in list_children(spark, book.path)}
        except ValueError:
            return {}

    with ThreadPoolExecutor(_WRITE_JOBS) as jobs:
        listed = list(zip(books, jobs.map(inside, books)))
    for book, tables in listed:
        names = sorted(tables)
        if not names:
            bad.append((book.name, False, None, "no tables inside"))
        elif sheets == "ALL" and len(names) > 1:
            wanted += [(f"{book.name}_{name}", tables[name]) for name in names]
        else:
            pick = 0 if sheets == "ALL" else sheets
            try:
                name = names[min(pick, len(names) - 1)] if isinstance(pick, int) else pick_sheet(names, pick)
                wanted.append((book.stem, tables[name]))
            except ValueError as error:
                bad.append((book.name, False, None, str(error)))
    return wanted, bad


def _convert_together(spark, sources: list[tuple[str, Child]], header, dst: str, encoding, bad_rows, mode: str) -> list[tuple]:
    """Sources with the same header: one scan, one write into a folder for each source's file or folder, one count.

    The folders then get the names of their tables; a source without rows gets a copy of an empty table.
    """
    paths = spark._jvm.org.apache.hadoop.fs
    settings = spark._jsc.hadoopConfiguration()
    place = f"{dst.rstrip('/')}/.converting-{uuid.uuid4().hex}"
    files = paths.Path(place).getFileSystem(settings)
    column = "__source"
    while column in (name.lower() for name in header):
        column += "_"
    rows = read_csv_files(spark, [child.path for _, child in sources], header, encoding, bad_rows)
    # The path stands there as in an address.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    owner = F.regexp_replace(file, "/[^/]*$", "") if sources[0][1].nested else file
    try:
        told = rows.select("*", F.concat(F.lit("t"), F.md5(owner)).alias(column))
        told.write.partitionBy(column).parquet(f"{place}/rows")
        written = spark.read.schema(f"`{column}` string").parquet(f"{place}/rows")
        counts = {row[0]: row[1] for row in written.groupBy(column).count().collect()}
        marks = ["t" + hashlib.md5(child.path.encode()).hexdigest() for _, child in sources]
        if not counts.keys() <= set(marks):
            raise ValueError("rows of an unknown file")
        if len(counts) < len(sources):
            rows.limit(0).write.parquet(f"{place}/empty")
        records = []
        for (name, _), mark in zip(sources, marks):
            target = paths.Path(f"{dst.rstrip('/')}/{name}.parquet")
            if mode == "overwrite":
                files.delete(target, True)
            if files.exists(target):
                records.append((f"{name}.parquet", False, None, f"there is a table already: {target.toString()}"))
                continue
            if mark in counts:
                moved = files.rename(paths.Path(f"{place}/rows/{column}={mark}"), target)
            else:
                moved = paths.FileUtil.copy(files, paths.Path(f"{place}/empty"), files, target, False, settings)
            records.append((f"{name}.parquet", moved, counts.get(mark, 0) if moved else None, "" if moved else "could not be renamed"))
        return records
    finally:
        files.delete(paths.Path(place), True)
