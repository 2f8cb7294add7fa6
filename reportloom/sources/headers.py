"""Header lines of many CSV tables, found by two jobs however many there are."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.plans.errors import STEP_ERRORS, reason
from reportloom.sources.listing import Child
from reportloom.sources.tables import csv_header

#: Tables up to this many bytes are read whole, many by one task; of longer ones a task reads the beginning.
WHOLE = 1 << 20

#: Lines that a task takes at a time from the beginning of a long table, and a size that no file reaches.
_LINES, _ENDLESS = 64, 1 << 62

_HEADER_READERS = 16


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines that are not blank, with the file and the place of each."""
    return (
        spark.read.text(paths)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        .where(F.trim("value") != "")
    )


def _of_short(spark: SparkSession, paths: list[str]) -> DataFrame:
    placed = _lines(spark, paths).withColumn("place", F.struct("block", F.monotonically_increasing_id()))
    return placed.groupBy("path").agg(F.md5(F.min_by("value", "place")).alias("line"))


def _of_long(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The settings, one task a file and few lines at a time, hold in a session of their own."""
    alone = spark.newSession()
    alone.conf.set("spark.sql.files.maxPartitionBytes", str(_ENDLESS))
    alone.conf.set("spark.sql.files.openCostInBytes", str(_ENDLESS))
    alone.conf.set("spark.sql.files.minPartitionNum", "1")
    alone.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_LINES))

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = _lines(alone, paths).select("path", F.md5("value").alias("line"))
    return lines.mapInArrow(first, "path string, line string")


def csv_headers(spark: SparkSession, tables: Sequence[Child], encoding: str | None = None) -> dict[str, list[str] | str]:
    """By path, the column names of each CSV table, or what is wrong with it.

    Tables whose first lines are the same bytes have the same header, so one of each kind is parsed. A table without any line has no
    columns; of a folder of part files the first by name speaks for all.
    """
    by_path = {table.path: table for table in tables}
    kinds: dict[str, list[str]] = {}
    try:
        lines: dict[str, tuple[str, str]] = {}
        for some, read in (([t.path for t in tables if t.length <= WHOLE], _of_short), ([t.path for t in tables if t.length > WHOLE], _of_long)):
            for row in read(spark, some).collect() if some else []:
                # Spark names files as they stand in addresses, and lists them as they are called.
                owner = unquote(row.path)
                while owner not in by_path and "/" in owner:
                    owner = owner.rsplit("/", 1)[0]
                if owner in by_path:
                    lines[owner] = min(lines.get(owner, (row.path, row.line)), (row.path, row.line))
        for path in by_path:
            kinds.setdefault(lines[path][1] if path in lines else path, []).append(path)
    except STEP_ERRORS:
        # A file that cannot be opened ends the job for all: then each is read by itself and speaks for itself.
        kinds = {path: [path] for path in by_path}

    def parsed(paths: list[str]) -> list[str] | str:
        try:
            return csv_header(spark, paths[0], encoding)
        except STEP_ERRORS as error:
            return reason(error)

    with ThreadPoolExecutor(_HEADER_READERS) as readers:
        headers = readers.map(parsed, kinds.values())
        return {path: header for paths, header in zip(kinds.values(), headers) for path in paths}
