"""What lies in a folder, found with Spark's own file source (any file system it can reach)."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of data files; how an editor's lock file begins.
DATA_SUFFIXES = (".xlsx", ".xls", ".csv", ".parquet")
LOCK_PREFIX = "~$"


@dataclass(frozen=True)
class Child:
    """A table directly inside a folder: a file, or a folder of part files."""

    name: str
    path: str
    modified: datetime
    length: int
    nested: bool = False

    @property
    def stem(self) -> str:
        return os.path.splitext(self.name)[0]

    @property
    def suffix(self) -> str:
        return os.path.splitext(self.name)[1].lower()


def _inner_path(folder: str) -> str:
    """The folder as it shows inside listed paths, whatever scheme it was given with."""
    bare = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", folder)
    return "/" + os.path.normpath(bare).strip("/") + "/"


def list_children(spark: SparkSession, folder: str, books: bool = False) -> list[Child]:
    """Tables directly inside a folder, oldest first.

    File contents are not read, and one row per table comes to the driver. With
    ``books``, folders without a data ending are listed too: their tables are sheets.
    """
    inner = _inner_path(folder)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as error:
        raise ValueError(f"no folder {folder!r}") from error
    start = F.locate(inner, F.col("path"))
    below = F.substring(F.col("path"), start + len(inner), F.length("path"))
    children = (
        files.withColumn("inside", F.when(start > 0, below))
        .groupBy(F.split_part("inside", F.lit("/"), F.lit(1)).alias("name"))
        .agg(
            F.min(F.substring(F.col("path"), F.lit(1), start + len(inner) - 1)).alias("root"),
            F.bool_or(F.contains("inside", F.lit("/"))).alias("nested"),
            F.max("modificationTime").alias("modified"),
            F.sum("length").alias("length"),
        )
    )
    found = []
    for row in children.collect():
        if row.name is None:
            raise ValueError(f"not a folder of tables: {folder!r}")
        is_table = row.name.lower().endswith(DATA_SUFFIXES)
        if not row.name.startswith(LOCK_PREFIX) and (is_table or (books and row.nested)):
            found.append(Child(row.name, row.root + row.name, row.modified, row.length, row.nested))
    return sorted(found, key=lambda c: (c.modified, c.name))


def list_data_files(spark: SparkSession, folder: str) -> DataFrame:
    """Data tables of a folder with time and size, oldest first."""
    rows = [(c.name, c.path, c.modified, c.length) for c in list_children(spark, folder)]
    schema = "name string, path string, modified timestamp, length bigint"
    return spark.createDataFrame(rows, schema).orderBy("modified", "name")


def template_of(children: list[Child]) -> Child:
    """The newest table; its columns are a folder's default columns."""
    if not children:
        raise ValueError("the folder holds no data files")
    return children[-1]
