"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Per thread, the lists that collect the paths of tables to be dropped.
_collecting = threading.local()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, which all executors share."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/reportloom-{label}-{uuid.uuid4().hex}"
    for paths in getattr(_collecting, "lists", []):
        paths.append(path)
    return path


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Run the plan once, keep its rows as a written table and continue from there.

    The table survives lost executors, is the same however often it is read, and gives later plans real sizes.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Note the paths of tables that this thread stages within the block."""
    _collecting.lists = [*getattr(_collecting, "lists", []), paths]
    try:
        yield
    finally:
        _collecting.lists = _collecting.lists[:-1]


@contextmanager
def dropped_afterwards(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that this thread stages within the block, once it ends.

    Yields the list of their paths; threads that work for this one join in by ``collecting`` it.
    """
    paths: list[str] = []
    try:
        with collecting(paths):
            yield paths
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
