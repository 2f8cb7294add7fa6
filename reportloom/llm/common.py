"""What several of these operators need: staged tables, row numbers, components, fixed patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.plans.staging import dropped_afterwards, new_path

#: The white space of the contracts, and a word between such space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder once and read them from there.

    The table cuts the lineage, survives lost executors and is the same however often it is read.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write a result and read it from there; the tables that were staged on the way to it are deleted."""
    path = new_path(spark, label)
    with dropped_afterwards(spark):
        result = make()
        result.write.parquet(path)
    return spark.read.schema(result.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key's text, modulo ``buckets``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def stop_if_unchanged(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return row["n"], int(row["h"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (``u``, ``v``).

    Returns one row (``node``, ``component``) for each node that has an edge to another one; the
    component is its smallest node. Null ends and loops are left out. Alternating large-star and small-star
    rounds shorten every path by about half, so a chain of n nodes takes some log n rounds, and a hub's
    edges are spread by the skew join and by aggregates that combine before the shuffle. Each round
    is written to the shared folder; only a count and a checksum come to the driver.
    """
    own = edges.select("u", "v").where("u <> v")
    small = staged(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = stop_if_unchanged(small)
    while before[0]:
        both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        after = stop_if_unchanged(small)
        if after == before:
            break
        before = after
    roots = small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows given in the code, as a table that needs no Python on the executors."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = [part.split()[1] for part in schema.split(",")]
    one = [
        F.struct(*(F.lit(value).cast(kind).alias(name) for name, kind, value in zip(names, kinds, row, strict=True)))
        for row in rows
    ]
    return spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")


@lru_cache(maxsize=8)
def _shipped(application: str) -> str:
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    return str(archive)


#: Bytes of rows that go to a worker at once, however long their texts are; the JVM and the worker both hold them.
BATCH_BYTES = 4 << 20


def ship_code(spark: SparkSession) -> None:
    """Let Spark send this package's code to the executors, where their Python may not have it installed, and rows in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    before = _shipped.cache_info().misses
    archive = _shipped(context.applicationId)
    if _shipped.cache_info().misses > before:
        context.addPyFile(archive)


#: By operator, how a Python worker forgets what it remembers for it.
_memories: dict[str, Callable[[], None]] = {}
#: The operator that this worker remembers something for.
_current: str | None = None


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """Say that workers remember something for an operator from task to task, and how they forget it."""
    _memories[operator] = forget


def give_back() -> None:
    """Return to the system what this process has freed; the C library would keep most of it, which adds up from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def memory_for(operator: str) -> None:
    """Forget what this worker remembers for other operators: workers outlive a stage, and their memory would add up.

    Once an operator begins, what is free goes back to the system too.
    """
    global _current
    if operator == _current:
        return
    _current = operator
    for name, forget in _memories.items():
        if name != operator:
            forget()
    give_back()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast of the table where it has at most ``rows`` rows, as counted; beyond that the table itself, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
