"""Exact deduplication by a stream whose keyed state lies on disk and never expires."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import SPACE, bounded, staged
from reportloom.plans.staging import new_path

#: State in RocksDB, with changelogs (a batch writes what it changed) and one memory bound for all
#: state partitions of an executor. Set while the stream runs, put back afterwards.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small states: no disk set aside for each of their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Digests (each below 100 bytes) up to which the list of repeated ones is broadcast.
BROADCAST_DIGESTS = 200_000


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def located(docs: DataFrame) -> DataFrame:
    """The rows with a content locator, ``__at``: the file that holds the row and the row's place in it.

    Rows that do not come straight from files are written to the shared folder first.
    """
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")
    )
    try:
        return docs.select("*", at.alias("__at"))
    except AnalysisException:
        return staged(docs, "dedup-docs").select("*", at.alias("__at"))


def digest_state(slim: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """Stream (``digest``, ``doc_id``, ``at``) rows through keyed state; returns the state: ``digest``, ``first``, ``n``.

    The state holds for each digest the smallest identifier, the locator of its content and the number of rows. It lies
    in RocksDB beside the executors and in the shared folder, has no watermark and so no expiry, and
    can be taken up again from its checkpoint. Partial counts are combined before the shuffle, so copies that
    fill a batch reach a key as one row per task.
    """
    spark = slim.sparkSession
    path, checkpoint = new_path(spark, "dedup-digests"), new_path(spark, "dedup-state")
    slim.write.parquet(path)
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at"))
    state = stream.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
    with settings(spark, STATE):
        run = (
            state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        run.awaitTermination()
        if not run.recentProgress:  # an empty table: no batch, no state
            return spark.createDataFrame([], state.schema)
        kept = spark.read.format("statestore").load(checkpoint)
        value = [field.name for field in kept.schema["value"].dataType]
        table = kept.select(
            "key.digest", F.col("value")[value[0]].alias("first"), F.col("value")[value[1]].alias("n")
        )
        return staged(table, "dedup-groups")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, files_per_batch: int = 64
) -> DataFrame:
    """For every row the group of rows with an equal text, as ``doc_id``, ``at``, ``keep_id``, ``group_size``, ``kept``, ``sha256``.

    Texts are equal when identical after replacing each run of white space by one space; null counts as empty, and so
    all empty and null texts are one group. The row with the smallest id stays, a null id after all others;
    of several rows with that id (and of rows without any), the first by locator. Digests go through the state of
    ``digest_state``; for digests seen more than once the full bytes of all texts are compared (smallest against
    largest, combined before the shuffle), and should two texts share a digest, their rows are grouped by the texts
    themselves. An empty table gives an empty table; other columns are not looked at.
    ``digest_chars`` shortens the digest that is the state's key, for tests.
    """
    rows = located(docs)
    text = normalised(rows[text_col])
    hashed = rows.select(
        F.col(id_col).alias("doc_id"), F.col("__at").alias("at"), F.sha2(text, 256).alias("sha256")
    ).withColumn("digest", F.substring("sha256", 1, digest_chars))
    slim = staged(hashed, "dedup-slim")
    groups = digest_state(slim.select("digest", "doc_id", "at"), files_per_batch)
    several = groups.where("n > 1").select("digest")
    texts = rows.select(
        F.col(id_col).alias("doc_id"), F.col("__at").alias("at"), text.alias("text"),
        F.substring(F.sha2(text, 256), 1, digest_chars).alias("digest"),
    )
    hits = texts.join(bounded(several, BROADCAST_DIGESTS), "digest", "left_semi")
    unequal = hits.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high")
    unequal = staged(unequal.select("digest"), "dedup-unequal")
    told = slim.join(groups, "digest")
    if not unequal.isEmpty():
        apart = texts.join(unequal, "digest", "left_semi")
        own = apart.groupBy("digest", "text").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")).alias("first"), F.count("*").alias("n")
        )
        by_text = own.join(apart.select("digest", "text", "at"), ["digest", "text"]).select("at", "first", "n")
        by_text = slim.join(by_text, "at").select("digest", "doc_id", "at", "sha256", "first", "n")
        told = told.join(unequal, "digest", "left_anti").select(*by_text.columns).union(by_text)
    return told.select(
        "doc_id", "at", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("first.at") == F.col("at")).alias("kept"), "sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = located(docs)
    dropped = staged(
        exact_groups(rows.drop("__at"), id_col, text_col, **options).where("NOT kept").select(F.col("at").alias("__at")),
        "dedup-dropped",
    )
    return rows.join(bounded(dropped, BROADCAST_DIGESTS), "__at", "left_anti").select(*docs.columns)
