"""Token counts of whole documents; huge ones in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import ship_code, staged
from reportloom.llm.tokens import UnitCounter


@lru_cache(maxsize=4)
def counter(path: str) -> UnitCounter:
    """One per worker and file; keeps its pieces from batch to batch."""
    return UnitCounter(path)


def _count_whole(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [counter(path).count(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_key"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
            names=["row_key", "n_bytes", "n_tokens"],
        )


def _encode_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of each chunk the stable boundaries in its two overlaps, with the tokens of the chunk before each.

    The chunk's own beginning is no boundary, unless the document begins there; what stands before the first
    boundary may have been encoded differently than within the whole text.
    """
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
    for batch in batches:
        heads, tails, totals = [], [], []
        for row in batch.to_pylist():
            starts, before = counter(path).starts(row["chunk"])
            inner = [(row["begin"] + s, b) for s, b in zip(starts[1:-1], before[1:-1], strict=True)]
            heads.append([{"at": s, "before": b} for s, b in inner if s < row["begin"] + row["overlap"]])
            tails.append([{"at": s, "before": b} for s, b in inner if s >= row["end"]])
            totals.append(before[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("row_key", "place", "last", "n_bytes")]
            + [pa.array(heads, kind), pa.array(tails, kind), pa.array(totals, pa.int64())],
            names=["row_key", "place", "last", "n_bytes", "head", "tail", "total"],
        )


def _chunked(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` characters, each with the first ``overlap`` characters of the next."""
    places = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / size)))
    begin = F.col("place") * size
    rows = texts.select("row_key", "n_bytes", "n_chars", "text", places.alias("place"))
    return rows.select(
        "row_key", "n_bytes", "place",
        begin.alias("begin"), (begin + size).alias("end"), F.lit(overlap).cast("long").alias("overlap"),
        (begin + size >= F.col("n_chars")).alias("last"),
        F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(size + overlap)).alias("chunk"),
    )


def spliced(chunks: DataFrame) -> DataFrame:
    """Counts of documents from their encoded chunks: ``row_key``, ``n_bytes``, ``n_tokens``, ``aligned``.

    Two neighbours are spliced at the first boundary that both have; the first chunk gives the
    tokens before it and the next one those after. ``aligned`` says whether every pair had one.
    """
    following = F.lead("head").over(Window.partitionBy("row_key").orderBy("place"))
    common = F.filter(
        F.transform(
            "tail",
            lambda t: F.struct(
                t["before"].alias("here"),
                F.get(F.filter("next_head", lambda h: h["at"] == t["at"]), F.lit(0))["before"].alias("there"),
            ),
        ),
        lambda s: s["there"].isNotNull(),
    )
    seams = chunks.withColumn("next_head", following).withColumn("seam", F.get(common, F.lit(0)))
    # A chunk gives its tokens up to its seam, less those that the previous seam gave to its neighbour.
    return seams.groupBy("row_key").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.when(F.col("last"), F.col("total")).otherwise(F.col("seam.here") - F.col("seam.there"))).alias("n_tokens"),
        F.min(F.col("last") | F.col("seam").isNotNull()).alias("aligned"),
    )


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    chunk_chars: int = 1 << 16,
    overlap_chars: int = 1 << 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text: ``doc_id``, ``n_bytes``, ``n_tokens``, as the tokenizer at ``tokenizer_path`` gives them.

    Texts up to two chunks long are counted whole. Longer ones are cut into chunks that go to tasks of their own; each chunk
    reaches ``overlap_chars`` into the next. Where white space follows another character the tokenizer always
    cuts, whatever stands around, so such a place is a boundary in any encoding that holds it. Neighbours are spliced at
    the first boundary that both report in their overlap. Documents with a pair that has none (a long run without white
    space, or of white space only) are chunked again with chunks and overlaps eight times as long, until all align or the
    chunk holds the whole text. Nothing is ever cut off or estimated.

    Null text counts as empty (0 bytes, 0 tokens); a null id and repeated rows are kept as they are; special tokens' strings
    inside texts are handled as the library's default does; an empty table gives an empty table; other columns are not
    looked at. For tokenizers of the byte-level kind whose pieces never hold white space after another character.
    """
    ship_code(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].alias("row_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.char_length(text).cast("long").alias("n_chars"),
        text.alias("text"),
    )
    limit = 2 * chunk_chars

    def whole(texts: DataFrame) -> DataFrame:
        schema = texts.select("row_key", "n_bytes").schema.add("n_tokens", "long")
        return texts.select("row_key", "n_bytes", "text").mapInArrow(
            lambda batches: _count_whole(batches, tokenizer_path), schema
        )

    huge = rows.where(F.col("n_chars") > limit).withColumnRenamed("row_key", "id")
    # Rows may share an id, so each huge document gets a key of its own.
    huge = staged(huge.withColumn("row_key", F.monotonically_increasing_id()), "huge-texts")
    done = whole(rows.where(F.col("n_chars") <= limit)).withColumnRenamed("row_key", "doc_id")
    size, overlap, left = chunk_chars, overlap_chars, huge
    keys = huge.select("row_key", "id")
    while not left.isEmpty():
        chunks = _chunked(left, size, overlap)
        schema = (
            "row_key long, place long, last boolean, n_bytes long, "
            "head array<struct<at: long, before: long>>, tail array<struct<at: long, before: long>>, total long"
        )
        spread = chunks.repartition(F.col("row_key"), F.col("place")).withColumn("place", F.col("place").cast("long"))
        encoded = spread.mapInArrow(lambda batches: _encode_chunks(batches, tokenizer_path), schema)
        counted = staged(spliced(encoded), "spliced")
        good = counted.where("aligned").join(keys, "row_key")
        done = done.union(good.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens"))
        left = left.join(counted.where("NOT aligned").select("row_key"), "row_key", "left_semi")
        size, overlap = size * 8, overlap * 8
        if not left.isEmpty():
            fits = whole(left.where(F.col("n_chars") <= 2 * size)).join(keys, "row_key")
            done = done.union(fits.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens"))
            left = left.where(F.col("n_chars") > 2 * size)
    return done


def over_limit(n_tokens: Column, limit: int = 1024) -> Column:
    return n_tokens > limit
