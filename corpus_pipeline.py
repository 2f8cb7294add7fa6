"""From raw documents to packed sequences: toxicity, exact and near duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reportloom.llm.exact_dedup import deduplicated
from reportloom.llm.mixing import mixed_documents
from reportloom.llm.ngram_join import without_near_duplicates
from reportloom.llm.packing import pack
from reportloom.llm.toxicity import without_toxic
from reportloom.plans.staging import dropped_afterwards, new_path

#: Score from which a document is rejected, as in the toxicity query.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject, learnt from the labels of the given tables.

    Each row is judged by its own text: rows that share an id, repeated rows and rows without an id each on their own. Null and
    empty texts stay; very long texts are judged whole; an empty table stays empty; further columns are kept, whatever their names.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id.

    Texts are equal when only their white space differs; null counts as empty, so one of all empty texts stays. A null id
    comes after all others; of rows alike one stays; further columns are kept; an empty table stays empty.
    """
    return deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id.

    Documents without words are like nothing and all stay; whole texts are compared, however long; rows alike are one class, of which one
    stays; further columns are kept; an empty table stays empty.
    """
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, each as many times as it is taken.

    A null source is a source; documents without words are taken zero times; rows that repeat id, source and text share their fate;
    further columns are kept; an empty table stays empty.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, neighbours on the curve side by side.

    Null and empty texts are documents of the end token alone; long texts go over several sequences; each row is a document; an empty
    table gives no pieces; further columns are not looked at.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: The stages draw, learn and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again for the next.

    What a stage wrote for itself goes when its rows are written, and its input with it: two tables of documents at most lie
    in the shared folder at a time.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with dropped_afterwards(spark) as gone:
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
            gone += [before] if before else []
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
