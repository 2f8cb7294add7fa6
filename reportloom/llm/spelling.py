"""Spelling variants: words one edit apart, found among the sorted rotations of all words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import ascii_lower, finished, staged

#: Fixed value: the letters of the contract.
LETTER = r"[A-Za-zÀ-ÿ]"
#: Stands after a word's last letter in its rotations; words do not hold it.
END = "\x00"
#: Code points of a word from which its rotations are compared by their SHA-256.
LONG = 64


def word_counts(
    docs: DataFrame,
    change: Callable[[Column, Column], Column] | None = None,
    least_length: int = 5,
    least_count: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words (maximal runs of letters, A-Z lower-cased) with their number ``n`` of occurrences in all texts.

    ``change`` makes another word of an occurrence, given the row's id as text (null: empty) and the run. Words
    shorter than ``least_length`` code points or rarer than ``least_count`` are left out. Null text holds no word; whole
    texts are read; repeated rows count each time; other columns are not looked at. Counts are combined before the shuffle.
    """
    # Runs shorter than the least length cannot become longer, so they are not even cut out.
    pattern = f"{LETTER}{{{least_length},}}+"
    runs = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(ascii_lower(docs[text_col]), F.lit(pattern), F.lit(0))).alias("run"),
    )
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def without_letter(run: Column, at: Column) -> Column:
    """The run without its code point ``at`` (from 0)."""
    at = at.cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))


def _rotations(words: DataFrame) -> DataFrame:
    """Rotations of words, each as the range of a missing letter and, but for its last letter, as one of any letter there.

    ``word`` + END, turned so that ``at`` letters stand behind END. A row with a null ``letter`` has the whole rotation as
    its ``key``: it meets words that have one letter more at this place. Rows with a letter have it skipped: they
    meet words with another letter, or none, at this place. ``once`` marks one place in a row of
    equal letters, since leaving out any of them gives the same word.
    """
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    tail = F.concat(F.expr("substring(word, at + 1)"), F.lit(END))
    whole = F.struct(
        F.concat(tail, F.expr("left(word, at)")).alias("key"), F.lit(None).cast("string").alias("letter"), F.lit(False).alias("once")
    )
    skipped = F.struct(
        F.concat(tail, F.expr("left(word, at - 1)")).alias("key"),
        F.expr("substring(word, at, 1)").alias("letter"),
        F.expr("at = 1 OR substring(word, at - 1, 1) <> substring(word, at, 1)").alias("once"),
    )
    entries = F.when(F.col("at") > 0, F.array(whole, skipped)).otherwise(F.array(whole))
    rows = turned.select("word", "n", F.inline(entries))
    key = F.when(F.char_length("key") > LONG, F.sha2("key", 256)).otherwise(F.col("key"))
    return rows.withColumn("key", key)


def _neighbours(words: DataFrame) -> DataFrame:
    """For each word the number ``n_near`` of words one edit away and the ``best`` of them (-n, word), null without any.

    Rotations are range sorted. Rows of one key stand together: at most one whole rotation and one row for each letter of
    the alphabet, so a group is bounded by the alphabet. Each row needs only the group's counts and its first two words.
    """
    rows = _rotations(words).repartitionByRange("key")
    group = Window.partitionBy("key")
    by_rank = group.orderBy(F.col("n").desc(), "word")
    own = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("w"))
    scanned = rows.select(
        "word", "letter", "once",
        F.count("letter").over(group).alias("letters"),
        F.count(F.when(F.col("letter").isNull(), 1)).over(group).alias("wholes"),
        F.count(F.when(F.col("once"), 1)).over(group).alias("onces"),
        F.row_number().over(by_rank).alias("place"),
        F.first(own).over(by_rank).alias("first"),
        F.lead(own).over(by_rank).alias("next"),
    ).where("letters + wholes > 1")
    near = F.when(F.col("letter").isNull(), F.col("onces")).otherwise(
        F.col("letters") - 1 + F.when(F.col("once"), F.col("wholes")).otherwise(0)
    )
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first"))
    return scanned.select("word", near.alias("near"), other.alias("other"))


def _roots(forms: DataFrame) -> DataFrame:
    """The last word of each chain of forms: ``word``, ``root``. Every round doubles the steps taken.

    A word's form occurs more often than the word, so chains end.
    """
    roots = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        roots = staged(
            roots.join(onward, F.col("root") == F.col("via"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def spelling_variants(words: DataFrame, times: float = 2.0) -> DataFrame:
    """The usual form of every word (``word``, ``n``), and the word that a chain of such forms ends in.

    Words are near if one inserted, deleted or replaced code point turns one into the other. A word's ``form`` is its most
    frequent near word (ties: the smallest in code point order) if that occurs at least ``times`` as often; ``root`` follows
    the forms to the last one, and is the word itself without any. Every word with L letters has 2 L + 1 rows in the sort,
    of its own length each; nothing is paired, capped or collected, and groups are as large as the alphabet at most. Equal words are
    one word with the sum of their ``n``; null words and words without an ``n`` are left out; other columns are not looked
    at; an empty table gives an empty table. Returns ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.
    """
    spark = words.sparkSession

    def make() -> DataFrame:
        own = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
        own = staged(own, "spelling-words")
        alone = own.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<minus: long, w: string>").alias("other"))
        both = alone.unionByName(_neighbours(own), allowMissingColumns=True)
        found = both.groupBy("word").agg(
            F.max("n").alias("n"), F.sum("near").cast("long").alias("n_near"), F.min("other").alias("best")
        )
        enough = -F.col("best.minus") >= F.col("n") * times
        found = staged(
            found.select(
                "word", "n", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")
            ),
            "spelling-forms",
        )
        roots = _roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "w")
        return found.join(roots, F.col("word") == F.col("w"), "left").select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
        )

    return finished(spark, "spelling", make)
