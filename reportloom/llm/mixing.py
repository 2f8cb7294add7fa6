"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import WORD, bounded, staged

#: Cells into which the ranks of a source are counted before any of them is sorted.
CELLS = 4096
#: Steps of the tilt.
TILTS = 1024
#: Sources up to which the list of sources is broadcast to the documents.
BROADCAST_SOURCES = 50_000


def source_targets(
    sources: DataFrame, total_share: float, weights: tuple[float, ...], most_times: float
) -> DataFrame:
    """Targets of sources (``source``, ``source_size``), weighed in code point order, null last.

    The weights repeat along the sources. A target stops at ``most_times`` its source's size and the excess goes to
    the others by weight until none is above. The sources that stop are the first in order of limit / weight, so one
    running sum over the list of sources finds the level at which all others stand. Source sizes are
    whole numbers, so sums over them do not depend on the order.
    """
    names = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    place = ((F.row_number().over(Window.orderBy(*names)) - 1) % len(weights)).cast("int")
    listed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    listed = listed.withColumn("most", F.lit(float(most_times)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), *names)
    before = F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.lit(float(total_share)) * F.sum("source_size").over(Window.partitionBy())
    listed = listed.withColumn(
        "level", (everything - F.lit(float(most_times)) * F.coalesce(before, F.lit(0))) / after
    ).withColumn("stops", F.col("most") / F.col("w") <= F.col("level"))
    # The first that does not stop has the level of all that do not; its "most / w" is the least of theirs.
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("w"), *names, F.col("level").alias("level"))))
    level = first.over(Window.partitionBy())["level"]
    return listed.select(
        "source", "source_size",
        F.when(F.col("stops"), F.col("most")).otherwise(level * F.col("w")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    total_share: float = 1.0,
    most_times: float = 3.0,
    weight: Column | None = None,
    tilt: Column | None = None,
    strength: float = 0.8,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many whole copies of each document a mix of the sources takes.

    Size is the number of words (null text: 0). A document expects ``target / source size`` copies, times its ``weight``
    (a positive column, 1 by default) over its source's mean weight by words, at most ``most_times``. Instead of a weight,
    ``tilt`` (a column from 0 to 1, in steps of 1/1024) makes what documents expect differ and still add up to the target: with
    b copies expected on average, from b - r to b + r by where the tilt stands to its mean, r being ``strength`` times the
    way from b to 0 or to ``most_times``, whichever is nearer. The whole part
    is taken for certain; what is left is its inclusion probability p. Documents are ranked by Pareto order sampling,
    ``u/(1-u)`` over ``p/(1-p)`` with u drawn from their id, and taken from the smallest rank until the words that the source
    still lacks are reached; the document at the border is taken where that comes closer. So the sample's size, in
    words, is fixed: a source ends within half a document of its target (or of what it can give, where weights
    make documents stop at ``most_times``).

    Ranks are counted in cells before any are sorted, so only one of 4096 cells of a source is ever ordered in one task.
    Rows that repeat id, source and text are drawn together and share their fate; a null id, source or text is a value
    like others; documents without words are taken zero times; an empty table gives an empty table. Other columns are not
    looked at. Rerunning gives the same copies. Returns ``doc_id``, ``source``, ``text_hash``, ``rows`` (how many
    rows are alike), ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted), both of each row.
    """
    if weight is not None and tilt is not None:
        raise ValueError("give a weight or a tilt, not both")
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].alias("source"),
        F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"),
        # Whole numbers, so that sums over them do not depend on the order.
        (F.lit(0) if tilt is None else F.round(F.least(F.greatest(tilt, F.lit(0.0)), F.lit(1.0)) * TILTS)).cast("long").alias("tilt"),
    )
    slim = slim.groupBy("doc_id", "source", "text_hash").agg(
        F.count("*").alias("rows"), F.max("size").alias("size"), F.max("weight").alias("weight"), F.max("tilt").alias("tilt")
    )
    slim = staged(slim, "mix")
    sources = slim.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.sum(F.col("size") * F.col("rows") * F.col("weight")).alias("weighed"),
        F.sum(F.col("size") * F.col("rows") * F.coalesce("tilt", F.lit(0))).alias("tilted"),
    )
    sources = staged(sources, "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), total_share, weights, most_times)
    targets = staged(
        targets.withColumnRenamed("source", "s").join(
            sources.select("source", "weighed", "tilted"), F.col("s").eqNullSafe(F.col("source"))
        ).drop("source"),
        "mix-targets",
    )
    rows = slim.join(bounded(targets, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = F.col("weight") * F.col("target") / F.col("weighed")
    if tilt is not None:
        base, mean = F.col("target") / F.col("source_size"), F.col("tilted") / F.col("source_size") / TILTS
        reach = F.least(base, F.lit(float(most_times)) - base) * strength
        share = base + reach * (F.coalesce("tilt", F.lit(0)) / TILTS - mean) / F.greatest(mean, 1 - mean)
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(most_times)), share)).otherwise(0.0)
    whole = F.floor(expected + 1e-9)
    rows = rows.withColumn("whole", whole).withColumn("p", F.greatest(expected - whole, F.lit(0.0)))
    drawn = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    odds = (drawn / (1 - drawn)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 1e-9, odds / (1 + odds)))
    rows = rows.withColumn("words", F.col("size") * F.col("rows"))
    lacks = rows.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("lack")
    ).withColumnRenamed("source", "s")
    cell = F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = rows.where("rank IS NOT NULL").groupBy("source", cell.alias("cell")).agg(F.sum("words").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("cell"))
    cells = cells.withColumn("before", upto - F.col("held"))
    cells = cells.join(lacks, F.col("source").eqNullSafe(F.col("s"))).select("s", "cell", "held", "before", "lack")
    # The one cell of a source in which the sample ends.
    ends = staged(
        cells.where("before <= lack AND before + held > lack").select("s", F.col("cell").alias("c"), "before", "lack"),
        "mix-ends",
    )
    border = rows.where("rank IS NOT NULL").join(ends, F.col("source").eqNullSafe(F.col("s")) & (cell == F.col("c")))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "text_hash")
    passed = F.col("before") + F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = border.withColumn("passed", passed).groupBy("s").agg(
        F.max(F.when(F.expr("passed - words / 2 <= lack"), F.struct("rank", "doc_id", "size", "text_hash"))).alias("last"),
    )
    # Where no cell ends the sample, the source gives all it can or lacks nothing.
    ended = ends.select("s", "c").join(cut.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1")
    lacking = lacks.join(ended.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1")
    lacking = staged(lacking, "mix-lacking")
    judged = rows.join(bounded(lacking, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    own = F.struct("rank", "doc_id", "size", "text_hash")
    chosen = F.col("rank").isNotNull() & (F.col("lack") > 0) & (
        F.col("c").isNull() | (cell < F.col("c")) | ((cell == F.col("c")) & F.coalesce(own <= F.col("last"), F.lit(False)))
    )
    copies = (F.col("whole") + F.when(chosen, 1).otherwise(0)).cast("long")
    return judged.select(
        "doc_id", "source", "text_hash", "rows", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as many times as it is taken."""
    taken = staged(
        mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0").select(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"),
            F.col("copies").cast("int").alias("__copies"),
        ),
        "mixed",
    )
    found = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs[text_col], F.lit("")))).join(
        taken,
        F.col("__text_hash").eqNullSafe(F.col("__hash"))
        & docs[id_col].eqNullSafe(F.col("__id"))
        & docs[source_col].eqNullSafe(F.col("__source")),
    )
    copied = found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies"))))
    return copied.select(*(copied[name] for name in docs.columns))
