"""Merkle manifest of a dataset: a tree of digests for each group, one over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import finished, staged

#: Digits of a rank that are grouped away within one block, so that a block has at most ``fanout ** DIGITS`` nodes.
DIGITS = 2
#: Bytes up to which the offsets of sorted partitions (one row for each partition and group in it) are broadcast.
BROADCAST_BYTES = 8 << 20
#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
PLACE_BITS = 33

STEPS = "array<struct<place: int, run: array<string>>>"


def written(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(written, values)), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their ``rank`` within their ``grp``, from 0, by ``order``; no group is sorted in one task.

    The rows are range sorted, so a hot group lies over many partitions; only one count for each partition
    and group in it is summed up along the partitions.
    """
    keys = ["grp", *order]
    # The range sort reads its input twice, once for a sample of the keys.
    rows = staged(rows, "merkle-rows")
    in_order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(in_order.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part, index = F.shiftright("at", PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    offsets = staged(
        counts.selectExpr(
            "grp AS og", "part",
            "coalesce(sum(n) OVER (PARTITION BY grp ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS shift",
        ),
        "merkle-offsets",
    )
    size = offsets.agg(F.sum(F.coalesce(F.octet_length("og"), F.lit(0)) + 32)).first()[0] or 0
    small = F.broadcast(offsets) if size <= BROADCAST_BYTES else offsets
    joined = placed.join(small, F.col("grp").eqNullSafe(F.col("og")) & (part == F.col("part")))
    return joined.withColumn("rank", index + F.col("shift")).select("grp", "rank", "digest", "item")


def _rolled_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """Blocks of nodes (``grp``, ``rank``, ``digest``, ``item``) as nested structs: one row for each ``grp`` and ``block``.

    The rank's lowest digits are columns that are grouped away one by one; each time the structs of a run become
    the children of one struct with their common digest. All groupings keep ``grp`` and ``block``, so the rows are
    shuffled once. A node alone on its level (the first run, with one child) passes its digest on unhashed.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "grp", F.expr(f"rank DIV {fanout**DIGITS}").alias("block"),
        *(F.expr(f"CAST(rank DIV {fanout**k} % {fanout} AS INT)").alias(name) for k, name in enumerate(digits)),
        "digest", F.col("item").alias("below"),
    ).repartition("grp", "block")
    for k, digit in enumerate(digits):
        kept = ["block", *digits[k + 1 :]]
        rows = rows.groupBy("grp", *kept).agg(
            F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "digest", "below"))).alias("kids")
        )
        alone = F.expr(" AND ".join(f"{name} = 0" for name in kept)) & (F.size("kids") == 1)
        joined = F.sha2(F.array_join(F.col("kids.digest"), ""), 256)
        rows = rows.select(
            "grp", *kept,
            F.when(alone, F.col("kids")[0]["digest"]).otherwise(joined).alias("digest"),
            F.struct(alone.alias("alone"), "kids").alias("below"),
        )
    return rows


def _tiers(spark: SparkSession, nodes: Callable[[], DataFrame], fanout: int) -> list[DataFrame]:
    """Written blocks of all tiers: of the nodes, of the digests of their blocks, and so on until a group has one block."""
    tiers: list[DataFrame] = []
    make = nodes
    while True:
        tiers.append(finished(spark, "merkle-blocks", lambda: _rolled_up(make(), fanout)))  # noqa: B023
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        make = lambda: tiers[-1].selectExpr("grp", "block AS rank", "digest", "CAST(NULL AS INT) AS item")


def _unfolded(blocks: DataFrame, fanout: int) -> DataFrame:
    """The nodes of blocks that know their way up (``up``), each with its own way: ``grp``, ``rank``, ``digest``, ``item``, ``up``."""
    rows = blocks.select("grp", F.col("block").alias("rank"), F.col("below").alias("item"), "up")
    for _ in range(DIGITS):
        kids = rows.select(
            "grp", "rank", "up", F.col("item.alone").alias("alone"), F.col("item.kids.digest").alias("run"),
            F.posexplode("item.kids").alias("place", "kid"),
        )
        step = F.when(F.col("alone"), F.array().cast(STEPS)).otherwise(F.array(F.struct("place", "run")).cast(STEPS))
        rows = kids.select(
            "grp", (F.col("rank") * fanout + F.col("place")).alias("rank"),
            F.col("kid.digest").alias("digest"), F.col("kid.below").alias("item"),
            F.col("up").withField("steps", F.concat(step, F.col("up.steps"))).alias("up"),
        )
    return rows


def _with_ways(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """Blocks beside their ways up: both kinds of rows in one grouping, so that no join is needed."""
    both = blocks.unionByName(ways.select("grp", F.col("rank").alias("block"), "up"), allowMissingColumns=True)
    # By number, so that few bytes of blocks still unfold in many tasks.
    both = both.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "block")
    return both.groupBy("grp", "block").agg(
        *(F.first(name, ignorenulls=True).alias(name) for name in ("digest", "below", "up"))
    )


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group_col: str = "source",
    id_col: str = "doc_id",
    fanout: int = 16,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A proof for every row that it belongs to the dataset with a given root digest.

    A row's ``leaf`` is the digest of its ``columns``. Leaves of a group ascend by id; every ``fanout`` consecutive nodes
    become one, until one is left, the group's ``subroot`` (a lone leaf is it itself). Subroots in the groups' bytewise order,
    null first, make the ``root`` in the same way. ``proof`` lists the runs on the way up, each with the own ``place`` in it.

    Ranks come from a range sort, so a hot group lies over many tasks. Blocks of ``fanout ** DIGITS`` leaves become one row
    of nested structs each, by grouping away the digits of the ranks; the blocks' digests are ranked nodes again, and so
    on. From the top down every block meets its way up in one grouping and is exploded level by level. A row
    in flight holds one block and one way, whatever the size of the dataset; nothing comes to the driver but the highest block number.
    The written blocks (some 100 bytes a row) stay in the shared folder, as the result reads them.

    Null values count as ``-``; a null group is a group, null ids come first; rows that share an id are ordered by their
    digests, rows alike are leaves of their own; texts are hashed whole; an empty table gives no rows. Other columns are
    not looked at. ``carried`` names further expressions over ``docs`` to return with each row. Returns ``id``, ``grp``,
    ``leaf``, ``subroot``, ``root``, ``proof`` (array of ``place``, ``run``) and the carried columns.
    """
    spark = docs.sparkSession
    carried = dict(carried or {})
    leaves = docs.select(
        docs[group_col].alias("grp"),
        docs[id_col].alias("ord"),
        leaf_digest([docs[c] for c in columns]).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        F.struct(docs[id_col].alias("id"), *(c.alias(f"c_{name}") for name, c in carried.items())).alias("item"),
    )
    tiers = _tiers(spark, lambda: _ranked(leaves, ["ord", "digest", "row"]), fanout)
    groups = tiers[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest", F.struct("grp").alias("item"))
    tops = _tiers(spark, lambda: _ranked(groups, ["name"]), fanout)

    top = F.struct(F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast(STEPS).alias("steps"))
    ways = _unfolded(tops[-1].withColumn("up", top), fanout)
    for blocks in reversed(tops[:-1]):
        ways = _unfolded(_with_ways(blocks, ways), fanout)
    ways = ways.select(
        F.col("item.grp").alias("grp"), F.lit(0).cast("long").alias("rank"), F.col("up").withField("subroot", F.col("digest")).alias("up")
    )
    for blocks in reversed(tiers):
        ways = _unfolded(_with_ways(blocks, ways), fanout)
    return ways.select(
        F.col("item.id").alias("id"), "grp", F.col("digest").alias("leaf"), "up.subroot", "up.root", F.col("up.steps").alias("proof"),
        *(F.col(f"item.c_{name}").alias(name) for name in carried),
    )


def _around(step: Column) -> tuple[Column, Column]:
    run, place = step["run"], step["place"]
    return F.slice(run, 1, place), F.slice(run, place + 2, F.size(run))


def siblings(proof: Column) -> Column:
    """The digests that a proof needs, level by level from the leaf's run to the root's, left to right."""
    return F.flatten(F.transform(proof, lambda step: F.concat(*_around(step))))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give; another than the manifest's where the leaf is another."""

    def up(digest: Column, step: Column) -> Column:
        left, right = _around(step)
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")), 256)

    return F.aggregate(proof, leaf, up)
