"""Near duplicates among embeddings by NN-descent over a graph of close neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import components, finished, ship_code, staged

#: Cosine of a link; cosine from which a neighbour is kept in the graph.
LINK, NEAR = 0.98, 0.9
#: Neighbours in a list; neighbours compared on each side of a sorted order; orders in a round.
LIST, REACH, ORDERS = 12, 8, 8
#: Recall that the audit asks for, queries it takes, rounds at most before the rest is compared in blocks.
RECALL, QUERIES, ROUNDS = 0.97, 400, 4
#: Queries with true links that the audit wants to see outside the dense components; times its queries double for that.
LINKED, DOUBLED = 100, 3
#: Vectors in a block of those that are compared with all of a group.
BLOCK = 512


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one as doubles; null where one has nothing to compare."""
    for batch in batches:
        out = []
        for vector in batch.column("embedding"):
            unit = None
            if vector.is_valid and len(vector) and vector.values.null_count == 0:
                numbers = np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(numbers).max()
                if np.isfinite(top) and top > 0:
                    scaled = numbers / top
                    unit = (scaled / np.sqrt((scaled * scaled).sum())).astype("<f8").tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "unit"]
        )


def _matrix(units: pa.Array | list[bytes]) -> np.ndarray:
    rows = units if isinstance(units, list) else units.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _place(batches: Iterator[pa.RecordBatch], bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for every order, with its key there: signs of random projections, then one projection."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            x = _matrix(own.column("unit"))
            for order in range(ORDERS):
                onto = np.random.default_rng([seed, order, int(size)]).standard_normal((x.shape[1], bits + 1))
                y = x @ onto
                code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), order, np.int32)), own.column("grp"), pa.array(code), pa.array(y[:, bits]),
                        own.column("vec"), own.column("unit"),
                    ],
                    names=["ord", "grp", "code", "along", "vec", "unit"],
                )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each vector of a sorted partition with the few before it in the same order and group."""
    tail: list[tuple] = []
    for batch in batches:
        rows = tail + list(zip(*(batch.column(c).to_pylist() for c in ("ord", "grp", "vec", "unit")), strict=True))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        begin = 0
        for k in range(1, len(rows) + 1):
            if k < len(rows) and rows[k][:2] == rows[begin][:2]:
                continue
            ids, x = np.array([r[2] for r in rows[begin:k]], np.int64), _matrix([r[3] for r in rows[begin:k]])
            for step in range(1, min(REACH, len(ids) - 1) + 1):
                cosines = np.einsum("ij,ij->i", x[:-step], x[step:])
                near = np.flatnonzero(cosines >= NEAR)
                found.append((ids[near], ids[near + step], cosines[near]))
            begin = k
        tail = rows[-REACH:]
        u, v, c = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(c.astype(np.float64))], names=["u", "v", "cosine"]
        )


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [float(np.frombuffer(a, "<f8") @ np.frombuffer(b, "<f8")) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        near = pa.array([x >= NEAR for x in c], pa.bool_())
        out = pa.table({"u": batch.column("u"), "v": batch.column("v"), "cosine": pa.array(c, pa.float64())})
        yield from out.filter(near).to_batches()


_EDGE = "u long, v long, cosine double"


def sorted_neighbours(vectors: DataFrame, bits: int, seed: int) -> DataFrame:
    """Close pairs that stand together in orders by hashed projections; sorted by range, so that no bucket is one task's."""
    placed = vectors.mapInArrow(
        lambda batches: _place(batches, bits, seed),
        "ord int, grp long, code long, along double, vec long, unit binary",
    )
    order = ["ord", "grp", "code", "along", "vec"]
    swept = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, _EDGE)
    return swept


def merged(graph: DataFrame) -> DataFrame:
    return staged(graph.groupBy("u", "v").agg(F.max("cosine").alias("cosine")), "nn-graph")


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))


def neighbours_of_neighbours(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs that are in one list of nearest neighbours and not yet in the graph, with their cosines where close."""
    best = Window.partitionBy("u").orderBy(F.desc("cosine"), "v")
    lists = both_ways(graph).withColumn("place", F.row_number().over(best)).where(F.col("place") <= LIST)
    lists = staged(lists.select("u", "v"), "nn-lists")
    met = lists.join(lists.select("u", F.col("v").alias("w")), "u").where("v < w")
    new = met.select(F.col("v").alias("u"), F.col("w").alias("v")).distinct().join(graph.select("u", "v"), ["u", "v"], "left_anti")
    a = vectors.select(F.col("vec").alias("u"), F.col("unit").alias("a"), F.col("grp").alias("ga"))
    b = vectors.select(F.col("vec").alias("v"), F.col("unit").alias("b"), F.col("grp").alias("gb"))
    with_units = new.join(a, "u").join(b, "v").where("ga = gb").select("u", "v", "a", "b")
    return with_units.mapInArrow(_cosines, _EDGE)


def blockwise(members: DataFrame) -> DataFrame:
    """Links of vectors (``team``, ``vec``, ``unit``, ``copies``) within their teams, counted block against block.

    Each vector gets one row per block of its team, with the number of vectors linked there. Also gives, for each vector and
    block, the first vector linked, from which the same components follow as from all links.
    """
    place = F.row_number().over(Window.partitionBy("team").orderBy("vec")) - 1
    placed = members.withColumn("block", F.floor(place / BLOCK).cast("long"))
    blocks = placed.groupBy("team", "block").agg(F.sort_array(F.collect_list(F.struct("vec", "unit", "copies"))).alias("rows"))
    blocks = staged(blocks, "nn-blocks")
    other = blocks.select("team", F.col("block").alias("other"), F.col("rows").alias("others"))
    met = blocks.join(other, "team").repartition(F.col("team"), F.col("block"), F.col("other"))
    return met.select("rows", "others").mapInArrow(_count_blocks, "vec long, links long, least long")


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.array([r["vec"] for r in row["rows"]], np.int64)
            others = np.array([r["vec"] for r in row["others"]], np.int64)
            copies = np.array([r["copies"] for r in row["others"]], np.int64)
            hit = _matrix([r["unit"] for r in row["rows"]]) @ _matrix([r["unit"] for r in row["others"]]).T >= LINK
            hit &= ids[:, None] != others[None, :]
            some = hit.any(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array((hit[some] * copies).sum(1)), pa.array(others[hit[some].argmax(1)])],
                names=["vec", "links", "least"],
            )


def _audit(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    groups: dict[int, list[tuple[int, bytes]]] = {}
    for vec, grp, unit in queries:
        groups.setdefault(grp, []).append((vec, unit))
    for batch in batches:
        grps = batch.column("grp").to_numpy()
        for grp, own in groups.items():
            rows = batch.filter(pa.array(grps == grp))
            if rows.num_rows:
                ids = np.array([vec for vec, _ in own], np.int64)
                hit = _matrix([unit for _, unit in own]) @ _matrix(rows.column("unit")).T >= LINK
                hit &= ids[:, None] != rows.column("vec").to_numpy()[None, :]
                links = (hit * rows.column("copies").to_numpy()).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["vec", "links"])


def dense_members(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of a graph, and the vectors (``team``, ``vec``) of the components in which some list is full of links."""
    links = staged(graph.where(F.col("cosine") >= LINK).select("u", "v"), "nn-links")
    member = components(links, "nn-components")
    full = both_ways(links.withColumn("cosine", F.lit(1.0))).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LIST)
    dense = staged(member.join(full, F.col("node") == F.col("u")).select("component").distinct(), "nn-dense")
    return links, staged(member.join(dense, "component").select(F.col("component").alias("team"), F.col("node").alias("vec")), "nn-inside")


def outside(links: DataFrame, inside: DataFrame) -> DataFrame:
    return links.join(inside.select(F.col("vec").alias("u")), "u", "left_anti")


def counted_links(links: DataFrame, inside: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each vector (``vec``, ``links``, copies counted, whether it is in a dense component) and edges that give the components.

    A list that is full of links may be too short: the vector's component then takes the place of the list, and all
    its vectors are compared block against block.
    """
    again = staged(blockwise(inside.join(vectors, "vec").select("team", "vec", "unit", "copies")), "nn-counts")
    weights = vectors.select(F.col("vec").alias("v"), "copies")
    plain = both_ways(outside(links, inside).withColumn("cosine", F.lit(1.0))).join(weights, "v").groupBy(F.col("u").alias("vec")).agg(F.sum("copies").alias("links"))
    counts = plain.withColumn("dense", F.lit(False)).union(again.groupBy("vec").agg(F.sum("links").alias("links")).withColumn("dense", F.lit(True)))
    return staged(counts, "nn-found"), links.union(again.select("vec", "least"))


def recall(counts: DataFrame, vectors: DataFrame) -> float:
    """Mean over vectors that have true links of the share that was counted, by brute force for vectors drawn by a hash.

    Drawn apart: vectors of dense components, others with links, others without. The first speak for themselves, the
    rest by their numbers; the smaller of both means is given. Outside the dense components queries double until enough have true links.
    """
    known = vectors.join(counts, "vec", "left").withColumn("stratum", F.when(F.col("dense"), 0).when(F.col("links") > 0, 1).otherwise(2))
    known = staged(known.select("vec", "grp", "unit", "stratum", F.coalesce("links", F.lit(0)).alias("links")), "nn-audit")
    sizes = {r["stratum"]: r["count"] for r in known.groupBy("stratum").count().collect()}
    means: dict[int, tuple[float, int, int]] = {}

    def seen(stratum: int, n: int) -> None:
        """Sum of the queries' shares, how many have true links, how many there are."""
        drawn = known.where(F.col("stratum") == stratum).orderBy(F.xxhash64("unit", F.lit(5)), "vec").limit(n).collect()
        queries, found = [(r["vec"], r["grp"], r["unit"]) for r in drawn], {r["vec"]: r["links"] for r in drawn}
        true = vectors.mapInArrow(lambda batches: _audit(batches, queries), "vec long, links long").groupBy("vec").agg(F.sum("links").alias("true"))
        shares = [found[r["vec"]] / r["true"] for r in true.where(F.col("true") > 0).collect()]  # at most one for each query
        means[stratum] = sum(shares), len(shares), len(drawn)

    if sizes.get(0):
        seen(0, QUERIES // 4)
    for turn in range(DOUBLED + 1):
        for stratum in {1, 2} & sizes.keys():
            n = QUERIES * 3 // 8 << turn
            if stratum not in means or means[stratum][2] < sizes[stratum]:
                seen(stratum, n)
        if sum(means[k][1] for k in (1, 2) if k in means) >= LINKED:
            break
    told = []
    for strata in ((0,), (1, 2)):
        weights = {k: sizes[k] / means[k][2] for k in strata if k in means}
        linked = sum(w * means[k][1] for k, w in weights.items())
        if linked:
            told.append(sum(w * means[k][0] for k, w in weights.items()) / linked)
    return min(told, default=1.0)


def near_duplicate_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label, and their components.

    Equal vectors of a label are one node with its number of copies. The first graph comes from sorted orders by
    hashed projections. Then, as in NN-descent, vectors in the list of a common neighbour are compared, round
    by round, until a round finds hardly any new link outside the dense components. Lists that are full of links are enlarged to their whole component, in
    which all vectors are compared block against block; nothing but counts and one link per vector and block leaves a
    task, so a group of near copies is never written out as pairs. An audit compares some vectors with all others, those in
    dense components and the rest apart, each vector with links counting the same; below a recall of 0.97 new orders are added, and after four such rounds groups of one label are compared in blocks throughout,
    which is exact. Every reported link is checked in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label or an id, link with
    nothing: no links, their own id as component. Vectors of different lengths are never compared. Rows that repeat id and vector are copies
    of each other; an empty table gives an empty table; other columns are not looked at. Returns ``vec_id``, ``n_links``,
    ``component_id``, ``kept``.
    """
    ship_code(embeddings.sparkSession)
    return finished(
        embeddings.sparkSession, "nn-result", lambda: _near_duplicate_vectors(embeddings, id_col, vector_col, label_col)
    )


def _near_duplicate_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = embeddings.select(
        embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].alias("embedding"),
        embeddings[label_col].cast("string").alias("label"),
    )
    units = staged(rows.mapInArrow(_units, "vec_id long, label string, unit binary"), "nn-units")
    usable = units.where("unit IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    vectors = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # Nodes are numbered, as an id may be there with several vectors.
    vectors = staged(
        vectors.select(
            F.monotonically_increasing_id().alias("vec"), "first", "copies", "label", "unit", F.octet_length("unit").alias("size"),
            F.xxhash64("label", F.octet_length("unit")).alias("grp"),
        ),
        "nn-vectors",
    )
    bits = max(4, min(40, int(math.log2(max(2, vectors.count()))) - 3))
    graph = merged(sorted_neighbours(vectors, bits, 0))
    counts, edges = None, None
    for turn in range(ROUNDS):
        for _ in range(2 + turn):
            before = graph.where(F.col("cosine") >= LINK)
            graph = merged(graph.union(neighbours_of_neighbours(graph, vectors)))
            links, inside = dense_members(graph)
            if outside(links, inside).count() <= 1.01 * outside(before, inside).count():
                break
        counts, edges = counted_links(links, inside, vectors)
        if recall(counts, vectors) >= RECALL:
            break
        graph = merged(graph.union(sorted_neighbours(vectors, bits, turn + 1)))
    else:
        again = staged(blockwise(vectors.select(F.col("grp").alias("team"), "vec", "unit", "copies")), "nn-exact")
        counts, edges = again.groupBy("vec").agg(F.sum("links").alias("links")), again.select(F.col("vec").alias("u"), F.col("least").alias("v"))
    member = components(edges.toDF("u", "v"), "nn-components")
    named = member.withColumnRenamed("node", "vec").join(vectors.select("vec", "first"), "vec")
    named = member.join(named.groupBy("component").agg(F.min("first").alias("least")), "component").select(F.col("node").alias("vec"), "least")
    known = vectors.join(counts, "vec", "left").join(named, "vec", "left")
    known = known.select(
        F.col("label").alias("l"), F.col("unit").alias("x"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "first").alias("component"),
    )
    told = units.join(known, (F.col("label") == F.col("l")) & (F.col("unit") == F.col("x")) & F.col("vec_id").isNotNull(), "left")
    return told.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
