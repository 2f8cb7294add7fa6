"""The Merkle manifest against a tree built in Python, with odd rows and enough of them for several tiers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reportloom.llm.merkle import folded, leaf_digest, manifest, siblings

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp int, rank int, digest string, up string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes, fanout):
    """The root, and for each node the (run, place) on its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for way, i in zip(ways, at, strict=True):
            way.append((runs[i // fanout], i % fanout))
        at = [i // fanout for i in at]
        nodes = [h(run) for run in runs]
    return nodes[0], ways


def expected(rows, fanout):
    """(leaf, subroot, root, siblings) of the rows, as a sorted list with their ids."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])], fanout) for s in names}
    root, across = tree([trees[s][0] for s in names], fanout)
    out = []
    for s, upper in zip(names, across, strict=True):
        subroot, ways = trees[s]
        for (_, _, own, doc_id), way in zip(sorted(groups[s]), ways, strict=True):
            others = [d for run, place in way + upper for k, d in enumerate(run) if k != place]
            out.append((doc_id, own, subroot, root, others))
    return sorted(out, key=repr)


def found(df, fanout=16):
    proofs = manifest(df, fanout=fanout).withColumn("others", siblings(F.col("proof")))
    rows = proofs.withColumn("back", folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.back == r.root for r in rows)
    return sorted(((r.id, r.leaf, r.subroot, r.root, list(r.others)) for r in rows), key=repr)


def frame(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*row, 1, 2, "x", "y") for row in rows], SCHEMA)


@pytest.mark.parametrize(("n", "fanout"), [(1, 16), (2, 16), (17, 16), (700, 16), (300, 3)])
def test_proofs_against_a_tree(spark, n, fanout):
    rng = random.Random(n)
    rows = [(k, rng.choice(["a", "a", "é", "Z"]), "en", k, f"text {k} ü") for k in range(n)]
    rng.shuffle(rows)
    assert found(frame(spark, rows).repartition(4), fanout) == expected(rows, fanout)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (3, None, "", 0, ""), (3, None, "x", 0, "-"),
        (4, "", None, 1, "long " * 200_000), (-5, "a", "en", 2, "t"), (5, "a", "en", 2, "t"), (5, "a", "en", 2, "t"),
    ]
    assert found(frame(spark, rows)) == expected(rows, 16)
    assert manifest(frame(spark, [])).collect() == []


def test_rank_runs_on_over_partitions(spark):
    """One group over all partitions of the sort, beside many groups of one row: several tiers on both sides."""
    rows = [(k, "hot" if k % 3 else f"s{k:05}", "en", 1, str(k)) for k in range(1500)]
    assert found(frame(spark, rows).repartition(8), 4) == expected(rows, 4)


def test_changed_rows_do_not_fold_to_the_root(spark):
    df = frame(spark, [(k, "a", "en", 1, "Text" if k % 2 else "text") for k in range(40)])
    changed = leaf_digest([*(df[c] for c in COLUMNS[:-1]), F.lower(df["text"])])
    proofs = manifest(df, carried={"changed": changed})
    got = proofs.select("id", (folded(F.col("changed"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert {r.id: r.same for r in got} == {k: k % 2 == 0 for k in range(40)}
