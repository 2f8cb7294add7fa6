import itertools
import random

import pytest
from pyspark.sql import functions as F

from reportloom.operators.combine import align_tables, append_tables
from reportloom.operators.lookup import (
    first_per_key,
    link_tables,
    lookup_join,
    pool_columns,
    rows_in_table,
    rows_not_in_table,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def target(spark):
    data = [("k1", 3, "c", 9), ("k1", 1, "b", None), ("k1", 2, "a", 1), (None, 5, "n", 1), ("k2", None, "z", 2)]
    return spark.createDataFrame(data, "k string, v int, t string, o int")


@pytest.fixture
def master(spark):
    return spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), ("k3", 4), (None, 5)], "k string, id int")


def test_one_match_per_row_and_null_keys_stay(master, target):
    out = lookup_join(master, target, "k", "k", "v, t", prefix="p_")
    assert out.columns == ["k", "id", "p_v", "p_t"]
    assert rows(out) == rows_of(
        [("k1", 1, 1, "b"), ("k1", 2, 1, "b"), ("k2", 3, None, "z"), ("k3", 4, None, None), (None, 5, None, None)]
    )


def rows_of(data):
    return sorted(data, key=repr)


def test_order_by_decides_and_null_order_values_come_first(master, target):
    out = lookup_join(master, target, "k", "k", ["t"], order_by="o").where("id = 1")
    assert rows(out) == [("k1", 1, "b")]
    out = lookup_join(master, target, "k", "k", ["t"], order_by="t").where("id = 1")
    assert rows(out) == [("k1", 1, "a")]


def test_collision_suffix_ignores_case(spark, master):
    target = spark.createDataFrame([("k1", 7, 8)], "key string, ID int, other int")
    out = lookup_join(master, target, "k", "key", "ID, other")
    assert out.columns == ["k", "id", "ID_dup", "other"]
    with pytest.raises(ValueError, match="exists already"):
        lookup_join(out, target, "k", "key", "ID")


def test_bad_rules_fail_while_planning(master, target):
    with pytest.raises(ValueError, match="pair up"):
        lookup_join(master, target, "k, id", "k", "v")
    with pytest.raises(ValueError, match="cannot be picked"):
        lookup_join(master, target, "k", "k", "k, v")
    with pytest.raises(ValueError, match="unknown column"):
        lookup_join(master, target, "nope", "k", "v")


def test_keys_match_by_text(spark):
    numbers = spark.createDataFrame([(1,), (7,)], "n bigint")
    texts = spark.createDataFrame([("1", "a"), ("07", "b"), (" 7", "c")], "s string, v string")
    assert rows(lookup_join(numbers, texts, "n", "s", "v")) == [(1, "a"), (7, None)]
    doubles = spark.createDataFrame([(1.0, "d")], "x double, v string")
    assert rows(lookup_join(numbers, doubles, "n", "x", "v")) == [(1, None), (7, None)]
    ints = spark.createDataFrame([(1, "i")], "x int, v string")
    assert rows(lookup_join(numbers, ints, "n", "x", "v")) == [(1, "i"), (7, None)]


def test_nan_keys_are_missing(spark):
    left = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, id int")
    right = spark.createDataFrame([(float("nan"), "n"), (2.0, "t")], "x double, v string")
    assert rows(lookup_join(left, right, "x", "x", "v").select("id", "v")) == [(1, None), (2, "t")]


def test_composite_keys_pair_by_position(spark):
    master = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    target = spark.createDataFrame([("a", 1, "hit"), ("b", 1, "miss")], "p string, q int, v string")
    assert rows(lookup_join(master, target, "x + y", "q + p", "v")) == [(1, "a", "hit"), (2, "b", None)]


def test_self_lookup_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "`my.id` int, `up id` int, `the name` string")
    out = lookup_join(df, df, ["up id"], ["my.id"], ["the name"], prefix="up.")
    assert rows(out) == [(1, 2, "a", "b"), (2, 1, "b", "a")]


def test_chain_uses_earlier_picks_and_isolates_failures(spark, master, target):
    second = spark.createDataFrame([("a", "A!"), ("z", "Z!")], "t string, big string")
    events = []

    def broken():
        raise OSError("unreadable")

    rules = [
        {"target": target, "master_keys": "k", "target_keys": "k", "pick": "t"},
        {"target": broken, "master_keys": "k", "target_keys": "k", "pick": "v"},
        {"target": target, "master_keys": "nope", "target_keys": "k", "pick": "v"},
        {"target": second, "master_keys": "t", "target_keys": "t", "pick": "big"},
    ]
    out = link_tables(master, rules, on_error="skip", on_event=lambda r, e, n: events.append((bool(e), n)))
    assert events == [(False, 1), (True, 0), (True, 0), (False, 1)]
    assert rows(out.select("id", "big")) == [(1, "A!"), (2, "A!"), (3, "Z!"), (4, None), (5, None)]
    with pytest.raises(OSError):
        link_tables(master, rules)
    assert pool_columns(master, [rules[0], rules[3]]) == ["k", "id", "t", "big"]


def test_first_per_key_keeps_null_keys_and_order(spark, target):
    out = first_per_key(target, "k", order_by="v")
    assert out.columns == ["k", "v", "t", "o"]
    expected = rows_of([("k1", 1, "b", None), (None, 5, "n", 1), ("k2", None, "z", 2)])
    assert rows(out) == expected
    assert first_per_key(target.select("k"), "k").count() == 3


@pytest.mark.parametrize("partitions", [1, 8])
def test_result_does_not_depend_on_partitioning(spark, master, target, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = lookup_join(master.repartition(3), target.repartition(4), "k", "k", "t, v")
        assert out.count() == master.count()
        assert rows(out.where("id = 1")) == [("k1", 1, "a", 2)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_value_tables(spark, master):
    values = spark.createDataFrame([("k1",), ("k1",), (None,)], "v string")
    assert rows(rows_in_table(master, "k", values, "v")) == [("k1", 1), ("k1", 2)]
    assert rows(rows_not_in_table(master, "k", values, "v")) == rows_of([("k2", 3), ("k3", 4), (None, 5)])
    numbers = spark.createDataFrame([("1",), ("x",)], "v string")
    assert rows(rows_in_table(master, "id", numbers, "v").select("id")) == [(1,)]


def test_append_by_name_with_mixed_types(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", "text", 2.5)], "s string, n string, extra double")
    out = append_tables([a, b, a])
    assert out.columns == ["n", "s", "extra"]
    assert rows(out) == rows_of([("1", "x", None), ("text", "y", 2.5), ("1", "x", None)])
    widened = append_tables([a.select("n"), spark.createDataFrame([(2.5,)], "n double")])
    assert rows(widened) == [(1.0,), (2.5,)]


def test_align_is_a_sorted_full_outer_join(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, 20), (3, 30), (None, 0)], "k int, b int")
    out = [tuple(r) for r in align_tables([a, b]).collect()]
    assert out[:3] == [(1, "y", None), (2, "x", 20), (3, None, 30)]
    assert rows_of(out[3:]) == rows_of([(None, "n", None), (None, None, 0)])
    c = spark.createDataFrame([(1, "c"), (1, "C"), (9, "z")], "k bigint, c string")
    three = align_tables([a, b, c])
    assert three.columns == ["k", "a", "b", "c"]
    assert rows(three.where("k IS NOT NULL")) == rows_of(
        [(1, "y", None, "C"), (1, "y", None, "c"), (2, "x", 20, None), (3, None, 30, None), (9, None, None, "z")]
    )
    with pytest.raises(ValueError, match="share no column"):
        align_tables([a.select("a"), b])
    with pytest.raises(ValueError, match="several tables"):
        align_tables([a, a.select("k", "a"), b])


def beside(tables):
    """Brute force: rows as (key, values of the first table, of the second, ...); keys of two columns, null matches nothing."""
    keys = {k for table in tables for *k, _ in map(tuple, table) for k in [tuple(k)] if None not in k}
    out = []
    for key in keys:
        held = [[r[-1] for r in table if r[:-1] == key] or [None] for table in tables]
        out += [(*key, *values) for values in itertools.product(*held)]
    for i, table in enumerate(tables):
        out += [(*r[:-1], *(r[-1] if j == i else None for j in range(len(tables)))) for r in table if None in r[:-1]]
    return rows_of(out)


@pytest.mark.parametrize("block", [1, 3000, 1 << 22])
def test_align_of_several_tables(spark, monkeypatch, block):
    """Hot keys on one, two and all sides, whatever the size of a block; repeated rows, null and missing keys."""
    monkeypatch.setattr("reportloom.operators.combine._BLOCK", block)
    rng = random.Random(block)
    tables = []
    for t, (n, hot) in enumerate([(60, 0.4), (25, 0.2), (30, 0.0), (4, 0.5)]):
        keys = [(1, "h") if rng.random() < hot else (rng.randint(0, 6), rng.choice(["a", "b", None, "h"])) for _ in range(n)]
        tables.append([(*k, rng.choice([None, f"{t}{rng.randint(0, 9)}"])) for k in keys])
        tables[-1][0] = (None, "a", "0")
    frames = [spark.createDataFrame(t, f"k int, K2 string, v{i} string").repartition(3) for i, t in enumerate(tables)]
    for n in (3, 4):
        out = align_tables(frames[:n], ordered=False)
        assert out.columns == ["k", "K2", *(f"v{i}" for i in range(n))]
        assert rows(out) == beside(tables[:n])


def test_align_of_tables_without_rows_or_other_columns(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(1, "x"), (2, None)], "k int, b string")
    assert rows(align_tables([a, b, a])) == rows_of([(1, "x")] * 4 + [(2, None), (None, None), (None, None)])
    assert rows(align_tables([a.limit(0), b.limit(0), a.limit(0)])) == []
    nan = spark.createDataFrame([(float("nan"), 1), (-0.0, 2)], "k double, a int")
    other = nan.selectExpr("abs(k) AS k", "a AS b")
    for tables in ([nan, other], [nan, other, a.selectExpr("cast(k AS double) AS k").limit(0)]):
        assert rows(align_tables(tables)) == rows_of([(0.0, 2, 2), (None, 1, None), (None, None, 1)])


def test_each_aligned_table_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(k):
        seen.add(1)
        return k

    one = spark.range(0, 50, 1, 2).select(counted("id").alias("k"), F.col("id").alias("a"))
    others = [spark.range(20).selectExpr("cast(id AS int) AS k", f"id AS v{i}") for i in range(3)]
    out = align_tables([one, *others])
    assert out.count() == 50 and rows(out)[5] == (13, 13, 13, 13, 13)
    assert seen.value == 50


def chain_rules(spark, rng):
    def rows(n, keys, values):
        return [(rng.choice([None, *range(keys)]), rng.choice([None, *range(values)]), f"v{rng.randrange(9)}") for _ in range(n)]

    a = spark.createDataFrame(rows(60, 20, 12), "ak int, b long, name string")
    b = spark.createDataFrame([(str(k), v, n) for k, v, n in rows(40, 12, 7)], "bk string, c int, name string")
    c = spark.createDataFrame(rows(30, 7, 5), "ck long, d int, Name string")
    return [
        {"target": a, "master_keys": "k", "target_keys": "ak", "pick": "b, name"},
        {"target": b, "master_keys": "b", "target_keys": "bk", "pick": "c, name", "prefix": "b_", "order_by": "name"},
        {"target": c, "master_keys": "b_c", "target_keys": "ck", "pick": "d, Name", "prefix": "c_"},
        {"target": a, "master_keys": "k, b", "target_keys": "ak, b", "pick": "name", "prefix": "both_"},
        {"target": c, "master_keys": "b, b_c", "target_keys": "ck, d", "pick": "Name", "prefix": "two_"},
        {"target": b, "master_keys": "C", "target_keys": "A", "pick": "B", "prefix": "letter_", "by_letter": True},
        {"target": c, "master_keys": "missing", "target_keys": "ck", "pick": "d"},
        {"target": b, "master_keys": "k", "target_keys": "bk", "pick": "name"},
    ]


@pytest.mark.parametrize("seed", range(3))
def test_contracted_chains_give_the_same_table(spark, seed, monkeypatch):
    from reportloom.operators import lookup as L

    rng = random.Random(seed)
    main = spark.createDataFrame([(rng.choice([None, *range(25)]), i, "m") for i in range(50)], "k long, i int, name string")
    rules = chain_rules(spark, rng)
    heard = {}
    tables = {}
    for contract in (False, True):
        monkeypatch.setattr(L, "_estimate", lambda df: 1)
        events = []
        out = link_tables(main, rules, "skip", lambda rule, error, picks: events.append((error is None, picks)), contract)  # noqa: B023
        heard[contract], tables[contract] = events, (out.columns, sorted(map(repr, out.collect())))
    assert heard[True] == heard[False] and [ok for ok, _ in heard[True]].count(False) == 2
    assert tables[True] == tables[False]
    assert tables[True][0][:5] == ["k", "i", "name", "b", "name_dup"]


def test_pruned_targets_give_the_same_table(spark, monkeypatch):
    from reportloom.operators import lookup as L

    main = spark.createDataFrame([(k, str(k)) for k in [1, 5, 5, None, 900, 77]], "k int, t string")
    target = spark.createDataFrame([(k % 1000, k % 7, k) for k in range(5000)] + [(None, 1, 1)], "k long, v int, o long")
    for keys, others, pick in ((["k"], ["k"], "v"), (["t"], ["k"], "v"), (["k", "t"], ["k", "v"], "o")):
        wanted = lookup_join(main, target, keys, others, pick, order_by="o")
        for most in (L.PRUNING_KEYS, 2):
            monkeypatch.setattr(L, "PRUNING_KEYS", most)
            got = lookup_join(main, target, keys, others, pick, order_by="o", prune=True)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
        monkeypatch.undo()
    empty = lookup_join(main.limit(0), target, "k", "k", "v", prune=True)
    assert empty.columns == ["k", "t", "v"] and empty.collect() == []
