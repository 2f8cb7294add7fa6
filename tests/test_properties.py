"""Properties that hold for any data."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reportloom.operators.combine import align_tables, append_tables
from reportloom.operators.lookup import first_per_key, lookup_join, rows_in_table, rows_not_in_table
from reportloom.operators.ordering import sort_rows
from reportloom.operators.pivot import group_agg, pivot_table
from reportloom.sources.outputs import write_output

few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
keys = st.one_of(st.none(), st.sampled_from(["a", "b", "C", "c", ""]))
tables = st.lists(st.tuples(keys, st.one_of(st.none(), st.integers(-5, 5))), max_size=25)


def frame(spark, data):
    return spark.createDataFrame(data, "k string, v int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@few
@given(main=tables, target=tables)
def test_lookup_keeps_every_main_row_once(spark, main, target):
    found = rows(lookup_join(frame(spark, main), frame(spark, target), "k", "k", "v", prefix="t_"))
    least = {}
    for k, v in target:
        if k is not None:
            least[k] = min(least.get(k, v), v, key=lambda x: (x is not None, x or 0))
    assert found == sorted(((k, v, least.get(k)) for k, v in main), key=repr)


@few
@given(main=tables, target=tables)
def test_value_tables_part_the_rows(spark, main, target):
    df, values = frame(spark, main), frame(spark, target)
    inside, outside = rows_in_table(df, "k", values, "k"), rows_not_in_table(df, "k", values, "k")
    assert rows(inside.union(outside)) == sorted(main, key=repr)


@few
@given(a=tables, b=tables)
def test_append_and_align_agree_with_plain_python(spark, a, b):
    left, right = frame(spark, a), frame(spark, b)
    assert rows(append_tables([left, right])) == sorted(a + b, key=repr)
    pairs = [(k, v, w) for k, v in a for m, w in b if k is not None and k == m]
    pairs += [(k, v, None) for k, v in a if k is None or k not in {m for m, _ in b}]
    pairs += [(k, None, w) for k, w in b if k is None or k not in {m for m, _ in a}]
    assert rows(align_tables([left, right.withColumnRenamed("v", "w")])) == sorted(pairs, key=repr)


@few
@given(data=tables.filter(lambda t: any(k is not None and v is not None for k, v in t)))
def test_pivot_cells_add_up_to_the_plain_sums(spark, data):
    df = frame(spark, data)
    wide = pivot_table(df.withColumn("one", df.k), ["k"], ["v"], {"one": "count"})
    counted = {r[0]: sum(r[1:]) for r in wide.collect()}
    plain = {r.k: r.v for r in group_agg(df, ["k"], {"v": "count"}).collect()}
    assert counted == {k: n for k, n in plain.items() if n}


@few
@given(data=tables)
def test_first_per_key_and_sort_depend_on_values_only(spark, data):
    df = frame(spark, data)
    once = rows(first_per_key(df.repartition(1), "k"))
    assert once == rows(first_per_key(df.repartition(7), "k")) and len(once) == len({k for k, _ in data})
    order = [r.v for r in sort_rows(df.repartition(5), [("v", False)]).collect()]
    assert order == sorted(order, key=lambda v: (v is None, -(v or 0)))


@pytest.mark.parametrize("cap", [1, 7, 100])
def test_splitting_keeps_all_rows(spark, tmp_path, cap):
    df = spark.range(60, numPartitions=5)
    for name, numbered in (("plain", False), ("numbered", True)):
        out = str(tmp_path / name)
        assert write_output(df, out, max_rows=cap, numbered_sheets=numbered) == 60
        back = spark.read.parquet(out)
        assert sorted(r.id for r in back.collect()) == list(range(60))
        assert back.selectExpr("_metadata.file_path AS f").groupBy("f").count().agg({"count": "max"}).first()[0] <= cap
