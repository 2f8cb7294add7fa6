from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reportloom.operators import predicates as P


@pytest.fixture(scope="module")
def df(spark):
    data = [
        (1, "x", 1.0, "2024-01-01 00:00:00", True),
        (2, "y", 2.0, "2024-01-02 10:00:00", False),
        (3, None, 3.0, None, None),
        (4, "q", float("nan"), "2024-02-01 00:00:00", True),
        (5, "A", None, "2023-12-31 23:59:59", False),
        (6, "5", 5.5, "2024-01-01 00:00:00", True),
        (7, "007", -1.0, "2024-01-01 00:00:01", True),
    ]
    df = spark.createDataFrame(data, "id int, s string, d double, ts string, b boolean")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("day", F.col("ts").cast("date"))


def ids(df, condition):
    return sorted(r.id for r in P.filter_rows(df, condition).collect())


@pytest.mark.parametrize(
    "condition, expected",
    [
        (P.eq("s", "x"), [1]),
        (P.eq("s", 5), [6]),
        (P.eq("s", 7), []),
        (P.eq("d", 2), [2]),
        (P.eq("d", "2"), [2]),
        (P.eq("d", "two"), []),
        (P.eq("id", True), [1]),
        (P.eq("b", True), [1, 4, 6, 7]),
        (P.ne("s", "x"), [2, 3, 4, 5, 6, 7]),
        (P.ne("d", 2), [1, 3, 4, 5, 6, 7]),
        (P.ne("d", "two"), [1, 2, 3, 4, 5, 6, 7]),
        (P.gt("d", 2), [3, 6]),
        (P.ge("d", "2"), [2, 3, 6]),
        (P.lt("d", 2), [1, 7]),
        (P.le("d", 2), [1, 2, 7]),
        (P.gt("s", "a"), [1, 2, 4]),
        (P.contains("s", "[xy]"), [1, 2]),
        (P.contains("s", "[xy]", regex=False), []),
        (P.contains("id", "1"), [1]),
        (P.not_contains("s", "x"), [2, 3, 4, 5, 6, 7]),
        (P.starts_with("s", "0"), [7]),
        (P.ends_with("s", "7"), [7]),
        (P.starts_with("d", "5."), [6]),
        (P.is_in("s", ["x", 5, "none"]), [1, 6]),
        (P.is_in("id", [1, "2", "x"]), [1, 2]),
        (P.is_in("id", ["x"]), []),
        (P.not_in("s", ["x", "y"]), [3, 4, 5, 6, 7]),
        (P.not_in("id", ["x"]), [1, 2, 3, 4, 5, 6, 7]),
        (P.between("d", 1, 3), [1, 2, 3]),
        (P.is_null("s"), [3]),
        (P.is_null("d"), [4, 5]),
        (P.not_null("d"), [1, 2, 3, 6, 7]),
        (P.eq("ts", "2024-01-01"), [1, 6]),
        (P.ge("ts", "2024/1/2"), [2, 4]),
        (P.ne("ts", "2024-01-01"), [2, 3, 4, 5, 7]),
        (P.is_in("ts", ["2024-01-01", "2024-02-01"]), [1, 4, 6]),
        (P.eq("ts", "soon"), []),
        (P.eq("day", "2024-01-01"), [1, 6, 7]),
        (P.gt("day", "2024-01-01 12:00:00"), [2, 4]),
        (P.all_of(P.gt("id", 2), P.lt("id", 5)), [3, 4]),
        (P.any_of(P.eq("id", 1), P.between("id", 5, 6)), [1, 5, 6]),
        (P.sql("id % 2 = 0"), [2, 4, 6]),
    ],
)
def test_conditions(df, condition, expected):
    assert ids(df, condition) == expected


def test_impossible_orderings_fail_while_planning(df):
    for condition in (P.lt("s", 5), P.gt("d", "much"), P.le("ts", "soon"), P.between("s", 1, 2)):
        with pytest.raises(TypeError, match="cannot be ordered"):
            condition(df)


def test_plain_specifications(df):
    spec = {"all": [{"col": "id", "op": ">", "value": 1}, {"any": ["id = 2", {"col": "s", "op": "isna"}]}]}
    assert ids(df, spec) == [2, 3]
    assert ids(df, {"col": "s", "op": "in", "value": "x;y\n x"}) == [1, 2]
    assert ids(df, {"col": "id", "op": "between", "value": [2, 3]}) == [2, 3]
    assert ids(df, "id = 4") == [4]
    assert ids(df, F.col("id") == 5) == [5]
    assert len(ids(df, None)) == 7
    with pytest.raises(ValueError, match="unknown operator"):
        P.condition_from({"col": "id", "op": "like", "value": 1})


def test_value_lists(spark):
    text = " a,b;c\td\na，e；f,, "
    assert P.split_values(text) == ["a", "b", "c", "d", "e", "f"]
    table = spark.createDataFrame([(text,), ("b;　z ",), (None,)], "t string")
    assert sorted(r.value for r in P.split_value_table(table, "t").collect()) == list("abcdefz")


@pytest.mark.parametrize(
    ("kind", "rows", "values"),
    [
        ("long", [1, 2, 3, None, 2**62, -7], [1, "2", 2.5, "x", 3.0, "4611686018427387904", -9, 10**30, float("nan")]),
        ("double", [1.0, 2.5, None, float("nan"), -0.0], [1, "2.5", 0, "none", 1e300]),
        ("string", ["a", "1", "1.0", None, ""], ["a", 1, "", "zz"]),
        ("decimal(20,4)", [Decimal("1.5000"), Decimal("2"), None, Decimal("0.0001")], ["1.5", 2, 0.0001, "1e-4", "9"]),
        ("date", [date(2024, 1, 2), date(2024, 2, 2), None], ["2024-1-2", "2024/02/02 00:00:01", "never"]),
        ("timestamp_ntz", [datetime(2024, 1, 2), datetime(2024, 2, 2, 5), None], ["2024-1-2", "2024/02/02 05:00:00", 5]),
        ("boolean", [True, False, None], [1, "x"]),
    ],
)
def test_long_lists_decide_as_short_ones(spark, monkeypatch, kind, rows, values):
    df = spark.createDataFrame(list(enumerate(rows)), f"id int, v {kind}")
    conditions = [
        lambda: P.is_in("v", values), lambda: P.not_in("v", values), lambda: P.any_of(P.is_in("v", values), P.eq("id", 0)),
        lambda: P.all_of(P.not_in("v", values), P.any_of(P.is_in("id", [0, 1, 2]), P.is_null("v"))),
    ]
    short = [sorted(r.id for r in P.filter_rows(df, make()).collect()) for make in conditions]
    monkeypatch.setattr(P, "SHORT_LIST", 0)
    long = [P.filter_rows(df, make()) for make in conditions]
    assert [sorted(r.id for r in out.collect()) for out in long] == short
    assert all(out.columns == ["id", "v"] for out in long)


def test_tables_inside_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, None)], "id int, v string")
    values = spark.createDataFrame([("1", 1.0), ("1", 2.0), (None, 3.0), ("4", 4.0)], "k string, id double")
    inside, outside = P.in_table("id", values, "k"), P.not_in_table("id", values, "k")
    assert sorted(r.v or "" for r in P.filter_rows(df, inside).collect()) == ["", "a"]
    assert sorted(r.v for r in P.filter_rows(df, outside).collect()) == ["b", "c"]
    assert sorted(r.v for r in P.filter_rows(df, P.any_of(inside, P.eq("v", "b"))).where("v IS NOT NULL").collect()) == ["a", "b"]
    both = P.any_of(P.all_of(inside, P.not_null("v")), P.all_of(outside, P.is_null("id")))
    assert sorted(r.v for r in P.filter_rows(df, both).collect()) == ["a", "c"]
