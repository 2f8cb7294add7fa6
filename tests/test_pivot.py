import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reportloom.operators.median import group_medians
from reportloom.operators.pivot import group_agg, pivot_renames, pivot_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def gaps(spark):
    data = [
        ("a", "p", "x", 1, 1.0),
        ("a", "p", "x", 3, None),
        ("a", "q", "y", None, 2.0),
        ("b", "p", "z", 5, float("nan")),
        ("c", "q", "x", None, None),
        (None, "p", "x", 100, 100.0),
        ("a", None, "x", 100, 100.0),
    ]
    return spark.createDataFrame(data, "g string, p string, t string, n int, d double")


def test_group_agg_names_order_and_zero_fill(gaps):
    out = group_agg(gaps, ["g"], {"n": "sum", "d": "mean", "t": "max"})
    assert out.columns == ["g", "d", "n", "t"]
    assert rows(out) == [("a", 34.333333333333336, 104, "y"), ("b", 0.0, 5, "z"), ("c", 0.0, 0, "x")]


def test_groups_of_nulls_only(gaps):
    assert rows(group_agg(gaps, ["g"], {"d": "mean"})) == [("a", 34.333333333333336)]
    assert rows(group_agg(gaps, ["g"], {"d": "median"})) == [("a", 2.0)]
    assert rows(group_agg(gaps, ["g"], {"d": "sum"})) == [("a", 103.0), ("b", 0.0), ("c", 0.0)]
    assert rows(group_agg(gaps, ["g"], {"d": "prod"})) == [("a", 200.0), ("b", 1.0), ("c", 1.0)]


def test_functions_agree_with_pandas(spark):
    values = [3.5, 1.0, 2.0, 2.0, 9.25, -4.0, 7.0]
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 2, "v": values, "o": range(7)})
    df = spark.createDataFrame(pdf)
    for fn in ("sum", "mean", "count", "min", "max", "median", "nunique", "std", "var", "size", "prod", "sem"):
        expected = pdf.groupby("g").v.agg(fn)
        found = {r.g: r.v for r in group_agg(df, ["g"], {"v": fn}).collect()}
        assert found == pytest.approx(dict(expected)), fn
    skew = {r.g: r.v for r in group_agg(df, ["g"], {"v": "skew"}).collect()}
    assert skew == pytest.approx({"a": pdf.v[:5].skew()})  # two values have none
    assert {r.g: r.v for r in group_agg(df, ["g"], {"v": "first"}, order_by=["o"]).collect()} == {"a": 3.5, "b": -4.0}
    assert {r.g: r.v for r in group_agg(df, ["g"], {"v": "last"}, order_by=["o"]).collect()} == {"a": 9.25, "b": 7.0}
    assert {r.g: r.v for r in group_agg(df, ["g"], {"v": "approx_nunique"}).collect()} == {"a": 4, "b": 2}


def test_products_beyond_the_doubles(spark):
    data = [("far", 1e200)] * 3 + [("back", x) for x in (1e200, -1e200, 1e-200, 1e-150, None)]
    data += [("low", x) for x in (1e-200, 1e-200, 1e200, 1e150)] + [("none", 0.0), ("none", 1e300), ("minus", -2.0), ("gone", None)]
    df = spark.createDataFrame(data, "g string, v double").coalesce(1)
    found = dict(rows(group_agg(df, ["g"], {"v": "prod"})))
    expected = {"far": float("inf"), "back": -1e50, "low": 1e-50, "none": 0.0, "minus": -2.0, "gone": 1.0}
    assert found == pytest.approx(expected)
    logs = dict(rows(group_agg(df, ["g"], {"v": "log_prod"})))
    assert logs["far"] == pytest.approx(3 * 200 * 2.302585092994046)
    assert (logs["none"], logs["gone"]) == (float("-inf"), 0.0)
    assert logs["low"] == pytest.approx(-50 * 2.302585092994046) and logs["minus"] != logs["minus"]


def test_first_passes_over_missing_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "y", None)], "g string, v string, o int")
    assert rows(group_agg(df, ["g"], {"v": "last"}, order_by=["o"])) == [("a", "x")]
    assert rows(group_agg(df, ["g"], {"v": "first"}, order_by=["o"])) == [("a", "y")]
    with pytest.raises(ValueError, match="order_by"):
        group_agg(df, ["g"], {"v": "first"})


def test_pivot_agrees_with_pandas(gaps):
    pdf = gaps.toPandas()
    expected = pd.pivot_table(pdf, index=["g"], columns=["p"], values=["n", "d"], aggfunc={"n": "sum", "d": "mean"})
    expected.columns = ["_".join(c) for c in expected.columns]
    expected = expected.reset_index().fillna(0)
    out = pivot_table(gaps, ["g"], ["p"], {"n": "sum", "d": "mean"}).orderBy("g")
    assert out.columns == list(expected.columns)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in expected.itertuples(index=False)]


def test_single_value_column_keeps_its_name_in_front(gaps):
    out = pivot_table(gaps, ["g"], ["p"], {"t": "max"})
    assert out.columns == ["g", "t_p", "t_q"]
    assert rows(out) == [("a", "x", "y"), ("b", "z", None), ("c", None, "x")]


def test_known_pivot_values_give_the_same_cells_without_a_job(spark, gaps):
    found = pivot_table(gaps, ["g"], ["p", "t"], {"n": "count"})
    assert found.columns == ["g", "n_p_x", "n_p_z", "n_q_x", "n_q_y"]
    given = pivot_table(gaps, ["g"], ["p", "t"], {"n": "count"}, [("p", "x"), ("p", "z"), ("q", "x"), ("q", "y")])
    assert rows(given) == rows(found)
    part = pivot_table(gaps, ["g"], ["p"], {"n": "count"}, ["q", "never"])
    assert part.columns == ["g", "n_q", "n_never"]
    assert rows(part) == [("a", 0, 0), ("c", 0, 0)]


def test_typed_order_and_texts_of_pivot_values(spark):
    df = spark.createDataFrame([(1, y, 1.0) for y in (10, 9, 100)], "g int, y int, v double")
    assert pivot_table(df, ["g"], ["y"], {"v": "sum"}).columns == ["g", "v_9", "v_10", "v_100"]
    assert pivot_table(df, ["g"], ["v"], {"y": "sum"}).columns == ["g", "y_1.0"]
    days = df.select("g", F.lit("2024-01-02").cast("timestamp_ntz").alias("t"), "v")
    assert pivot_table(days, ["g"], ["t"], {"v": "sum"}).columns == ["g", "v_2024-01-02 00:00:00"]


def test_keys_that_spell_alike_stay_apart(spark):
    df = spark.createDataFrame([(1, "a_b", "c", 1), (1, "a", "b_c", 2), (1, "", "", 4)], "g int, p string, q string, v int")
    out = pivot_table(df, ["g"], ["p", "q"], {"v": "sum"})
    assert out.columns == ["g", "v", "v_a_b_c", "v_a_b_c_dup"]
    assert rows(out) == [(1, 4, 2, 1)]


def test_pivot_without_groups(gaps):
    out = pivot_table(gaps, [], ["p"], {"n": "sum", "d": "max"})
    assert out.columns == ["index", "p", "q"]
    assert rows(out) == [("d", 100.0, 2.0), ("n", 109.0, 0.0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, p string, v int")
    assert group_agg(empty, ["g"], {"v": "median"}).collect() == []
    assert pivot_table(empty, ["g"], ["p"], {"v": "sum"}).columns == ["g"]


def test_arguments_are_checked(gaps):
    for group, pivot, values in (([], [], {}), (["g"], [], {}), ([], [], {"n": "sum"})):
        with pytest.raises(ValueError):
            pivot_table(gaps, group, pivot, values)
    with pytest.raises(ValueError, match="unknown aggregate"):
        group_agg(gaps, ["g"], {"n": "mode"})
    with pytest.raises(ValueError, match="unknown columns"):
        group_agg(gaps, ["nope"], {"n": "sum"})


def test_renaming_rules():
    columns = ["g", "sales_2023", "sales_2024", "cost_2023", "units_sum"]
    assert pivot_renames(columns, {"sales": "turnover"}) == {
        "sales_2023": "turnover_2023", "sales_2024": "turnover_2024",
    }
    assert pivot_renames(columns, {"2023": "last"}) == {"sales_2023": "sales_last", "cost_2023": "cost_last"}
    assert pivot_renames(columns, {"cost_2023": "c"}) == {"cost_2023": "c"}
    assert pivot_renames(["units_sum", "g"], {"units": "pieces"}) == {"units_sum": "pieces_sum"}
    assert pivot_renames(["g"], {"other": "x"}) == {}


def test_median_of_largest_numbers(spark):
    df = spark.createDataFrame([("g", 1.7e308), ("g", 1.7e308)], "k string, v double")
    assert rows(group_medians(df, ["k"], {"v": "m"})) == [("g", 1.7e308)]


def test_medians_and_means_of_other_types(spark):
    df = spark.sql("""
        SELECT 'g' AS k, CAST(12345678901234567890123456789012345678 AS DECIMAL(38, 0)) AS d, DATE'2024-01-01' AS day
        UNION ALL SELECT 'g', 12345678901234567890123456789012345679, DATE'2024-01-02'
    """)
    out = group_agg(df, ["k"], {"d": "median", "day": "median"}).first()
    assert str(out.d) == "12345678901234567890123456789012345679"  # 38 digits leave none for the half
    assert out.day.isoformat() == "2024-01-01T12:00:00"
    assert group_agg(df, ["k"], {"day": "mean"}).first().day.isoformat() == "2024-01-01T12:00:00"


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [7.5] * 1001 + [8.0],
        [float(i) for i in range(1000)],
        [(-1) ** i * 1.5**i for i in range(80)],
        [1e9 + i / 1024 for i in range(4097)],
        [1e-12 * i for i in range(100)] + [1e300],
        [0.0, -0.0, -5.0, 5.0],
        [float("-inf"), 1.0, 2.0, float("inf")],
        [10.0**-k for k in range(5, 320)],
    ],
)
def test_exact_median(spark, values):
    data = [("g", v) for v in values] + [("h", 1.0), ("g", None), ("g", float("nan")), (None, 3.0), ("i", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    two = group_medians(df.withColumn("w", -df.v), ["k"], {"v": "m", "w": "minus"})
    expected = statistics.median(values)
    assert rows(two) == [("g", expected, -expected), ("h", 1.0, -1.0)]
    assert rows(group_medians(df, ["k"], {"v": "m"})) == [("g", statistics.median(values)), ("h", 1.0)]
