import pytest

from pyspark.sql import functions as F

from reportloom.operators.columns import (
    clean_output_name,
    column_letter,
    keep_columns,
    letter_position,
    list_columns,
    project_detail,
    resolve_columns,
    select_columns,
)

THIRTY = [f"c{i}" for i in range(30)]


def test_letters_and_positions_are_inverse():
    assert [column_letter(i) for i in (0, 25, 26, 29, 701, 702)] == ["A", "Z", "AA", "AD", "ZZ", "AAA"]
    assert all(letter_position(column_letter(i)) == i for i in range(20_000))
    assert letter_position("ad") == 29


@pytest.mark.parametrize(
    "spec, expected",
    [
        ("A", ["c0"]),
        ("[C]", ["c2"]),
        (" [ ad ] ", ["c29"]),
        ("B:D", ["c1", "c2", "c3"]),
        ("D:B", ["c1", "c2", "c3"]),
        ("[AC]:[ZZ]", ["c28", "c29"]),
        ("C5 + c1, c5", ["c5", "c1"]),
        ("'c7' + \"c8\"", ["c7", "c8"]),
        ("", []),
        (None, []),
        (["c3", "A"], ["c3", "c0"]),
    ],
)
def test_selectors(spec, expected):
    assert resolve_columns(spec, THIRTY) == expected


def test_names_or_letters_first():
    columns = ["x", "A", "y"]
    assert resolve_columns("A", columns) == ["A"]
    assert resolve_columns("A", columns, by_letter=True) == ["x"]


def test_ambiguous_case_and_unknown_tokens_fail():
    assert resolve_columns("a", ["a", "A"]) == ["a"]
    with pytest.raises(ValueError, match="unknown column 'nope'"):
        resolve_columns("nope", THIRTY)
    with pytest.raises(ValueError):
        resolve_columns("YY:ZZ", THIRTY)


def test_list_reaches_names_with_separators():
    odd = ["a+b", "c,d", "A:B", "'q'", " x "]
    assert resolve_columns(odd, odd) == odd
    assert resolve_columns(["A:B"], ["x", "y"]) == ["x", "y"]


def test_select_keep_and_list(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "`a.b` int, `c d` string, e double")
    assert select_columns(df, "C + A").columns == ["e", "a.b"]
    assert keep_columns(df, ["c d", "nope", "a.b"]).columns == ["c d", "a.b"]
    listed = [tuple(r) for r in list_columns(df).collect()]
    assert listed == [("A", "a.b", "int"), ("B", "c d", "string"), ("C", "e", "double")]


def test_detail_projection(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = project_detail(df, [("b", "B1"), {"src": "a", "dst": "n"}, ("b", "again"), ("zz", "none")])
    assert out.columns == ["B1", "n", "again", "none"]
    assert tuple(out.first()) == ("x", 1, "x", "")
    with pytest.raises(ValueError, match="twice"):
        project_detail(df, [("a", "x"), ("b", "X")])


def test_output_names():
    assert clean_output_name(" sales / 2024 ") == "sales_2024"
    assert clean_output_name("销售-表") == "销售_表"
    assert clean_output_name("***") == "TASK"
    assert clean_output_name("x" * 50) == "x" * 50


def test_names_cleaned_in_a_column_as_one_by_one(spark):
    from reportloom.operators.columns import clean_output_name, cleaned_output_names

    names = ["a b", "  x/y:z  ", "销售 2024", "___", "", "é-ü", "a__b", "_a_", "100%", "\t"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", cleaned_output_names(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == {n: clean_output_name(n) for n in names}


def test_columns_with_counts(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (None, 2.0, None)], "a int, b double, c string")
    assert [tuple(r) for r in list_columns(df, counted=True).collect()] == [
        ("A", "a", "int", 1), ("B", "b", "double", 1), ("C", "c", "string", 0),
    ]
