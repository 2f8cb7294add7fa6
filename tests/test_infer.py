from datetime import datetime
from decimal import Decimal

import pytest

from reportloom.operators.infer import infer_schema, infer_types


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


@pytest.mark.parametrize(
    "values, expected_type, expected",
    [
        (["007", " 12 ", None], "bigint", [7, 12, None]),
        (["", "5"], "bigint", [None, 5]),
        (["1e3", "2"], "double", [1000.0, 2.0]),
        (["1.5", ".5", "-2."], "double", [1.5, 0.5, -2.0]),
        (["123456789012345678", None], "bigint", [123456789012345678, None]),
        (["12345678901234567890", "1"], "decimal(38,0)", [Decimal("12345678901234567890"), Decimal(1)]),
        (["9" * 40, "1"], "double", [1e40, 1.0]),
        ([None, None], "double", [None, None]),
        (["2024-01-02", "2024/01/03", "x", None], "timestamp_ntz",
         [datetime(2024, 1, 2), datetime(2024, 1, 3), None, None]),
        (["2024-1-5", "2024-01-02 03:04:05"], "timestamp_ntz",
         [datetime(2024, 1, 5), datetime(2024, 1, 2, 3, 4, 5)]),
    ],
)
def test_inferred(spark, values, expected_type, expected):
    out = infer_types(column(spark, values).coalesce(1))
    assert out.dtypes == [("c", expected_type)]
    assert [r.c for r in out.collect()] == expected


@pytest.mark.parametrize(
    "values",
    [["1,000", "1"], ["0x10"], ["True"], [" ", "1"], ["inf", "1"], ["1d", "2"], ["nan"],
     ["2024-01-02", "x", "y"]],
)
def test_left_as_text(spark, values):
    assert infer_schema(column(spark, values)) == {}


def test_known_types_and_kept_text(spark):
    df = spark.createDataFrame([("1", "2", 3, datetime(2024, 1, 1))], "a string, b string, c int, d timestamp_ntz")
    assert infer_types(df, keep_text=["a"]).dtypes == [
        ("a", "string"), ("b", "bigint"), ("c", "int"), ("d", "timestamp_ntz"),
    ]
    assert infer_types(df, types={"a": "double"}).dtypes[:2] == [("a", "double"), ("b", "string")]


def test_texts_told_by_their_ends(spark):
    for values in (["URGENT", "5"], ["5-LOW", "1"], ["1x", "2"], ["#1", "1"], ["1#", "1"], ["é", "1"], ["1é", "1"], ["2024-01-02x", "x", "y"]):
        assert infer_schema(column(spark, values)) == {}
    assert infer_schema(column(spark, ["2024-01-02 at noon", "x"])) == {"c": "timestamp_ntz"}
