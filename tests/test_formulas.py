from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reportloom.functions import formulas as X
from reportloom.operators.columns import ref
from reportloom.operators.derive import derive


def values(spark, schema, data, formula):
    df = derive(spark.createDataFrame(data, schema).coalesce(1), [("r", formula)])
    return [row.r for row in df.collect()]


def test_catalogue_is_complete():
    assert sorted(X.CATALOGUE) == list(range(1, 51))


def test_arithmetic(spark):
    pairs = [("7", "2"), ("x", "1"), (None, "1"), ("5", "0")]
    schema = "a string, b string"
    assert values(spark, schema, pairs, X.add_ints("a", "b")) == [9, None, None, 5]
    assert values(spark, schema, pairs, X.subtract("a", "b")) == [5.0, None, None, 5.0]
    assert values(spark, schema, pairs, X.multiply("a", "b")) == [14.0, None, None, 0.0]
    assert values(spark, schema, pairs, X.divide("a", "b")) == [3.5, None, None, None]
    assert values(spark, schema, pairs, X.scale("a", 0.5)) == [3.5, None, None, 2.5]
    assert values(spark, schema, pairs, X.add_then_scale("a", "b", 2)) == [18, None, None, 10]


def test_remainder_has_the_divisor_sign(spark):
    data = [(a, b) for a in (7, -7, 1, -1, 0) for b in (2, -2, 3)]
    assert values(spark, "a int, b int", data, X.remainder("a", ref("b"))) == [a % b for a, b in data]
    assert values(spark, "a int, b int", [(1, 0)], X.remainder("a", ref("b"))) == [None]


def test_text(spark):
    data = [("  \t　añb　 ", 12), (None, 3), ("", None)]
    schema = "s string, n int"
    assert values(spark, schema, data, X.strip("s")) == ["añb", None, ""]
    assert values(spark, schema, data, X.join_text("s", ref("s"))) == ["  \t　añb　   \t　añb　 ", None, ""]
    assert values(spark, schema, data, X.join_with("-", "n", "n")) == ["12-12", "3-3", None]
    assert values(spark, schema, data, X.text_length("s")) == [9, None, 0]
    text = [("abcdef",), ("ab",), (None,)]
    assert values(spark, "s string", text, X.head_text("s", 3)) == ["abc", "ab", None]
    assert values(spark, "s string", text, X.tail_text("s", 4)) == ["cdef", "ab", None]
    assert values(spark, "s string", text, X.slice_text("s", 2, 5)) == ["cde", "", None]
    assert values(spark, "s string", text, X.upper("s")) == ["ABCDEF", "AB", None]
    assert values(spark, "s string", [("aBc",)], X.lower("s")) == ["abc"]
    assert values(spark, "s string", [("a.b.c",)], X.replace_text("s", ".", "")) == ["abc"]
    assert values(spark, "s string", text, X.has_text("s", "c")) == [True, False, None]
    assert values(spark, "s string", [("13812345678",), ("12",)], X.mask_middle("s")) == ["138****5678", "12****12"]


def test_conditions_and_defaults(spark):
    data = [(5.0, "x"), (50.0, None), (None, "y")]
    schema = "n double, s string"
    assert values(spark, schema, data, X.choose(ref("n") < 10, "low", "ok")) == ["low", "ok", "ok"]
    nested = X.choose_first([(ref("n") > 40, "A"), (ref("n") > 1, "B")], "C")
    assert values(spark, schema, data, nested) == ["B", "A", "C"]
    assert values(spark, schema, data, X.number_or("n") > 1) == [True, True, False]
    assert values(spark, schema, data, X.number_or("s", 7)) == [7.0, 7.0, 7.0]
    assert values(spark, schema, data, X.default_for("s", "none")) == ["x", "none", "y"]
    assert values(spark, schema, data, X.label_missing("s", "open", "done")) == ["done", "open", "done"]
    assert values(spark, schema, data, X.first_given("s", F.lit("z"))) == ["x", "z", "y"]


def test_dates(spark):
    data = [("2024-01-05",), ("2024/2/9 13:00:00",), ("soon",), (None,)]
    assert values(spark, "t string", data, X.to_date("t")) == [
        datetime(2024, 1, 5), datetime(2024, 2, 9, 13), None, None,
    ]
    assert values(spark, "t string", data, X.year("t")) == [2024, 2024, None, None]
    assert values(spark, "t string", data, X.month("t")) == [1, 2, None, None]
    assert values(spark, "t string", data, X.day("t")) == [5, 9, None, None]
    assert values(spark, "t string", data, X.year_month("t")) == ["2024-01", "2024-02", None, None]
    assert values(spark, "t string", [("2024-01-01",), ("2024-01-07",)], X.weekday("t")) == [0, 6]


def test_day_differences_are_floored_periods(spark):
    data = [("2024-01-03 12:00:00", "2024-01-01 13:00:00"), ("2024-01-01", "2024-01-01 00:00:01"), (None, "2024-01-01")]
    assert values(spark, "e string, s string", data, X.days_between("e", "s")) == [1, -1, 0]
    assert values(spark, "s string", [("2024-01-01",), (None,)], X.days_since("s", "2024-01-31 23:00:00")) == [30, None]
    today = values(spark, "s string", [("2000-01-01",)], X.days_since("s"))[0]
    assert today == (datetime.now() - datetime(2000, 1, 1)).days


def test_conversion_and_rounding(spark):
    assert values(spark, "s string", [("12",), ("x",), (None,)], X.to_int("s")) == [12, None, None]
    assert values(spark, "d double", [(12.9,), (-1.5,)], X.to_int("d")) == [12, -1]
    assert values(spark, "s string", [("1.5",), ("x",), ("1d",)], X.to_float("s")) == [1.5, None, None]
    assert values(spark, "n int", [(5,), (None,)], X.to_text("n")) == ["5", None]
    assert values(spark, "d double", [(0.125,), (2.5,)], X.round_half_even("d", 2)) == [0.12, 2.5]
    assert values(spark, "d double", [(7.0,), (None,)], X.ceil_quotient("d", 2)) == [4, None]
    assert values(spark, "d double", [(7.0,), (None,)], X.floor_quotient("d", 2)) == [3, None]
    assert values(spark, "d double", [(7.0,)], X.ceil_quotient("d", 0)) == [None]


def test_id_digits(spark):
    df = spark.createDataFrame([("110101199003071234",), ("110101198512052345",)], "id string").coalesce(1)
    out = derive(df, [("code", X.digit_from_end("id", 2)), ("sex", X.parity("code", "M", "F")), ("born", X.slice_text("id", 6, 10))])
    assert [(r.code, r.sex, r.born) for r in out.collect()] == [(3, "M", "1990"), (4, "F", "1985")]


def test_items_run_in_order_and_overwrite(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `b c` int")
    out = derive(df, [("s", "a + `b c`"), ("a", ref("s") * 10), "note", ("w", "row_number() over (order by a)")])
    assert out.columns == ["a", "b c", "s", "note", "w"]
    assert tuple(out.first()) == (30, 2, 3, None, 1)
    assert dict(out.dtypes)["note"] == "string"


def test_bad_formula_fails_while_planning(spark):
    with pytest.raises(Exception, match="nope"):
        derive(spark.range(1), [("x", "nope + 1")])


def test_strip_and_contains_at_odd_ends(spark):
    texts = [("a b",), (" a",), ("a\n",), ("\u3000é",), ("é\u2028",), ("\u00a0!",), ("",), (None,)]
    assert values(spark, "s string", texts, X.strip("s")) == ["a b", "a", "a", "é", "é", "!", "", None]
    texts = [("x-1 a",), ("X-1 A",), ("",), (None,)]
    assert values(spark, "s string", texts, X.has_text("s", "-1 a")) == [True, False, False, None]
    assert values(spark, "s string", texts, X.has_text("s", "^x")) == [True, False, False, None]


def test_elapsed_days_round_down(spark):
    day = datetime(2024, 3, 1, 12)
    pairs = [(day, day), (day, datetime(2024, 3, 1, 11)), (day, datetime(2024, 2, 29, 12)), (datetime(2024, 2, 29, 12, 0, 1), day), (datetime(2024, 2, 29, 12), day), (None, day)]
    assert values(spark, "e timestamp_ntz, s timestamp_ntz", pairs, X.days_apart("e", "s")) == [0, 0, 1, -1, -1, None]
