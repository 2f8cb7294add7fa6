"""Formulas of presets: how their text is cut and read, what they give, and what is refused."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reportloom.plans.preset_formulas import formula_form, preset_column, preset_fields, split_formulas


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (1, 10.0, "Anna", "007", "2024-01-05", datetime(2024, 3, 1, 12), True, 5),
        (2, float("nan"), None, "x", "2024/02/29", None, None, -5),
        (3, 2.5, " bo ", None, "none", datetime(2023, 12, 31), False, None),
    ]
    schema = "id long, price double, name string, code string, day string, at timestamp_ntz, flag boolean, `odd name` int"
    return spark.createDataFrame(rows, schema).coalesce(1)


def values(df, text):
    return [r[0] for r in df.orderBy("id").select(preset_column(df, text, F.lit(datetime(2024, 3, 2))).alias("v")).collect()]


def test_items_are_cut_as_presets_part_them():
    text = "备注，原因； 状态 = '正,常'\na = np.where(df['x'] > 1, 'p;q', \"r\")\n; b = (1 +\n2),, df['c'], df['d'] = 1"
    assert split_formulas(text) == ["备注", "原因", "状态 = '正,常'", "a = np.where(df['x'] > 1, 'p;q', \"r\")", "b = (1 + 2)", "df['c']", "df['d'] = 1"]
    assert preset_fields("x, df['y'], z = 1, df[\"w\"] = 2, df.v = 3") == ["x", ["y", {"preset": "''"}], ["z", {"preset": "1"}], ["w", {"preset": "2"}], ["v", {"preset": "3"}]]
    assert preset_fields("状态 = ‘好’") == [["状态", {"preset": "'好'"}]]
    assert preset_fields("") == preset_fields(" \n, ;") == []


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("df['id'] + 1", [2, 3, 4]),
        ("df['id'] / 2", [0.5, 1.0, 1.5]),
        ("df['id'] / (df['id'] - 2)", [-1.0, None, 3.0]),
        ("df['odd name'] % 3", [2, 1, None]),
        ("-df['odd name']", [-5, 5, None]),
        ("df['price'].fillna(0) * 2", [20.0, 0.0, 5.0]),
        ("df['code'].astype(int)", [7, None, None]),
        ("df['code'].astype(int).fillna(df['id'])", [7, 2, 3]),
        ("df['price'].astype(str)", ["10.0", None, "2.5"]),
        ("df['id'].astype('float')", [1.0, 2.0, 3.0]),
        ("df['name'] + '-' + df['id'].astype(str)", ["Anna-1", None, " bo -3"]),
        ("df['name'].str[1:3]", ["nn", None, "bo"]),
        ("df['name'].str[:-1]", ["Ann", None, " bo"]),
        ("df['name'].str[-3:]", ["nna", None, "bo "]),
        ("df['name'].str[-9:2]", ["An", None, " b"]),
        ("df['code'].str[-2]", ["0", None, None]),
        ("df['code'].str[1]", ["0", None, None]),
        ("df['name'].str.strip().str.len()", [4, None, 2]),
        ("df['name'].str.contains('n')", [True, None, False]),
        ("df['name'].str.contains('n', na=False)", [True, False, False]),
        ("np.where(~df['name'].isna() & (df['id'] < 3), 'a', 'b')", ["a", "b", "b"]),
        ("np.where(df['name'] != 'Anna', 1, 0)", [0, 1, 1]),
        ("np.where(df['price'] > 3, 1, 2.5)", [1.0, 2.5, 2.5]),
        ("np.where(df['flag'], df['id'], 'none')", ["1", "none", "none"]),
        ("np.where(df['code'] == 7, 'yes', 'no')", ["no", "no", "no"]),
        ("np.where(df['at'] >= '2024-01-01', 'new', 'old')", ["new", "old", "old"]),
        ("pd.to_datetime(df['day']).dt.month", [1, 2, None]),
        ("df['at'].dt.strftime('%Y/%m at %H')", ["2024/03 at 12", None, "2023/12 at 00"]),
        ("(pd.Timestamp.now() - df['at']).dt.days", [0, None, 62]),
        ("(pd.to_datetime(df['day']) - df['at']).dt.days.fillna(-99)", [-57, -99, -99]),
        ("round(df['price'], 0)", [10.0, None, 2.0]),
        ("np.ceil(df['price'] / 4)", [3, None, 1]),
        ("None", [None, None, None]),
    ],
)
def test_values(df, text, wanted):
    assert values(df, text) == wanted


@pytest.mark.parametrize(
    "text",
    [
        "__import__('os').system('x')", "open('x')", "df", "df.id", "x + 1", "df['id'].apply(len)", "df['a'][0]", "[1, 2]", "lambda: 1",
        "df['id'] ** 2", "1 < 2 < 3", "df['id'] and 1", "df['s'].str.contains(x)", "df['s'].str.replace('a', 'b', regex=True)",
        "df[x]", "np.log(df['id'])", "df['id'].astype(bool)", "f'{1}'", "df['s'].str[::2]", "1 +", "df['s'].str['a']",
    ],
)
def test_other_texts_are_refused(text):
    with pytest.raises(ValueError, match="formula"):
        formula_form(text)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("df['name'] + df['id']", "'id'"), ("df['name'] * 2", "'name'"), ("df['id'].str[:2]", "'id'"), ("df['name'] > 3", "ordered"),
        ("df['day'].dt.year", "'day'"), ("df['at'].astype(int)", "'at'"), ("df['none'] + 1", "unknown column"),
        ("df['at'] - df['at']", "span"), ("df['id'] & df['flag']", "'id'"), ("df['at'].dt.strftime('%j')", "%j"),
    ],
)
def test_kinds_that_do_not_go_together(df, text, said):
    with pytest.raises((TypeError, ValueError), match=said):
        preset_column(df, text)


@pytest.mark.parametrize("text", ["x == 1", "= 3", "df['a' = 1", "a = ", "df[0] = 1"])
def test_items_without_a_name(text):
    with pytest.raises(ValueError):
        preset_fields(text)


def test_rounded_to_whole_numbers(spark):
    data = [(v,) for v in (0.5, 1.5, -2.5, -0.3, -0.0, 0.49999999999999994, 1e22, float("inf"), None)]
    df = spark.createDataFrame(data, "v double").coalesce(1)
    found = [r.r for r in df.select(preset_column(df, "round(df['v'], 0)").cast("string").alias("r")).collect()]
    assert found == ["0.0", "2.0", "-2.0", "0.0", "0.0", "0.0", "1.0E22", "Infinity", None]
