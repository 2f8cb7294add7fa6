"""Saved presets whose outputs have formulas, in the texts that presets hold."""

from __future__ import annotations

from reportloom.catalog.registry import query
from reportloom.plans.job import build_outputs
from reportloom.plans.spec import JobSpec

#: Result column -> formula as a preset holds it (None: a name alone) and the SQL that gives the same.
_LINE_FORMULAS = {
    "note": (None, "CAST(NULL AS VARCHAR)"),
    "state": ("'正常'", "'正常'"),
    "checked": ("1", "1"),
    "key_sum": ("df['l_orderkey'].astype(int) + df['l_partkey'].astype(int)", "l_orderkey + l_partkey"),
    "net": ("df['l_extendedprice'].astype(float) - df['l_quantity'].astype(float)", "l_extendedprice - l_quantity"),
    "product": ("df['l_discount'].astype(float) * df['l_linenumber'].astype(int)", "l_discount * l_linenumber"),
    "per_line": (
        "df['l_extendedprice'].astype(float) / (df['l_linenumber'].astype(int) - 1)",
        "CASE WHEN l_linenumber <> 1 THEN l_extendedprice / (l_linenumber - 1) END",
    ),
    "taxed": ("df['l_extendedprice'].astype(float) * 1.13", "l_extendedprice * 1.13::DOUBLE"),
    "bonus": ("(df['l_orderkey'].astype(int) + df['l_suppkey'].astype(int)) * 1.2", "(l_orderkey + l_suppkey) * 1.2::DOUBLE"),
    "rest": (
        "(df['l_partkey'] - df['l_orderkey']) % 7",
        "(l_partkey - l_orderkey) - 7 * CAST(floor((l_partkey - l_orderkey) / 7) AS BIGINT)",
    ),
    "code": ("df['l_returnflag'] + df['l_linestatus']", "l_returnflag || l_linestatus"),
    "line_id": (
        "df['l_orderkey'].astype(str) + '-' + df['l_linenumber'].astype(str)",
        "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR",
    ),
    "head": ("df['o_orderpriority'].astype(str).str[:3]", "left(o_orderpriority, 3)"),
    "tail": ("df['o_orderpriority'].astype(str).str[-4:]", "right(o_orderpriority, 4)"),
    "middle": ("df['o_orderpriority'].astype(str).str[2:5]", "substr(o_orderpriority, 3, 3)"),
    "loud": ("df['o_orderpriority'].str.upper()", "upper(o_orderpriority)"),
    "quiet": ("df['o_orderpriority'].str.lower()", "lower(o_orderpriority)"),
    "clean": ("df['o_orderpriority'].str.strip()", "trim(o_orderpriority)"),
    "short": ("df['o_orderpriority'].str.replace('URGENT', 'U, now')", "replace(o_orderpriority, 'URGENT', 'U, now')"),
    "urgent": ("df['o_orderpriority'].str.contains('URGENT')", "contains(o_orderpriority, 'URGENT')"),
    "letters": ("df['o_orderpriority'].str.len()", "length(o_orderpriority)"),
    "stock": ("np.where(df['l_quantity'] < 10, 'low', 'enough')", "CASE WHEN l_quantity < 10 THEN 'low' ELSE 'enough' END"),
    "grade": (
        "np.where(df['l_quantity'] > 40, 'A', np.where(df['l_quantity'] > 20, 'B', 'C'))",
        "CASE WHEN l_quantity > 40 THEN 'A' WHEN l_quantity > 20 THEN 'B' ELSE 'C' END",
    ),
    "returned": ("np.where(df['l_returnflag'] == 'R', 'yes', 'no')", "CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END"),
    "focus": (
        "np.where((df['l_quantity'].astype(float).fillna(0) > 20) & (df['net'] < 30000), 'yes', 'no')",
        "CASE WHEN l_quantity > 20 AND l_extendedprice - l_quantity < 30000 THEN 'yes' ELSE 'no' END",
    ),
    "refill": (
        "np.where((df['l_quantity'] < 10) | (df['l_discount'] > 0.05), 'yes', 'no')",
        "CASE WHEN l_quantity < 10 OR l_discount > 0.05::DOUBLE THEN 'yes' ELSE 'no' END",
    ),
    "maybe": ("np.where(df['l_linenumber'] > 3, df['l_returnflag'], None)", "CASE WHEN l_linenumber > 3 THEN l_returnflag END"),
    "remark": ("df['maybe'].fillna('none')", "CASE WHEN l_linenumber > 3 THEN l_returnflag ELSE 'none' END"),
    "filled": ("np.where(df['maybe'].isna(), 'empty', 'given')", "CASE WHEN l_linenumber > 3 THEN 'given' ELSE 'empty' END"),
    "other": ("np.where(df['maybe'] != 'R', 1, 0)", "CASE WHEN l_linenumber > 3 AND l_returnflag = 'R' THEN 0 ELSE 1 END"),
    "shipped": ("pd.to_datetime(df['l_shipdate'])", "l_shipdate"),
    "year": ("pd.to_datetime(df['l_shipdate']).dt.year", "year(l_shipdate)"),
    "month": ("pd.to_datetime(df['l_shipdate']).dt.month", "month(l_shipdate)"),
    "day": ("pd.to_datetime(df['l_shipdate']).dt.day", "day(l_shipdate)"),
    "period": ("df['o_orderdate'].dt.strftime('%Y-%m')", "strftime(o_orderdate, '%Y-%m')"),
    "weekday": ("pd.to_datetime(df['l_shipdate']).dt.dayofweek", "isodow(l_shipdate) - 1"),
    "age": (
        "np.where((pd.Timestamp.now() - pd.to_datetime(df['o_orderdate'])).dt.days > 100, 'old', 'new')",
        "CASE WHEN o_orderdate < now()::TIMESTAMP - INTERVAL 101 DAY THEN 'old' ELSE 'new' END",
    ),
    "gap": (
        "(pd.to_datetime(df['l_shipdate']) - pd.to_datetime(df['o_orderdate'])).dt.days.fillna(0)",
        "CAST(floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS BIGINT)",
    ),
    "quantity": ("df['l_quantity'].fillna(0)", "l_quantity"),
    "units": ("df['l_quantity'].astype(int)", "CAST(l_quantity AS BIGINT)"),
    "key_text": ("df['l_orderkey'].astype(str)", "l_orderkey::VARCHAR"),
    "rounded": ("round(df['l_extendedprice'], 0)", "round_even(l_extendedprice, 0)"),
    "boxes": ("np.ceil(df['l_quantity'] / 7)", "CAST(ceil(l_quantity / 7) AS BIGINT)"),
    "full_boxes": ("np.floor(df['l_quantity'] / 7)", "CAST(floor(l_quantity / 7) AS BIGINT)"),
    "place": ("df['maybe'].fillna(df['l_linestatus'])", "CASE WHEN l_linenumber > 3 THEN l_returnflag ELSE l_linestatus END"),
    "masked": (
        "df['o_orderpriority'].astype(str).str[:3] + '****' + df['o_orderpriority'].astype(str).str[-4:]",
        "left(o_orderpriority, 3) || '****' || right(o_orderpriority, 4)",
    ),
    "digit": ("df['l_orderkey'].astype(str).str[-1].astype(int)", "l_orderkey % 10"),
    "parity": ("np.where(df['digit'] % 2 == 1, 'odd', 'even')", "CASE WHEN l_orderkey % 2 = 1 THEN 'odd' ELSE 'even' END"),
    "part": ("df['o_orderpriority'].astype(str).str[6:10]", "substr(o_orderpriority, 7, 4)"),
}


def _selected(formulas: dict, keys: str, rows: str) -> str:
    made = ", ".join(f'{sql} AS "{name}"' for name, (_, sql) in formulas.items())
    return f"SELECT {keys}, {made} FROM {rows}"


def _text(formulas: dict) -> str:
    """The formulas as one text, their items parted in all the ways that presets know."""
    items = [name if formula is None else f"{name} = {formula}" for name, (formula, _) in formulas.items()]
    signs = ["\n", ", ", ";\n", "，", "；"]
    return "".join(item + signs[k % len(signs)] for k, item in enumerate(items))


def _columns(*names: str) -> list[dict]:
    return [{"src": name, "dst": name} for name in names]


@query(_selected(_LINE_FORMULAS, "l_orderkey, l_linenumber", "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"))
def preset_formulas(spark, sf_dir):
    """A preset with a lookup and all kinds of formulas over the lines of orders."""
    rule = {"target_path": f"{sf_dir}/orders.parquet", "master_keys": "l_orderkey", "target_keys": "o_orderkey", "pick_cols": "o_orderdate, o_orderpriority"}
    task = {"name": "lines", "calc_fields": _text(_LINE_FORMULAS), "col_map": _columns("l_orderkey", "l_linenumber", *_LINE_FORMULAS)}
    return build_outputs(spark, JobSpec.from_preset({"master": f"{sf_dir}/lineitem.parquet", "rules": [rule], "tasks": [task]}))["lines"]


_DOCUMENT_FORMULAS = {
    "summary": ("df['text'].astype(str).str[:10]", "left(text, 10)"),
    "ending": ("df['text'].str[-12:-2]", "substr(text, greatest(length(text) - 11, 1), greatest(length(text) - 2, 0) - greatest(length(text) - 12, 0))"),
    "words": ("df['text'].str.replace(' ', '  ').str.len() - df['text'].str.len()", "length(replace(text, ' ', '  ')) - length(text)"),
    "has_mail": ("df['text'].str.contains('[a-z]@[a-z]', na=False)", "regexp_matches(text, '[a-z]@[a-z]')"),
    "tag": ("df['lang'].str.upper() + '/' + df['source']", "upper(lang) || '/' || source"),
    "size": ("np.where(df['n_chars'] >= 1000, '长', '短')", "CASE WHEN n_chars >= 1000 THEN '长' ELSE '短' END"),
    "same": ("np.where(df['text'].str.len() == df['n_chars'], 1, 0)", "CASE WHEN length(text) = n_chars THEN 1 ELSE 0 END"),
}


@query(_selected(_DOCUMENT_FORMULAS, "doc_id", "documents") + " WHERE n_chars > 50")
def preset_formulas_text(spark, sf_dir):
    """A preset whose formulas look at whole texts; its filter sees what they make."""
    formulas = _DOCUMENT_FORMULAS | {"twice": ("df['n_chars'] * 2", "")}
    task = {"name": "texts", "calc_fields": _text(formulas), "filter_expr": "`twice`>100", "col_map": _columns("doc_id", *_DOCUMENT_FORMULAS)}
    preset = {"master": f"{sf_dir}/documents.parquet", "tasks": [task]}
    # The texts are texts: without a look at each whether it is a number.
    spec = JobSpec.from_preset(preset)
    spec.infer = False
    return build_outputs(spark, spec)["texts"]
