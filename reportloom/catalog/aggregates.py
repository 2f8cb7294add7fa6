"""Grouped aggregates and pivot tables.

Money is summed as decimals, so that the order of additions cannot show.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.lookups import lookup_unmatched, region_rules
from reportloom.catalog.registry import query, table
from reportloom.functions import formulas as X
from reportloom.operators import predicates as P
from reportloom.operators.columns import ref
from reportloom.operators.derive import derive
from reportloom.operators.lookup import link_tables
from reportloom.operators.ordering import sort_rows
from reportloom.operators.pivot import group_agg, pivot_table, rename_pivot


def _money_as_double(df):
    return df.select(
        [
            ref(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else ref(f.name)
            for f in df.schema.fields
        ]
    )


def _rounded(df, names):
    return df.select([F.round(ref(c), 6).alias(c) if c in names else ref(c) for c in df.columns])


@query("""
    SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity, count(l_tax) AS l_tax,
           max(l_shipdate) AS l_shipdate, min(l_discount) AS l_discount,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def group_agg_basic(spark, sf_dir):
    lines = derive(
        table(spark, sf_dir, "lineitem"), [("price", ref("l_extendedprice").cast("decimal(18,2)"))]
    )
    values = {"l_quantity": "mean", "l_tax": "count", "l_shipdate": "max", "l_discount": "min", "price": "sum"}
    return _money_as_double(group_agg(lines, ["l_returnflag", "l_linestatus"], values))


@query("""
    SELECT l_returnflag, median(l_quantity) AS l_quantity, count(DISTINCT l_partkey) AS l_partkey,
           median(l_extendedprice) AS l_extendedprice
    FROM lineitem GROUP BY l_returnflag
""")
def group_agg_median_nunique(spark, sf_dir):
    values = {"l_quantity": "median", "l_partkey": "nunique", "l_extendedprice": "median"}
    return group_agg(table(spark, sf_dir, "lineitem"), ["l_returnflag"], values)


@query("""
    SELECT o_custkey, median(o_totalprice) AS o_totalprice, count(DISTINCT o_orderstatus) AS o_orderstatus,
           max(o_orderpriority) AS o_orderpriority
    FROM orders GROUP BY o_custkey
""")
def group_agg_many_groups(spark, sf_dir):
    values = {"o_totalprice": "median", "o_orderstatus": "nunique", "o_orderpriority": "max"}
    return group_agg(table(spark, sf_dir, "orders"), ["o_custkey"], values)


@query("""
    SELECT event_type, round(coalesce(stddev_samp(value), 0), 6) AS value,
           round(coalesce(var_samp(user_id), 0), 6) AS user_id,
           round(coalesce(stddev_samp(event_id) / sqrt(count(event_id)), 0), 6) AS event_id
    FROM events GROUP BY event_type
""")
def group_agg_std_var_sem(spark, sf_dir):
    values = {"value": "std", "user_id": "var", "event_id": "sem"}
    result = group_agg(table(spark, sf_dir, "events"), ["event_type"], values)
    return _rounded(result, ["value", "user_id", "event_id"])


@query("""
    SELECT p_brand, round(coalesce(skewness(p_size), 0), 6) AS p_size, round(sum(ln(growth)), 6) AS growth,
           count(*) AS p_type
    FROM (SELECT *, 1 + p_size / 1000 AS growth FROM part) GROUP BY p_brand
""")
def group_agg_skew_prod_size(spark, sf_dir):
    part = derive(table(spark, sf_dir, "part"), [("growth", "1 + p_size / 1000")])
    # The product by its logarithm: its last digits depend on its order, and of many parts it is beyond the doubles.
    values = {"p_size": "skew", "growth": "log_prod", "p_type": "size"}
    return _rounded(group_agg(part, ["p_brand"], values), ["p_size", "growth"])


@query("""
    SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
           arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
    FROM orders GROUP BY o_custkey
""")
def group_agg_first_last(spark, sf_dir):
    values = {"o_orderstatus": "first", "o_totalprice": "last"}
    return group_agg(table(spark, sf_dir, "orders"), ["o_custkey"], values, order_by=["o_orderdate", "o_orderkey"])


@query("""
    SELECT l.quality, max(d.lang) AS lang, CAST(sum(d.n_chars) AS BIGINT) AS n_chars
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL GROUP BY l.quality
""")
def group_null_keys(spark, sf_dir):
    """Rows whose group key is missing are out."""
    return group_agg(lookup_unmatched(spark, sf_dir), ["quality"], {"lang": "max", "n_chars": "sum"})


@query("""
    SELECT d.source, d.n_chars, avg(l.quality) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    GROUP BY d.source, d.n_chars HAVING avg(l.quality) IS NOT NULL
""")
def group_all_null_dropped(spark, sf_dir):
    """Groups with nothing to average disappear."""
    return group_agg(lookup_unmatched(spark, sf_dir), ["source", "n_chars"], {"quality": "mean"})


@query("""
    SELECT d.source, d.n_chars, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    GROUP BY d.source, d.n_chars
""")
def group_all_null_sum(spark, sf_dir):
    """With a sum they stay, as 0."""
    return group_agg(lookup_unmatched(spark, sf_dir), ["source", "n_chars"], {"quality": "sum"})


# The years that the given tables hold; the query itself finds them.
_YEARS = range(1995, 2002)


def _region_year_sql(cells: str) -> str:
    return f"""
        SELECT r_name, {cells}
        FROM (SELECT r.r_name, year(o.o_orderdate) AS y,
                     CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4)) AS revenue
              FROM lineitem l
              LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
              LEFT JOIN customer c ON o.o_custkey = c.c_custkey
              LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
              LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
              WHERE l.l_returnflag IS DISTINCT FROM 'R')
        WHERE r_name IS NOT NULL
        GROUP BY r_name"""


@query(
    _region_year_sql(
        ", ".join(
            f'CAST(coalesce(sum(revenue) FILTER (WHERE y = {y}), 0) AS DOUBLE) AS "revenue_{y}"' for y in _YEARS
        )
    )
)
def revenue_by_region_and_year(spark, sf_dir):
    """Line items linked to their region, returns left out, revenue pivoted by year."""
    rules = region_rules(spark, sf_dir)
    rules[0] = rules[0] | {"pick": ["o_custkey", "o_orderdate"]}
    pool = link_tables(table(spark, sf_dir, "lineitem"), rules)
    revenue = (ref("l_extendedprice") * (1 - ref("l_discount"))).cast("decimal(18,4)")
    pool = derive(pool, [("revenue", revenue), ("y", X.year("o_orderdate"))])
    pool = P.filter_rows(pool, P.ne("l_returnflag", "R"))
    result = pivot_table(pool, ["r_name"], ["y"], {"revenue": "sum"})
    return sort_rows(_money_as_double(result), [("r_name", True)])



@query("""
    SELECT o_orderpriority,
           count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "o_orderkey_F",
           count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "o_orderkey_O",
           count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "o_orderkey_P"
    FROM orders GROUP BY o_orderpriority
""")
def pivot_single(spark, sf_dir):
    """Pivot values found in the data."""
    return pivot_table(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus"], {"o_orderkey": "count"})


@query("""
    SELECT l_returnflag,
           coalesce(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS "l_quantity_F",
           coalesce(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS "l_quantity_O",
           max(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS "l_shipdate_F",
           max(l_shipdate) FILTER (WHERE l_linestatus = 'O') AS "l_shipdate_O",
           count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'F') AS "l_suppkey_F",
           count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS "l_suppkey_O"
    FROM lineitem GROUP BY l_returnflag
""")
def pivot_multi_value(spark, sf_dir):
    values = {"l_suppkey": "nunique", "l_quantity": "mean", "l_shipdate": "max"}
    return pivot_table(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], values)


@query(
    "SELECT l_linenumber, "
    + ", ".join(
        f"coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = '{r}' AND l_linestatus = '{s}'), 0)"
        f' AS "l_quantity_{r}_{s}"'
        for r in "ANR"
        for s in "FO"
    )
    + " FROM lineitem GROUP BY l_linenumber"
)
def pivot_two_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return pivot_table(lines, ["l_linenumber"], ["l_returnflag", "l_linestatus"], {"l_quantity": "sum"})


@query("""
    SELECT d.lang,
           CAST(coalesce(sum(d.n_chars) FILTER (WHERE l.quality = 0 AND l.toxic = 0), 0) AS BIGINT) AS "n_chars_0_0",
           CAST(coalesce(sum(d.n_chars) FILTER (WHERE l.quality = 0 AND l.toxic = 1), 0) AS BIGINT) AS "n_chars_0_1",
           CAST(coalesce(sum(d.n_chars) FILTER (WHERE l.quality = 1 AND l.toxic = 0), 0) AS BIGINT) AS "n_chars_1_0",
           CAST(coalesce(sum(d.n_chars) FILTER (WHERE l.quality = 1 AND l.toxic = 1), 0) AS BIGINT) AS "n_chars_1_1",
           CAST(0 AS BIGINT) AS "n_chars_2_2",
           max(d.source) FILTER (WHERE l.quality = 0 AND l.toxic = 0) AS "source_0_0",
           max(d.source) FILTER (WHERE l.quality = 0 AND l.toxic = 1) AS "source_0_1",
           max(d.source) FILTER (WHERE l.quality = 1 AND l.toxic = 0) AS "source_1_0",
           max(d.source) FILTER (WHERE l.quality = 1 AND l.toxic = 1) AS "source_1_1",
           CAST(NULL AS VARCHAR) AS "source_2_2"
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    GROUP BY d.lang
""")
def pivot_zero_fill(spark, sf_dir):
    """All combinations and one that never occurs; numbers without a cell are 0, text stays empty."""
    return pivot_table(
        lookup_unmatched(spark, sf_dir), ["lang"], ["quality", "toxic"], {"n_chars": "sum", "source": "max"},
        pivot_values=[(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)],
    )


_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _event_types_sql(cell: str) -> str:
    return ", ".join(f"{cell} FILTER (WHERE event_type = '{t}') AS DOUBLE) AS \"{t}\"" for t in _EVENT_TYPES)


@query(f"""
    SELECT 'event_id' AS "index", {_event_types_sql("CAST(count(event_id)")} FROM events
    UNION ALL SELECT 'user_id', {_event_types_sql("CAST(max(user_id)")} FROM events
    UNION ALL SELECT 'value', {_event_types_sql("CAST(avg(CAST(value * 100 AS BIGINT))")} FROM events
""")
def pivot_no_group(spark, sf_dir):
    """Without group keys there is one row per value column."""
    events = derive(table(spark, sf_dir, "events"), [("value", F.round(ref("value") * 100).cast("bigint"))])
    values = {"event_id": "count", "user_id": "max", "value": "mean"}
    return pivot_table(events, [], ["event_type"], values)


@query("""
    SELECT l_returnflag,
           sum(l_quantity) FILTER (WHERE l_linenumber <= 3) AS "units_early",
           sum(l_quantity) FILTER (WHERE l_linenumber > 3) AS "units_late",
           count(l_tax) FILTER (WHERE l_linenumber <= 3) AS "taxes_early",
           count(l_tax) FILTER (WHERE l_linenumber > 3) AS "taxes_late"
    FROM lineitem GROUP BY l_returnflag
""")
def pivot_rename(spark, sf_dir):
    """Renaming a value column or a pivot value reaches all columns made of it."""
    place = X.choose(ref("l_linenumber") <= 3, "first", "last")
    lines = derive(table(spark, sf_dir, "lineitem"), [("place", place)])
    result = pivot_table(
        lines, ["l_returnflag"], ["place"], {"l_quantity": "sum", "l_tax": "count"},
        renames={"l_quantity": "units", "l_tax": "taxes"},
    )
    return rename_pivot(result, {"first": "early", "last": "late"})


@query("""
    SELECT l_linestatus,
           median(l_quantity) FILTER (WHERE l_returnflag = 'A') AS "l_quantity_A",
           median(l_quantity) FILTER (WHERE l_returnflag = 'N') AS "l_quantity_N",
           median(l_quantity) FILTER (WHERE l_returnflag = 'R') AS "l_quantity_R"
    FROM lineitem GROUP BY l_linestatus
""")
def pivot_median(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return pivot_table(lines, ["l_linestatus"], ["l_returnflag"], {"l_quantity": "median"}, ["A", "N", "R"])
