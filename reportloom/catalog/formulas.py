"""Derived columns: the formula catalogue over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.lookups import lookup_unmatched
from reportloom.catalog.registry import query, table
from reportloom.functions import formulas as X
from reportloom.operators.columns import ref
from reportloom.operators.derive import derive


@query("""
    SELECT l_orderkey, l_linenumber,
           l_orderkey + l_partkey AS key_sum,
           l_extendedprice - l_quantity AS net,
           l_discount * l_linenumber AS product,
           l_extendedprice / l_linenumber AS per_line,
           l_extendedprice / nullif(l_linenumber - 1, 0) AS per_other_line,
           l_extendedprice * 1.13::DOUBLE AS taxed,
           (l_orderkey + l_suppkey) * 1.2::DOUBLE AS bonus
    FROM lineitem
""")
def formula_math(spark, sf_dir):
    items = [
        ("key_sum", X.add_ints("l_orderkey", "l_partkey")),
        ("net", X.subtract("l_extendedprice", "l_quantity")),
        ("product", X.multiply("l_discount", "l_linenumber")),
        ("per_line", X.divide("l_extendedprice", "l_linenumber")),
        ("per_other_line", X.divide("l_extendedprice", ref("l_linenumber") - 1)),
        ("taxed", X.scale("l_extendedprice", 1.13)),
        ("bonus", X.add_then_scale("l_orderkey", "l_suppkey", 1.2)),
    ]
    lines = derive(table(spark, sf_dir, "lineitem"), items)
    return lines.select("l_orderkey", "l_linenumber", *[name for name, _ in items])


@query("""
    SELECT o_orderkey,
           o_orderkey % 2 AS odd,
           (o_orderkey - o_custkey) - 7 * CAST(floor((o_orderkey - o_custkey) / 7) AS BIGINT) AS signed_seven,
           o_custkey - (-3) * CAST(floor(o_custkey / -3) AS BIGINT) AS minus_three
    FROM orders
""")
def formula_mod(spark, sf_dir):
    items = [
        ("odd", X.remainder("o_orderkey", 2)),
        ("signed_seven", X.remainder(ref("o_orderkey") - ref("o_custkey"), 7)),
        ("minus_three", X.remainder("o_custkey", -3)),
    ]
    orders = derive(table(spark, sf_dir, "orders"), items)
    return orders.select("o_orderkey", *[name for name, _ in items])


@query("""
    SELECT p_partkey,
           p_brand || p_type AS code,
           CAST(p_partkey AS VARCHAR) || '-' || CAST(p_size AS VARCHAR) AS unique_code,
           upper(p_name) AS loud, lower(p_type) AS quiet,
           trim(p_name) AS stripped,
           replace(p_name, 'red', 'RD') AS city_code,
           regexp_matches(p_name, 'ring') AS is_ring,
           CAST(length(p_name) AS INTEGER) AS letters
    FROM part
""")
def formula_text(spark, sf_dir):
    items = [
        ("code", X.join_text("p_brand", "p_type")),
        ("unique_code", X.join_with("-", "p_partkey", "p_size")),
        ("loud", X.upper("p_name")),
        ("quiet", X.lower("p_type")),
        ("stripped", X.strip(F.concat(F.lit(" \t　"), ref("p_name"), F.lit(" 　")))),
        ("city_code", X.replace_text("p_name", "red", "RD")),
        ("is_ring", X.has_text("p_name", "ring")),
        ("letters", X.text_length("p_name")),
    ]
    return derive(table(spark, sf_dir, "part"), items).select("p_partkey", *[name for name, _ in items])


@query("""
    SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, left(text, 10) AS summary, right(text, 4) AS tail,
           replace(text, 'the', 'THE') AS marked, regexp_matches(text, 'the') AS has_the
    FROM documents
""")
def formula_long_text(spark, sf_dir):
    items = [
        ("chars", X.text_length("text")),
        ("summary", X.head_text("text", 10)),
        ("tail", X.tail_text("text", 4)),
        ("marked", X.replace_text("text", "the", "THE")),
        ("has_the", X.has_text("text", "the")),
    ]
    return derive(table(spark, sf_dir, "documents"), items).select("doc_id", *[name for name, _ in items])


@query("""
    SELECT c_custkey, left(c_name, 3) AS head, right(c_name, 4) AS tail,
           substring(c_name, 3, 3) AS middle, left(c_name, 3) || '****' || right(c_name, 4) AS masked,
           left(CAST(c_custkey AS VARCHAR), 10) AS key_text,
           TRY_CAST(substring(c_name, length(c_name) - 1, 1) AS INTEGER) AS digit,
           CASE WHEN TRY_CAST(substring(c_name, length(c_name) - 1, 1) AS INTEGER) % 2 = 1
                THEN 'odd' ELSE 'even' END AS parity,
           substring(c_name, 7, 4) AS born
    FROM customer
""")
def formula_slice_mask(spark, sf_dir):
    items = [
        ("head", X.head_text("c_name", 3)),
        ("tail", X.tail_text("c_name", 4)),
        ("middle", X.slice_text("c_name", 2, 5)),
        ("masked", X.mask_middle("c_name")),
        ("key_text", X.head_text("c_custkey", 10)),
        ("digit", X.digit_from_end("c_name", 2)),
        ("parity", X.parity("digit", "odd", "even")),
        ("born", X.slice_text("c_name", 6, 10)),
    ]
    return derive(table(spark, sf_dir, "customer"), items).select("c_custkey", *[name for name, _ in items])


@query("""
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_quantity < 10 THEN 'low' ELSE 'enough' END AS stock,
           CASE WHEN l_quantity > 40 THEN 'first' WHEN l_quantity > 20 THEN 'second' ELSE 'third' END AS grade,
           CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS returned,
           CASE WHEN l_quantity > 30 AND l_discount < 0.03 THEN 'yes' ELSE 'no' END AS focus,
           CASE WHEN l_quantity < 5 OR l_tax > 0.06 THEN 'yes' ELSE 'no' END AS refill
    FROM lineitem
""")
def formula_case(spark, sf_dir):
    quantity = ref("l_quantity")
    items = [
        ("stock", X.choose(quantity < 10, "low", "enough")),
        ("grade", X.choose_first([(quantity > 40, "first"), (quantity > 20, "second")], "third")),
        ("returned", X.choose(ref("l_returnflag") == "R", "yes", "no")),
        ("focus", X.choose((X.number_or("l_quantity") > 30) & (ref("l_discount") < 0.03), "yes", "no")),
        ("refill", X.choose((quantity < 5) | (ref("l_tax") > 0.06), "yes", "no")),
    ]
    lines = derive(table(spark, sf_dir, "lineitem"), items)
    return lines.select("l_orderkey", "l_linenumber", *[name for name, _ in items])


@query("""
    SELECT d.doc_id, coalesce(l.quality, 0) AS quality,
           CASE WHEN l.toxic IS NULL THEN 'open' ELSE 'rated' END AS state,
           coalesce(CAST(l.toxic AS VARCHAR), d.lang) AS toxic_or_lang,
           coalesce(CAST(l.quality AS DOUBLE), 0) > 0.5 AS good,
           CASE WHEN l.quality = 1 THEN 'one' ELSE 'other' END AS quality_label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def formula_null_default(spark, sf_dir):
    items = [
        ("quality_label", X.choose(ref("quality") == 1, "one", "other")),
        ("good", X.number_or("quality") > 0.5),
        ("quality", X.default_for("quality", 0)),
        ("state", X.label_missing("toxic", "open", "rated")),
        ("toxic_or_lang", X.first_given(X.to_text("toxic"), "lang")),
    ]
    labelled = derive(lookup_unmatched(spark, sf_dir), items)
    return labelled.select("doc_id", *[name for name, _ in items])


@query("""
    SELECT event_id, ts AS day_time, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m,
           CAST(day(ts) AS INTEGER) AS d,
           strftime(ts, '%Y-%m') AS ym, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
           date_trunc('day', ts) AS from_text
    FROM events
""")
def formula_dates(spark, sf_dir):
    items = [
        ("day_time", X.to_date("ts")),
        ("y", X.year("ts")),
        ("m", X.month("ts")),
        ("d", X.day("ts")),
        ("ym", X.year_month("ts")),
        ("weekday", X.weekday("ts")),
        ("from_text", X.to_date(F.date_format("ts", "yyyy/M/d"))),
    ]
    return derive(table(spark, sf_dir, "events"), items).select("event_id", *[name for name, _ in items])


@query("""
    SELECT event_id,
           CAST(floor(epoch_us(TIMESTAMP '2024-01-03 12:00:00') / 86400000000 - epoch_us(ts) / 86400000000) AS BIGINT)
               AS days_to,
           CAST(floor(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03 12:00:00') AS HUGEINT) / 86400000000) AS BIGINT)
               AS days_from,
           CAST(0 AS BIGINT) AS unknown
    FROM events
""")
def formula_day_diff(spark, sf_dir):
    """Elapsed 24-hour periods, rounded down on both sides of zero."""
    noon = F.lit("2024-01-03 12:00:00")
    items = [
        ("days_to", X.days_since("ts", "2024-01-03 12:00:00")),
        ("days_from", X.days_between("ts", noon)),
        ("unknown", X.days_between("ts", F.lit(None).cast("string"))),
    ]
    return derive(table(spark, sf_dir, "events"), items).select("event_id", *[name for name, _ in items])


@query("""
    SELECT o_orderkey,
           TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS rank,
           TRY_CAST(o_orderpriority AS BIGINT) AS bad_int,
           TRY_CAST(o_orderstatus AS DOUBLE) AS bad_float,
           CAST(o_custkey AS VARCHAR) AS cust_text,
           round_even(o_totalprice, 0) AS rounded,
           round_even(o_orderkey * 0.125::DOUBLE, 2) AS eighths,
           CAST(ceil(o_totalprice / 12) AS BIGINT) AS boxes,
           CAST(floor(o_totalprice / 12) AS BIGINT) AS full_boxes
    FROM orders
""")
def formula_cast_round(spark, sf_dir):
    items = [
        ("rank", X.to_int(X.head_text("o_orderpriority", 1))),
        ("bad_int", X.to_int("o_orderpriority")),
        ("bad_float", X.to_float("o_orderstatus")),
        ("cust_text", X.to_text("o_custkey")),
        ("rounded", X.round_half_even("o_totalprice")),
        ("eighths", X.round_half_even(X.scale("o_orderkey", 0.125), 2)),
        ("boxes", X.ceil_quotient("o_totalprice", 12)),
        ("full_boxes", X.floor_quotient("o_totalprice", 12)),
    ]
    return derive(table(spark, sf_dir, "orders"), items).select("o_orderkey", *[name for name, _ in items])


@query("""
    SELECT l_orderkey, l_linenumber, base, base * 2 AS double_base,
           CASE WHEN base * 2 > 50 THEN 'big' ELSE 'small' END AS l_returnflag
    FROM (SELECT l_orderkey, l_linenumber, l_quantity - l_linenumber AS base FROM lineitem)
""")
def formula_chain(spark, sf_dir):
    """Later formulas use and overwrite earlier columns; SQL text and columns mix."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    items = [
        ("base", "l_quantity - l_linenumber"),
        ("double_base", ref("base") * 2),
        ("l_returnflag", "CASE WHEN double_base > 50 THEN 'big' ELSE 'small' END"),
    ]
    return derive(lines, items).drop("l_quantity")


@query("""
    SELECT s_suppkey, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS cause,
           '' AS remark, 'normal' AS state, 1 AS checked
    FROM supplier
""")
def formula_blank_constant(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    items = [
        "note",
        ("cause", X.blank()),
        ("remark", X.empty_text()),
        ("state", X.constant("normal")),
        ("checked", X.constant(1)),
    ]
    return derive(supplier, items)
