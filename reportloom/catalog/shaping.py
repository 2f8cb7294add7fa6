"""Selecting, renaming, sorting and typing columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.registry import query, table
from reportloom.operators.columns import keep_columns, project_detail, select_columns
from reportloom.operators.infer import infer_types
from reportloom.operators.ordering import sort_rows


@query("""
    SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, l_shipdate, l_returnflag FROM lineitem
""")
def select_letters(spark, sf_dir):
    """Letters, a range given backwards, names in other case, each column once."""
    return select_columns(table(spark, sf_dir, "lineitem"), "D:B + [A], L_SHIPDATE + l_returnflag, C")


@query("SELECT o_totalprice, o_orderkey FROM orders")
def keep_listed_columns(spark, sf_dir):
    return keep_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "not_there", "o_orderkey"])


@query("SELECT c_name AS client, '' AS remark, c_acctbal AS balance, c_name AS client_again FROM customer")
def detail_rename_missing(spark, sf_dir):
    col_map = [("c_name", "client"), ("remark", "remark"), ("c_acctbal", "balance"), ("c_name", "client_again")]
    return project_detail(table(spark, sf_dir, "customer"), col_map)


@query("""
    SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status,
           CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS cust,
           CAST(NULL AS DOUBLE) AS nothing
    FROM orders
""")
def infer_numeric(spark, sf_dir):
    """Text that holds numbers throughout becomes bigint or double, other text stays."""
    text = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).cast("string").alias("cust"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return infer_types(text)


@query("""
    SELECT event_id, date_trunc('day', ts) AS slashed, date_trunc('second', ts) AS dashed,
           CASE WHEN event_type = 'click' THEN NULL ELSE date_trunc('day', ts) END AS some
    FROM events
""")
def infer_dates(spark, sf_dir):
    """Mostly dates: the text that is none becomes null."""
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy/M/d").alias("slashed"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dashed"),
        F.when(F.col("event_type") == "click", "unknown")
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("some"),
    )
    return infer_types(text)


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part")
def sort_multi_ci(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return sort_rows(part, [("p_brand", True), ("p_size", False), ("unknown", True), ("p_type", True)])
