"""Lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.registry import query, table
from reportloom.operators.columns import ref
from reportloom.operators.lookup import first_per_key, link_tables, lookup_join


@query("""
    SELECT o.*, c.c_name, c.c_mktsegment
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def lookup_single(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return lookup_join(orders, customer, "o_custkey", "c_custkey", "c_name, c_mktsegment")


@query("""
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice,
           p.p_brand AS part_p_brand, p.p_type AS part_p_type
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
""")
def lookup_prefix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    part = table(spark, sf_dir, "part")
    return lookup_join(lines, part, "l_partkey", "p_partkey", ["p_brand", "p_type"], prefix="part_")


@query("""
    SELECT d.doc_id, d.lang, d.text, b.text AS text_dup
    FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
""")
def lookup_collision_dup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return lookup_join(documents, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


@query("""
    WITH firsts AS (
        SELECT l_partkey, l_suppkey, l_shipdate, l_quantity,
               row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity) AS rn
        FROM lineitem)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
           f.l_shipdate AS first_l_shipdate, f.l_quantity AS first_l_quantity
    FROM lineitem l LEFT JOIN firsts f
      ON l.l_partkey = f.l_partkey AND l.l_suppkey = f.l_suppkey AND f.rn = 1
""")
def lookup_composite(spark, sf_dir):
    """The first shipment of the same part by the same supplier, on two keys."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    main = lines.select("l_orderkey", "l_linenumber", *keys)
    return lookup_join(main, lines, keys, keys, "l_shipdate, l_quantity", prefix="first_")


@query("""
    WITH firsts AS (
        SELECT *, row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS rn
        FROM orders)
    SELECT c.c_custkey, c.c_name, f.o_orderkey, f.o_totalprice, f.o_orderdate
    FROM customer c LEFT JOIN firsts f ON c.c_custkey = f.o_custkey AND f.rn = 1
""")
def lookup_duplicate_target(spark, sf_dir):
    """Each customer's first order: many target rows per key, one is used."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    picks = ["o_orderkey", "o_totalprice", "o_orderdate"]
    return lookup_join(
        customer, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", picks, order_by="o_orderdate"
    )


@query("""
    SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def lookup_unmatched(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lookup_join(documents, table(spark, sf_dir, "labels"), "doc_id", "doc_id", "quality, toxic")


@query("""
    SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_nationkey, n.n_name, n.n_regionkey, r.r_name
    FROM lineitem l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def lookup_chain(spark, sf_dir):
    """Each rule's key is what the rule before it brought back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return link_tables(lines, region_rules(spark, sf_dir))


def region_rules(spark, sf_dir) -> list[dict]:
    """Lookups from a line item to the region of its customer."""
    steps = [
        ("orders", "l_orderkey", "o_orderkey", ["o_custkey"]),
        ("customer", "o_custkey", "c_custkey", ["c_nationkey"]),
        ("nation", "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"]),
        ("region", "n_regionkey", "r_regionkey", ["r_name"]),
    ]
    return [
        {
            "target": table(spark, sf_dir, name),
            "master_keys": master,
            "target_keys": target,
            "pick": pick,
        }
        for name, master, target, pick in steps
    ]


@query("""
    WITH firsts AS (
        SELECT o_custkey, o_orderkey,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
        FROM orders)
    SELECT c.c_custkey, c.c_name, f.o_orderkey
    FROM customer c LEFT JOIN firsts f
      ON CAST(c.c_custkey AS VARCHAR) = CAST(f.o_custkey AS VARCHAR) AND f.rn = 1
""")
def lookup_text_keys(spark, sf_dir):
    """A number matches its own text."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders")
    as_text = orders.select(F.col("o_custkey").cast("string").alias("cust"), "o_orderkey")
    return lookup_join(customer, as_text, "c_custkey", "cust", "o_orderkey")


@query("""
    SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def lookup_by_letter(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return lookup_join(orders, customer, "B", "[A]", "D:B", by_letter=True)


@query("""
    SELECT l.l_orderkey, l.l_linenumber, s.s_name, s.s_acctbal
    FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
""")
def lookup_unique_target(spark, sf_dir):
    """A target promised to be unique is joined without the first-per-key step."""
    lines = table(spark, sf_dir, "lineitem")
    linked = lookup_join(
        lines, table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", "s_name, s_acctbal", unique=True
    )
    return linked.select("l_orderkey", "l_linenumber", "s_name", "s_acctbal")


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM (SELECT *, row_number() OVER (
              PARTITION BY o_custkey
              ORDER BY o_orderdate, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority) AS rn
          FROM orders)
    WHERE rn = 1
""")
def first_order_per_customer(spark, sf_dir):
    return first_per_key(table(spark, sf_dir, "orders"), "o_custkey", order_by="o_orderdate")


@query("""
    SELECT user_id, event_type, min(event_id) AS event_id
    FROM events GROUP BY user_id, event_type
""")
def distinct_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return first_per_key(events, ["user_id", "event_type"])


@query("""
    WITH keyed AS (
        SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS open_cust FROM orders)
    SELECT k.o_orderkey, k.open_cust, c.c_name
    FROM keyed k LEFT JOIN customer c ON k.open_cust = c.c_custkey
""")
def lookup_null_keys(spark, sf_dir):
    """A third of the main keys missing: those rows stay, unmatched."""
    orders = table(spark, sf_dir, "orders")
    open_cust = F.when(ref("o_orderstatus") != "F", ref("o_custkey")).alias("open_cust")
    keyed = orders.select("o_orderkey", open_cust)
    return lookup_join(keyed, table(spark, sf_dir, "customer"), "open_cust", "c_custkey", "c_name")


@query("""
    WITH firsts AS (
        SELECT l_suppkey, l_shipdate, l_orderkey, l_quantity,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_quantity) AS rn
        FROM lineitem)
    SELECT s_suppkey, s_name, l_shipdate, l_orderkey, l_quantity
    FROM supplier LEFT JOIN firsts ON s_suppkey = l_suppkey AND rn = 1
    WHERE s_nationkey < 3
""")
def lookup_pruned_target(spark, sf_dir):
    """The first shipment of a few suppliers: lines of others are dropped before they are grouped."""
    some = table(spark, sf_dir, "supplier").where("s_nationkey < 3").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem")
    return lookup_join(some, lines, "s_suppkey", "l_suppkey", "l_shipdate, l_orderkey, l_quantity", prune=True)


@query("""
    SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate, c_name, c_nationkey, s.s_nationkey, n.n_name, n.n_regionkey, r_name,
           m.n_name AS n_name_dup
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
         LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey
         LEFT JOIN region ON n.n_regionkey = r_regionkey LEFT JOIN nation m ON s.s_nationkey = m.n_nationkey
""")
def lookup_chain_contracted(spark, sf_dir):
    """Two chains of lookups, each put together before the lines of orders meet it; one name is taken twice."""
    tables = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "supplier", "nation", "region")}
    rules = [
        {"target": tables["orders"], "master_keys": "l_orderkey", "target_keys": "o_orderkey", "pick": "o_custkey, o_orderdate"},
        {"target": tables["customer"], "master_keys": "o_custkey", "target_keys": "c_custkey", "pick": "c_name, c_nationkey"},
        {"target": tables["supplier"], "master_keys": "l_suppkey", "target_keys": "s_suppkey", "pick": "s_nationkey"},
        {"target": tables["nation"], "master_keys": "c_nationkey", "target_keys": "n_nationkey", "pick": "n_name, n_regionkey"},
        {"target": tables["region"], "master_keys": "n_regionkey", "target_keys": "r_regionkey", "pick": "r_name"},
        {"target": tables["nation"], "master_keys": "s_nationkey", "target_keys": "n_nationkey", "pick": "n_name"},
    ]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return link_tables(lines, rules).drop("l_suppkey")
