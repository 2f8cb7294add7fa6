"""Tables below and beside each other, and folders of tables."""

from __future__ import annotations

from reportloom.catalog.registry import query, table
from reportloom.operators.combine import align_tables, append_tables
from reportloom.sources.folders import merge_folder


@query("""
    SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment
    FROM customer
    UNION ALL
    SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def append_with_missing_column(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS name", "c_nationkey AS nationkey", "c_acctbal AS acctbal", "c_mktsegment AS segment"
    )
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS name", "s_nationkey AS nationkey", "s_acctbal AS acctbal"
    )
    return append_tables([customer, supplier])


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS code, o_totalprice AS amount FROM orders
    UNION ALL
    SELECT p_brand, p_retailprice FROM part
    UNION ALL
    SELECT p_brand, p_retailprice FROM part
""")
def append_mixed_types(spark, sf_dir):
    """A number column below a text column becomes text; repeated rows stay."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS code", "o_totalprice AS amount")
    part = table(spark, sf_dir, "part").selectExpr("p_brand AS code", "p_retailprice AS amount")
    return append_tables([orders, part, part])


@query("""
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.n_chars, l.quality, l.toxic
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def align_documents_labels(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return align_tables([documents, table(spark, sf_dir, "labels")])


@query("""
    SELECT coalesce(o.custkey, c.custkey) AS custkey, o.orderkey, c.name
    FROM (SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS custkey FROM orders) o
    FULL JOIN (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey END AS custkey,
                      c_name AS name FROM customer) c
    ON o.custkey = c.custkey
""")
def align_with_null_keys(spark, sf_dir):
    """Keys missing on one side: such rows stay, alone."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS orderkey", "CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS custkey"
    )
    customer = table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS custkey", "c_name AS name"
    )
    return align_tables([orders, customer])


@query("""
    WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey, o_orderkey AS orderkey FROM orders),
         c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS custkey, c_name AS name FROM customer),
         e AS (SELECT user_id AS custkey, event_id, event_type FROM events),
         oc AS (SELECT coalesce(o.custkey, c.custkey) AS custkey, orderkey, name FROM o FULL JOIN c ON o.custkey = c.custkey)
    SELECT coalesce(oc.custkey, e.custkey) AS custkey, orderkey, name, event_id, event_type
    FROM oc FULL JOIN e ON oc.custkey = e.custkey
""")
def align_three_tables(spark, sf_dir):
    """Three tables with repeated keys in two of them and missing keys in two, in one exchange."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey", "o_orderkey AS orderkey"
    )
    customer = table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS custkey", "c_name AS name"
    )
    events = table(spark, sf_dir, "events").selectExpr("user_id AS custkey", "event_id", "event_type")
    return align_tables([orders, customer, events])


@query("SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def merge_folder_doc_id(spark, sf_dir):
    """Of all tables in the folder, the ones with a doc_id; the others are skipped."""
    return merge_folder(spark, sf_dir, ["doc_id"])[0]


@query("""
    SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations
""")
def merge_folder_text(spark, sf_dir):
    return merge_folder(spark, sf_dir, ["text"])[0]
