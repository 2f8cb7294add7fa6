"""Row conditions. Tables without nulls get them from an unmatched lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.lookups import lookup_collision_dup, lookup_unmatched
from reportloom.catalog.registry import query, table
from reportloom.operators import predicates as P
from reportloom.operators.lookup import rows_in_table, rows_not_in_table

_LABELLED = """
    WITH labelled AS (
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT * FROM labelled WHERE """


def _labelled(spark, sf_dir, condition):
    return P.filter_rows(lookup_unmatched(spark, sf_dir), condition)


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3")
def filter_eq(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return P.filter_rows(lines, P.all_of(P.eq("l_returnflag", "R"), P.eq("l_linenumber", "3")))


@query(_LABELLED + "quality IS DISTINCT FROM 1")
def filter_ne_null(spark, sf_dir):
    return _labelled(spark, sf_dir, P.ne("quality", 1))


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_shipdate FROM lineitem
    WHERE l_quantity > 10 AND l_quantity <= 40 AND l_discount >= 0.03 AND l_shipdate < TIMESTAMP '1998-07-01'
""")
def filter_gt_ge_lt_le(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    condition = P.all_of(
        P.gt("l_quantity", 10), P.le("l_quantity", 40), P.ge("l_discount", 0.03), P.lt("l_shipdate", "1998/7/1")
    )
    return P.filter_rows(lines, condition).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
    )


@query("SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(the|le) [a-f]+ion')")
def filter_contains(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.filter_rows(documents, P.contains("text", "(the|le) [a-f]+ion"))


@query("SELECT page_id, html FROM pages WHERE contains(html, '</p>;') OR contains(html, '<ul>')")
def filter_contains_literal(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    either = P.any_of(P.contains("html", "</p>;", regex=False), P.contains("html", "<ul>", regex=False))
    return P.filter_rows(pages, either)


@query("""
    SELECT d.doc_id, d.lang, d.text, b.text AS text_dup
    FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
    WHERE NOT coalesce(regexp_matches(b.text, 'the|le'), false)
""")
def filter_not_contains_null(spark, sf_dir):
    return P.filter_rows(lookup_collision_dup(spark, sf_dir), P.not_contains("text_dup", "the|le"))


@query("SELECT * FROM part WHERE starts_with(p_name, 'small') AND ends_with(p_name, 'ring')")
def filter_starts_ends(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return P.filter_rows(part, P.all_of(P.starts_with("p_name", "small"), P.ends_with("p_name", "ring")))


@query("SELECT * FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND p_size IN (1, 5, 11, 28)")
def filter_in(spark, sf_dir):
    brands = P.split_values("Brand#2; Brand#17\n\tBrand#2")
    condition = P.all_of(P.is_in("p_brand", brands), P.is_in("p_size", [1, "5", 11, 28, "none"]))
    return P.filter_rows(table(spark, sf_dir, "part"), condition)


@query(_LABELLED + "quality IS NULL OR quality NOT IN (1, 7)")
def filter_not_in_null(spark, sf_dir):
    return _labelled(spark, sf_dir, P.not_in("quality", [1, 7]))


@query("""
    SELECT * FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def filter_in_table(spark, sf_dir):
    building = P.filter_rows(table(spark, sf_dir, "customer"), P.eq("c_mktsegment", "BUILDING"))
    return rows_in_table(table(spark, sf_dir, "orders"), "o_custkey", building, "c_custkey")


@query(_LABELLED + "quality IS NULL OR quality NOT IN (SELECT toxic FROM labels)")
def filter_not_in_table(spark, sf_dir):
    return rows_not_in_table(
        lookup_unmatched(spark, sf_dir), "quality", table(spark, sf_dir, "labels"), "toxic"
    )


@query("""
    SELECT * FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
          AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') OR o_totalprice > 250000
""")
def filter_in_list_or(spark, sf_dir):
    """Lists as long as tables, inside a condition that other rows meet without them."""
    customer, lines = table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    owing = P.in_table("o_custkey", P.filter_rows(customer, P.gt("c_acctbal", 0)), "c_custkey")
    kept = P.not_in_table("o_orderkey", P.filter_rows(lines, P.eq("l_returnflag", "R")), "l_orderkey")
    return P.filter_rows(table(spark, sf_dir, "orders"), P.any_of(P.all_of(owing, kept), P.gt("o_totalprice", 250000)))


@query("""
    WITH keyed AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS open_cust FROM orders)
    SELECT o_orderkey, open_cust FROM keyed
    WHERE open_cust IS NULL OR open_cust NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') OR o_totalprice < 1000
""")
def filter_not_in_list_null(spark, sf_dir):
    """A long list that rows must not be in keeps those without a value."""
    orders = table(spark, sf_dir, "orders")
    keyed = orders.withColumn("open_cust", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")))
    others = P.filter_rows(table(spark, sf_dir, "customer"), P.ne("c_mktsegment", "BUILDING"))
    condition = P.any_of(P.not_in_table("open_cust", others, "c_custkey"), P.lt("o_totalprice", 1000))
    return P.filter_rows(keyed, condition).select("o_orderkey", "open_cust")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def filter_unlabelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows_not_in_table(documents, "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("""
    SELECT * FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
      AND o_totalprice BETWEEN 1000 AND 250000.5
""")
def filter_between(spark, sf_dir):
    condition = P.all_of(
        P.between("o_orderdate", "1996-01-01", "1996-12-31"), P.between("o_totalprice", 1000, 250000.5)
    )
    return P.filter_rows(table(spark, sf_dir, "orders"), condition)


@query(_LABELLED + "quality IS NULL")
def filter_is_null(spark, sf_dir):
    return _labelled(spark, sf_dir, P.is_null("quality"))


@query(_LABELLED + "quality IS NOT NULL")
def filter_not_null(spark, sf_dir):
    return _labelled(spark, sf_dir, P.not_null("quality"))


@query("""
    SELECT * FROM events
    WHERE (event_type = 'click' AND value > 50) OR user_id BETWEEN 10 AND 20 OR value < 1
""")
def filter_and_or(spark, sf_dir):
    spec = {
        "any": [
            {"all": [{"col": "event_type", "op": "==", "value": "click"}, {"col": "value", "op": ">", "value": 50}]},
            {"col": "user_id", "op": "between", "value": [10, 20]},
            {"col": "value", "op": "<", "value": 1},
        ]
    }
    return P.filter_rows(table(spark, sf_dir, "events"), spec)


@query("SELECT * FROM supplier WHERE s_acctbal > 1000 AND (s_nationkey < 12 OR s_name LIKE '%7')")
def filter_sql(spark, sf_dir):
    return P.filter_rows(table(spark, sf_dir, "supplier"), "s_acctbal > 1000 AND (s_nationkey < 12 OR s_name LIKE '%7')")


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS cust, o_orderkey FROM orders
    WHERE CAST(o_custkey AS VARCHAR) IN ('77', '130', 'none')
""")
def filter_number_on_text(spark, sf_dir):
    """Numbers in a list compare with a text column as text."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cust"), "o_orderkey")
    return P.filter_rows(orders, P.any_of(P.eq("cust", 77), P.is_in("cust", [130, "none"])))


@query("""
    SELECT DISTINCT v AS value FROM (
        SELECT regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS v
        FROM (SELECT unnest(regexp_split_to_array(text, '[\\t\\n,;，；]')) AS part FROM conversations))
    WHERE v <> ''
""")
def split_value_lists(spark, sf_dir):
    """Distinct cleaned values of lists held in a text column."""
    return P.split_value_table(table(spark, sf_dir, "conversations"), "text")
