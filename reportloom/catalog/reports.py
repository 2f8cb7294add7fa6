"""Written outputs and whole report jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.registry import query, table
from reportloom.operators.ordering import sort_rows
from reportloom.plans.job import build_outputs, run_report_job
from reportloom.plans.staging import new_path
from reportloom.sources.folders import merge_folder
from reportloom.sources.outputs import convert_folder, write_output
from reportloom.sources.tables import scan_csv, scan_table


def report_spec(sf_dir: str) -> dict:
    """A job with one detail output and one pivot over orders, their customers and nations."""
    return {
        "master": {
            "path": f"{sf_dir}/orders.parquet",
            "columns": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"],
        },
        "rules": [
            {
                "target_path": f"{sf_dir}/customer.parquet",
                "master_keys": "o_custkey",
                "target_keys": "A",
                "pick_cols": "c_name + c_nationkey + c_mktsegment",
                "col_prefix": "cust_",
            },
            {
                "target_path": f"{sf_dir}/nation.parquet",
                "master_keys": "cust_c_nationkey",
                "target_keys": "n_nationkey",
                "pick_cols": "n_name",
            },
        ],
        "tasks": [
            {
                "name": "large orders",
                "calc_fields": [
                    ["year", "year(o_orderdate)"],
                    ["half", "CAST(o_totalprice AS DECIMAL(18,2)) / 2"],
                    "note",
                ],
                "filter_expr": {
                    "all": [
                        {"col": "o_totalprice", "op": ">=", "value": 300000},
                        {"col": "cust_c_mktsegment", "op": "!=", "value": "BUILDING"},
                    ]
                },
                "col_map": [
                    {"src": "o_orderkey", "dst": "order"},
                    {"src": "cust_c_name", "dst": "client"},
                    {"src": "n_name", "dst": "nation"},
                    {"src": "year", "dst": "year"},
                    {"src": "half", "dst": "half"},
                    {"src": "note", "dst": "note"},
                    {"src": "not_there", "dst": "blank"},
                ],
                "sort_config": [{"col": "nation", "asc": True}, {"col": "order", "asc": False}],
            },
            {
                "name": "segments",
                "calc_fields": [["amount", "CAST(o_totalprice AS DECIMAL(18,2))"]],
                "pivot_cfg": {
                    "enabled": True,
                    "group_by": ["cust_c_mktsegment"],
                    "pivot_cols": ["o_orderstatus"],
                    "values_agg": {"amount": "sum", "o_orderkey": "count"},
                    "renames": {"amount": "total", "o_orderkey": "orders"},
                },
            },
        ],
    }


_DETAIL_SQL = """
    SELECT o.o_orderkey AS "order", c.c_name AS client, n.n_name AS nation, CAST(year(o.o_orderdate) AS INTEGER) AS year,
           CAST(CAST(o.o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) / 2 AS half,
           CAST(NULL AS VARCHAR) AS note, '' AS blank
    FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_totalprice >= 300000 AND c.c_mktsegment IS DISTINCT FROM 'BUILDING'
"""

_PIVOT_SQL = (
    "SELECT c.c_mktsegment AS cust_c_mktsegment, "
    + ", ".join(
        f"CAST(coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o.o_orderstatus = '{s}'), 0)"
        f' AS DOUBLE) AS "total_{s}", '
        f"count(o.o_orderkey) FILTER (WHERE o.o_orderstatus = '{s}') AS \"orders_{s}\""
        for s in "FOP"
    )
    + " FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"
)


def _doubles(df, names):
    return df.select([F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


@query(_DETAIL_SQL)
def report_detail(spark, sf_dir):
    return _doubles(build_outputs(spark, report_spec(sf_dir) | {"infer": False})["large orders"], ["half"])


@query(_PIVOT_SQL)
def report_pivot(spark, sf_dir):
    """The job's pivot output, with types inferred over the joined table."""
    result = build_outputs(spark, report_spec(sf_dir) | {"keep_text": ["cust_c_name"]})["segments"]
    return _doubles(result, [c for c in result.columns if c.startswith("total_")])


@query(_PIVOT_SQL)
def report_job_written(spark, sf_dir):
    """The whole job, its outputs written and one of them read back."""
    out = new_path(spark, "report")
    run_report_job(spark, report_spec(sf_dir) | {"output": out, "infer": False, "share_pool": True})
    result = spark.read.parquet(f"{out}/segments")
    return _doubles(result, [c for c in result.columns if c.startswith("total_")])


@query("SELECT * FROM orders")
def output_split(spark, sf_dir):
    """Files of at most 10,000 rows hold the same rows."""
    out = new_path(spark, "split")
    write_output(table(spark, sf_dir, "orders"), out, max_rows=10_000)
    return scan_table(spark, out)


@query("""
    SELECT sheet_no, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS INTEGER) + 1 AS sheet_no
          FROM orders)
    GROUP BY sheet_no
""")
def output_numbered_sheets(spark, sf_dir):
    """Sorted rows cut into numbered sheets of exactly 1,000."""
    out = new_path(spark, "sheets")
    orders = sort_rows(table(spark, sf_dir, "orders"), [("o_orderkey", True)])
    write_output(orders, out, max_rows=1_000, numbered_sheets=True)
    sheets = scan_table(spark, out).groupBy("sheet_no")
    return sheets.agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
           c_acctbal, c_mktsegment FROM customer
""")
def csv_round_trip(spark, sf_dir):
    """Written as CSV, every column comes back as text."""
    out = new_path(spark, "csv") + ".csv"
    write_output(table(spark, sf_dir, "customer"), out, file_format="csv")
    # The text of a double is the engine's own; it must give the same number again.
    return scan_csv(spark, out, multiline=True).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_long_text(spark, sf_dir):
    """Whole texts survive CSV, with their quotes, commas and line breaks."""
    out = new_path(spark, "csv") + ".csv"
    write_output(table(spark, sf_dir, "documents").select("doc_id", "text"), out, file_format="csv")
    return scan_csv(spark, out, multiline=True)


@query("""
    SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey,
           CAST(NULL AS VARCHAR) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name, CAST(NULL AS VARCHAR) AS s_nationkey,
           CAST(NULL AS DOUBLE) AS s_acctbal FROM nation
    UNION ALL
    SELECT NULL, NULL, NULL, CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), s_acctbal FROM supplier
""")
def convert_csv_folder(spark, sf_dir):
    """A folder of CSV tables converted to Parquet."""
    src, dst = new_path(spark, "in"), new_path(spark, "out")
    write_output(table(spark, sf_dir, "nation"), f"{src}/nation.csv", file_format="csv")
    write_output(table(spark, sf_dir, "supplier"), f"{src}/supplier.csv", file_format="csv")
    convert_folder(spark, src, dst)
    nation = scan_table(spark, f"{dst}/nation.parquet")
    supplier = scan_table(spark, f"{dst}/supplier.parquet").withColumn("s_acctbal", F.col("s_acctbal").cast("double"))
    return nation.unionByName(supplier, allowMissingColumns=True)


def customer_folder(spark, sf_dir) -> str:
    """A folder with a CSV table for each nation's customers; every other nation's has its columns in another order."""
    src = new_path(spark, "many")
    customer = table(spark, sf_dir, "customer").withColumn("of", F.concat(F.lit("n"), "c_nationkey", F.lit(".csv")))
    for rest, columns in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_custkey", "c_name"])):
        some = customer.where(F.col("c_nationkey") % 2 == rest).select(*columns, "of")
        some.write.partitionBy("of").option("header", True).option("escape", '"').mode("append").csv(src)
    return src


@query("""
    SELECT 'of=n' || c_nationkey || '.parquet' AS file, true AS ok, count(*) AS rows, sum(c_custkey) AS keys,
           count(DISTINCT c_mktsegment) AS segments
    FROM customer GROUP BY c_nationkey
""")
def convert_many_files(spark, sf_dir):
    """Many tables with few different headers: converted and counted by header, each into a table of its own."""
    dst = new_path(spark, "out")
    report = convert_folder(spark, customer_folder(spark, sf_dir), dst).select("file", "ok", "rows")
    found = spark.read.schema("c_custkey string, c_mktsegment string").parquet(f"{dst}/*.parquet")
    file = F.regexp_extract("_metadata.file_path", "([^/]*)/[^/]*$", 1)
    sums = found.groupBy(file.alias("file")).agg(
        F.sum(F.col("c_custkey").cast("bigint")).alias("keys"), F.count_distinct("c_mktsegment").alias("segments")
    )
    return report.join(sums, "file")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def merge_folder_many(spark, sf_dir):
    """Many tables with their columns in several orders, their headers found together."""
    return merge_folder(spark, customer_folder(spark, sf_dir), ["c_custkey", "c_name", "c_mktsegment"])[0]
