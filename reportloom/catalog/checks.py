"""Queries for operators whose answers other queries do not show: exact numbers, files as they are, names, reports, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.catalog.registry import query, table
from reportloom.catalog.reports import report_spec
from reportloom.functions import formulas as X
from reportloom.operators import predicates as P
from reportloom.operators.columns import cleaned_output_names, list_columns
from reportloom.operators.combine import append_tables
from reportloom.operators.lookup import link_tables
from reportloom.operators.ordering import sort_rows
from reportloom.operators.pivot import group_agg, pivot_long
from reportloom.plans.job import analyze_pool, build_pool, run_report_job
from reportloom.plans.preset import preset_filter
from reportloom.plans.spec import JobSpec
from reportloom.plans.staging import new_path
from reportloom.sources.listing import list_data_files
from reportloom.sources.outputs import with_positions, write_output
from reportloom.sources.tables import scan_csv, scan_sheet

# Ids of 19 and 21 digits, as they stand in ledgers.
_LONG, _LONGER = 1234567890000000000, 123456789012345678900


def _long_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        (F.col("o_orderkey") + F.lit(_LONG)).alias("id"),
        (F.col("o_orderkey").cast("decimal(38,0)") + F.lit(str(_LONGER)).cast("decimal(38,0)"))
        .cast("decimal(38,0)").alias("code"),
    )


@query(f"""
    SELECT o_orderkey, o_orderkey = 7 AS id_eq, o_orderkey <> 7 AS id_ne, o_orderkey IN (7, 9) AS id_in,
           o_orderkey NOT IN (7, 9) AS id_not_in, o_orderkey BETWEEN 7 AND 9 AS id_between, o_orderkey > 7 AS id_gt,
           o_orderkey = 7 AS code_eq, o_orderkey <> 7 AS code_ne, o_orderkey IN (7, 9) AS code_in,
           o_orderkey BETWEEN 7 AND 9 AS code_between
    FROM orders WHERE o_orderkey + {_LONG} > {_LONG - 1}
""")
def filter_long_ids(spark, sf_dir):
    """Neighbouring ids of 19 and 21 digits are told apart, given as texts."""
    ids = _long_ids(spark, sf_dir)
    seven, nine = str(_LONG + 7), str(_LONG + 9)
    far_seven, far_nine = str(_LONGER + 7), str(_LONGER + 9)
    tests = {
        "id_eq": P.eq("id", seven), "id_ne": P.ne("id", seven), "id_in": P.is_in("id", [seven, nine]),
        "id_not_in": P.not_in("id", [seven, nine]), "id_between": P.between("id", seven, nine), "id_gt": P.gt("id", seven),
        "code_eq": P.eq("code", far_seven), "code_ne": P.ne("code", far_seven),
        "code_in": P.is_in("code", [far_seven, far_nine]), "code_between": P.between("code", far_seven, far_nine),
    }
    return ids.select("o_orderkey", *(test(ids).alias(name) for name, test in tests.items()))


@query(f"""
    SELECT o_orderkey, ((o_orderkey + {_LONG}) % 7) AS rest, (7 - ((o_orderkey + {_LONG}) % 7)) % 7 AS below,
           CASE WHEN (o_orderkey + {_LONG}) % 7 = 0 THEN 0 ELSE (o_orderkey + {_LONG}) % 7 - 7 END AS negative
    FROM orders
""")
def formula_mod_large(spark, sf_dir):
    """Remainders of 19-digit numbers, with the sign of the divisor."""
    ids = _long_ids(spark, sf_dir)
    return ids.select(
        "o_orderkey", X.remainder("id", 7).alias("rest"), X.remainder(-F.col("id"), 7).alias("below"),
        X.remainder("id", -7).alias("negative"),
    )


def _raw_csv(df, path: str, encoding: str = "UTF-8") -> str:
    """Lines as they are: a single column whose name is the header and whose values are the lines."""
    df.write.options(header=True, quote="", sep="\u0001", encoding=encoding).csv(path)
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders")
def csv_open_quote(spark, sf_dir):
    """A quote left open in every tenth line spoils no other line."""
    path = new_path(spark, "open") + ".csv"
    line = F.concat_ws(",", "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit('"'), "o_orderstatus")).otherwise(F.col("o_orderstatus")))
    _raw_csv(table(spark, sf_dir, "orders").select(line.alias("key,status")), path)
    return scan_csv(spark, path).select("key")


@query("""
    SELECT 'keep' AS mode, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END AS status
    FROM orders
    UNION ALL
    SELECT 'drop', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderkey % 3 = 0
""")
def csv_bad_rows(spark, sf_dir):
    """Short rows are filled and long ones cut, or both are dropped."""
    path = new_path(spark, "bad") + ".csv"
    status = F.when(F.col("o_orderkey") % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(","), "o_orderstatus"))
    line = F.concat(F.col("o_orderkey").cast("string"), status, F.when(F.col("o_orderkey") % 3 == 2, F.lit(",more")).otherwise(""))
    _raw_csv(table(spark, sf_dir, "orders").select(line.alias("key,status")), path)
    kept, dropped = scan_csv(spark, path), scan_csv(spark, path, bad_rows="drop")
    return kept.select(F.lit("keep").alias("mode"), "*").union(dropped.select(F.lit("drop"), "*"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"编号\", n_name || '国' AS \"国家\" FROM nation")
def csv_gbk(spark, sf_dir):
    """Names and values in another charset than UTF-8."""
    path = new_path(spark, "gbk") + ".csv"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    line = F.concat_ws(",", "n_nationkey", F.concat("n_name", F.lit("国")))
    _raw_csv(table(spark, sf_dir, "nation").select(line.alias("编号,国家")), path, "GBK")
    return scan_csv(spark, path, encoding="GBK")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, 'x' AS \"Unnamed_1\", r_name AS name, 'y' AS \"Unnamed_3\" FROM region")
def csv_blank_headers(spark, sf_dir):
    path = new_path(spark, "blank") + ".csv"
    line = F.concat_ws(",", "r_regionkey", F.lit("x"), "r_name", F.lit("y"))
    _raw_csv(table(spark, sf_dir, "region").select(line.alias("key,,name, ")), path)
    return scan_csv(spark, path)


def _folder(spark, sf_dir) -> str:
    """A folder with two tables, a lock file and a text file."""
    folder = new_path(spark, "folder")
    write_output(table(spark, sf_dir, "region"), f"{folder}/region.csv", file_format="csv")
    write_output(table(spark, sf_dir, "nation"), f"{folder}/nation.parquet")
    write_output(table(spark, sf_dir, "region"), f"{folder}/~$region.csv", file_format="csv")
    table(spark, sf_dir, "region").select("r_name").write.text(f"{folder}/notes.txt")
    return folder


@query("SELECT * FROM (VALUES ('nation.parquet', true), ('region.csv', true)) t(name, has_bytes)")
def list_files(spark, sf_dir):
    """Data tables of a folder; lock files and other files are not listed."""
    return list_data_files(spark, _folder(spark, sf_dir)).select("name", (F.col("length") > 0).alias("has_bytes"))


@query("""
    SELECT 'first' AS pick, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation
    UNION ALL SELECT 'named', CAST(r_regionkey AS BIGINT), r_name FROM region
""")
def scan_sheets(spark, sf_dir):
    """Sheets of a book by position (in name order) and by name."""
    book = _folder(spark, sf_dir)
    first, named = scan_sheet(spark, book, 0), scan_sheet(spark, book, "region")
    first = first.select(F.lit("first").alias("pick"), F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"))
    return first.union(named.select(F.lit("named"), F.col("r_regionkey").cast("bigint"), "r_name"))


@query("""
    SELECT letter, name, type, CASE WHEN name = 'o_orderstatus' THEN unfinished ELSE n END AS filled
    FROM (VALUES ('A', 'o_orderkey', 'bigint'), ('B', 'o_custkey', 'bigint'), ('C', 'o_orderstatus', 'string'),
        ('D', 'o_totalprice', 'double'), ('E', 'o_orderdate', 'timestamp_ntz'), ('F', 'o_orderpriority', 'string')) t(letter, name, type),
        (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS unfinished FROM orders)
""")
def column_letters(spark, sf_dir):
    """Letters, names and types of a table's columns, and how many rows have a value in each."""
    orders = table(spark, sf_dir, "orders")
    return list_columns(orders.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")), counted=True)


@query("SELECT p_partkey, trim(regexp_replace('* ' || p_name || ' / ' || p_type || ', 50%', '\\W+', '_', 'g'), '_') AS name FROM part")
def output_names(spark, sf_dir):
    """Names for folders, in full."""
    text = F.concat(F.lit("* "), "p_name", F.lit(" / "), "p_type", F.lit(", 50%"))
    return table(spark, sf_dir, "part").select("p_partkey", cleaned_output_names(text).alias("name"))


@query("""
    SELECT * FROM (VALUES ('master', 'done'), ('lookup:customer.parquet', 'done'), ('lookup:nation.parquet', 'done'),
        ('output:large orders', 'started'), ('output:large orders', 'done'), ('output:segments', 'started'),
        ('output:segments', 'done'), ('output:broken', 'started'), ('output:broken', 'FAIL'), ('job', 'done')) t(stage, status)
""")
def run_report(spark, sf_dir):
    """Every step is in the report; a literal that no column can hold fails its own output only."""
    spec = report_spec(sf_dir) | {"output": new_path(spark, "report"), "infer": False}
    broken = {"name": "broken", "filter_expr": {"col": "o_orderdate", "op": ">", "value": "not a day"}}
    return run_report_job(spark, spec | {"tasks": [*spec["tasks"], broken]}).select("stage", "status")


_POOL = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "cust_c_name", "cust_c_nationkey", "cust_c_mktsegment", "n_name"]


@query(
    "SELECT place, name, CASE WHEN name LIKE 'cust%' THEN met WHEN name = 'n_name' THEN placed ELSE n END AS filled FROM (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_POOL))
    + """) t(place, name), (SELECT count(*) AS n, count(c_custkey) AS met, count(n_nationkey) AS placed
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""
)
def pool_columns(spark, sf_dir):
    """Columns of the joined table, known without a job, and how many of its rows have a value in each."""
    spec = report_spec(sf_dir) | {"infer": False}
    known = spark.createDataFrame(list(enumerate(analyze_pool(spark, spec))), "place int, name string")
    pool = build_pool(spark, JobSpec.from_dict(spec | {"tasks": []}))
    return known.join(list_columns(pool, counted=True).select("name", "filled"), "name", "left").select("place", "name", "filled")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def rule_skipped(spark, sf_dir):
    """A rule that names a column its target lacks is left out, the next one is used."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer")
    rule = {"target": customer, "master_keys": "o_custkey", "target_keys": "c_custkey"}
    return link_tables(orders, [rule | {"pick": "c_nothing"}, rule | {"pick": "c_name"}], on_error="skip")


@query("""
    SELECT arguments, message, CAST(NULL AS BIGINT) AS groups FROM (VALUES ('no values', 'nothing to aggregate'),
        ('no keys', 'values need group or pivot columns'), ('key as value', 'keys cannot be values too: [''o_custkey'']'),
        ('unknown column', 'unknown columns: [''nowhere'']')) t(arguments, message)
    UNION ALL SELECT 'as meant', NULL, count(DISTINCT o_custkey) FROM orders
""")
def bad_arguments(spark, sf_dir):
    """What is said of arguments that cannot be meant, beside the groups that right ones give."""
    orders = table(spark, sf_dir, "orders")
    cases = {
        "no values": (["o_custkey"], {}), "no keys": ([], {"o_totalprice": "sum"}),
        "key as value": (["o_custkey"], {"o_custkey": "count"}), "unknown column": (["o_custkey"], {"nowhere": "sum"}),
        "as meant": (["o_custkey"], {"o_totalprice": "sum"}),
    }
    told = []
    for name, (keys, values) in cases.items():
        try:
            told.append((name, None, group_agg(orders, keys, values).count()))
        except ValueError as error:
            told.append((name, str(error), None))
    return spark.createDataFrame(told, "arguments string, message string, groups long")


@query("""
    SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_brand, p_partkey) - 1 AS place FROM part
""")
def sort_order(spark, sf_dir):
    """Every row's place in the written order of several keys, one descending."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ordered = sort_rows(part, [("p_size", False), ("p_brand", True), ("p_partkey", True)])
    return with_positions(ordered, "place").select("p_partkey", "place")


@query("""
    SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name) DESC NULLS LAST, p_partkey) - 1 AS place
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS p_name FROM part)
""")
def sort_order_ci(spark, sf_dir):
    """Mixed-case text sorts without regard to case; missing values come last, also when descending."""
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, mixed).alias("name"))
    return with_positions(sort_rows(part, [("name", False), ("p_partkey", True)]), "place").select("p_partkey", "place")


@query("""
    SELECT c_nationkey, o_custkey, 'amount' AS measure, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey
    UNION ALL
    SELECT c_nationkey, o_custkey, 'o_orderkey', CAST(count(*) AS DOUBLE)
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey
""")
def pivot_many_columns(spark, sf_dir):
    """A pivot whose keys are too many to be columns, in long form: no key is left out."""
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    pool = link_tables(orders, [{"target": customer, "master_keys": "o_custkey", "target_keys": "c_custkey", "pick": "c_nationkey", "unique": True}])
    return pivot_long(pool, ["c_nationkey"], ["o_custkey"], {"amount": "sum", "o_orderkey": "count"})


_PRESET = "`o_orderstatus` != 'F' and `o_orderpriority`.str.contains('URGENT|HIGH',na=False) or `o_orderkey`.isin([3,5,'7']) or `o_totalprice`>=100000 and `o_totalprice`<=150000"


@query("""
    SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
    WHERE (s IS DISTINCT FROM 'F' AND regexp_matches(o_orderpriority, 'URGENT|HIGH')) OR o_orderkey IN (3, 5, 7)
       OR (o_totalprice >= 100000 AND o_totalprice <= 150000)
""")
def preset_filters(spark, sf_dir):
    """A filter text as presets hold it; its != keeps rows without a value."""
    orders = table(spark, sf_dir, "orders")
    orders = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return P.filter_rows(orders, preset_filter(_PRESET)).select("o_orderkey")


@query("""
    SELECT p_brand, median(CAST(p_size AS DOUBLE) / 1e15 / (1 + p_partkey)) AS rate FROM part GROUP BY p_brand
""")
def group_agg_median_small_numbers(spark, sf_dir):
    """Medians of numbers far below one."""
    part = table(spark, sf_dir, "part")
    rate = F.col("p_size").cast("double") / 1e15 / (1 + F.col("p_partkey"))
    return group_agg(part.withColumn("rate", rate), ["p_brand"], {"rate": "median"})


@query("""
    SELECT o_orderpriority, median(epoch_us(o_orderdate)) AS middle, floor(avg(CAST(epoch_us(o_orderdate) AS HUGEINT))) AS mean FROM orders GROUP BY o_orderpriority
""")
def group_agg_median_dates(spark, sf_dir):
    """Medians and means of times, as microseconds since 1970 for comparison."""
    orders = table(spark, sf_dir, "orders").withColumn("mean", F.col("o_orderdate"))
    found = group_agg(orders, ["o_orderpriority"], {"o_orderdate": "median", "mean": "mean"})
    micros = [F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(c)).cast("double") for c in ("o_orderdate", "mean")]
    return found.select("o_orderpriority", micros[0].alias("middle"), micros[1].alias("mean"))


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS "ID", o_totalprice AS price FROM orders
    UNION ALL SELECT p_brand, p_retailprice FROM part
""")
def append_mixed_case(spark, sf_dir):
    """Names that differ in case are one column, with one type for both."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS ID", "o_totalprice AS price")
    part = table(spark, sf_dir, "part").selectExpr("p_brand AS id", "p_retailprice AS Price")
    return append_tables([orders, part])
