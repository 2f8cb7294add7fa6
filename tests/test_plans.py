"""What Spark makes of the operators: pruning, pushdown, skew handling, no Python workers."""

from contextlib import contextmanager

from pathlib import Path

import pytest

from reportloom.catalog import QUERIES
from reportloom.functions import formulas as X
from reportloom.operators import predicates as P
from reportloom.operators.combine import align_tables, append_tables
from reportloom.operators.lookup import link_tables, lookup_join, rows_not_in_table
from reportloom.operators.pivot import group_agg, pivot_table
from reportloom.plans import staging
from reportloom.plans.preset_formulas import preset_column
from reportloom.plans.session import configure

SF = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.fixture
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_filters_and_columns_reach_the_scan(lines, orders):
    linked = lookup_join(lines, orders, "l_orderkey", "o_orderkey", "o_custkey, o_orderdate")
    df = P.filter_rows(linked, P.all_of(P.gt("l_quantity", 10), P.eq("l_returnflag", "R")))
    plan = df.select("l_orderkey", "o_custkey")._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThan(l_quantity,10.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_unused_lookup_disappears(lines, orders):
    linked = lookup_join(lines, orders, "l_orderkey", "o_orderkey", "o_custkey")
    assert "Join" not in plan_of(linked.select("l_orderkey", "l_tax"))
    assert "Join" not in plan_of(group_agg(linked, ["l_returnflag"], {"l_tax": "sum"}))


def test_small_targets_are_broadcast_by_size_only(spark, lines, orders):
    def linked():
        return lookup_join(lines, orders, "l_orderkey", "o_orderkey", "o_custkey")

    assert "BroadcastHashJoin" in plan_of(linked())
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="1000"):
        assert "SortMergeJoin" in plan_of(linked()) and "Broadcast" not in plan_of(linked())


def skewed(spark):
    """60,000 rows, a third on one key and a sixth without a key."""
    return spark.range(60_000, numPartitions=12).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 6 = 1 THEN NULL ELSE id END AS k", "repeat('x', 50) AS pad"
    )


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "30KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@pytest.mark.parametrize("unique", [False, True])
def test_hot_main_keys_are_split(spark, unique):
    target = spark.range(0, 60_000, numPartitions=4).selectExpr("id AS k", "id * 2 AS v")
    target = target if unique else target.union(target.selectExpr("k", "v + 1 AS v"))
    with settings(spark, **SKEW):
        out = lookup_join(skewed(spark), target, "k", "k", "v", unique=unique)
        plan = plan_of(out, executed=True)
        assert "SortMergeJoin(skew=true)" in plan
        checked = out.selectExpr("count(*)", "count(v)", "count_if(v <> 2 * k)").first()
        assert tuple(checked) == (60_000, 50_000, 0)


def test_hot_keys_of_value_tables_are_split(spark):
    values = spark.range(100, 40_000, numPartitions=4).selectExpr("id AS v")
    with settings(spark, **SKEW):
        out = rows_not_in_table(skewed(spark), "k", values, "v")
        assert "SortMergeJoin(skew=true)" in plan_of(out, executed=True)
        expected = skewed(spark).where("k IS NULL OR k < 100 OR k >= 40000").count()
        assert out.count() == expected


def test_hot_keys_of_aligned_tables_are_split(spark):
    other = spark.range(100, 40_000, numPartitions=4).selectExpr("id AS k", "id AS w").union(
        spark.range(1).selectExpr("7 AS k", "7 AS w")
    )
    with settings(spark, **SKEW):
        out = align_tables([skewed(spark), other], ordered=False)
        assert plan_of(out, executed=True).count("SortMergeJoin(skew=true)") >= 2
        left = skewed(spark)
        alone = other.join(left, "k", "left_anti").count()
        assert tuple(out.selectExpr("count(*)", "count(id)", "count_if(w <> k)").first()) == (60_000 + alone, 60_000, 0)


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    for name in ("main_b", "target_b"):
        rows = spark.range(1_000).selectExpr("id AS k", f"id * 2 AS {name}_v")
        rows.write.bucketBy(4, "k").option("path", str(tmp_path / name)).saveAsTable(name)
    try:
        with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
            out = lookup_join(spark.table("main_b"), spark.table("target_b"), "k", "k", "target_b_v", unique=True)
            assert "SortMergeJoin" in plan_of(out) and "Exchange" not in plan_of(out)
    finally:
        for name in ("main_b", "target_b"):
            spark.sql(f"DROP TABLE {name}")


def test_two_lookups_by_one_key_shuffle_the_main_table_once(spark, lines, orders):
    rules = [
        {"target": orders, "master_keys": "l_orderkey", "target_keys": "o_orderkey", "pick": "o_custkey"},
        {"target": orders, "master_keys": "l_orderkey", "target_keys": "o_orderkey", "pick": "o_totalprice"},
    ]
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(link_tables(lines.select("l_orderkey", "l_tax"), rules))
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_aggregates_combine_before_the_shuffle(lines):
    plan = plan_of(group_agg(lines, ["l_returnflag"], {"l_quantity": "sum", "l_tax": "max"}))
    assert "partial_sum" in plan and plan.count("Exchange") == 1


def test_pivot_scans_the_source_once(lines):
    found = plan_of(pivot_table(lines, ["l_returnflag"], ["l_linestatus"], {"l_quantity": "sum"}))
    assert "lineitem" not in found and "reportloom-pivot" in found
    given = plan_of(pivot_table(lines, ["l_returnflag"], ["l_linestatus"], {"l_quantity": "sum"}, ["F"]))
    assert given.count("FileScan") == 1 and "l_linestatus" in given.split("PushedFilters: [")[1].split("]")[0]
    assert given.count("Exchange hashpartitioning") == 2


def test_number_conversion_tests_text_only(lines):
    plan = plan_of(lines.select(X.to_float("l_quantity").alias("a"), X.to_float("l_linenumber").alias("b")))
    assert "RLIKE" not in plan and "typeof" not in plan
    assert "RLIKE" not in plan_of(lines.select(X.year("l_shipdate").alias("y")))
    plan = plan_of(lines.select(X.to_float("l_returnflag").alias("a")))
    assert plan.count("RLIKE") == 1 and "typeof" not in plan


def test_formulas_spare_patterns_clock_times_and_decimals(spark, lines):
    made = [X.has_text("l_returnflag", "URGENT"), X.days_apart("l_shipdate", "l_shipdate"), preset_column(lines, "round(df['l_tax'], 0)")]
    plan = plan_of(lines.select([c.alias(f"c{i}") for i, c in enumerate(made)])).lower()
    assert not [name for name in ("rlike", "timestampdiff", "bround") if name in plan]
    # A pattern stays one.
    assert "RLIKE" in plan_of(lines.select(X.has_text("l_returnflag", "U.*").alias("c")))


def test_formulas_of_a_wide_preset_are_no_single_method(spark):
    # The JVM compiles no method of more than 8,000 bytes and puts nothing into one near that.
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 5000


def test_append_prunes_each_side(spark, lines):
    df = append_tables([lines, lines]).select("l_tax")
    assert plan_of(df).count("ReadSchema: struct<l_tax:double>") == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_leaves_the_jvm_or_crosses_tables(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "CollectLimit"):
        assert word not in plan


def test_staging_follows_the_session_setting(spark, tmp_path):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    settled = staging.settle(spark.range(5).selectExpr("id", "CAST(NULL AS string) AS `odd name`"))
    assert settled.columns == ["id", "odd name"] and settled.count() == 5
    assert folder in settled.inputFiles()[0]
    with staging.dropped_afterwards(spark):
        path = staging.settle(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists() and settled.count() == 5


def test_long_lists_are_joined_and_not_written_into_the_plan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    keys = list(range(0, 40_000, 2))
    out = P.filter_rows(orders, P.any_of(P.is_in("o_custkey", keys), P.gt("o_totalprice", 400_000)))
    plan = plan_of(out)
    assert "LeftOuter" in plan and len(plan) < 10_000
    wanted = orders.where("o_custkey % 2 = 0 AND o_custkey < 40000 OR o_totalprice > 400000")
    assert out.count() == wanted.count()


@pytest.mark.parametrize("name", ["filter_in_list_or", "filter_not_in_list_null"])
def test_tables_in_conditions_split_a_hot_key(spark, name):
    """The marks come by joins of two plain exchanges, which AQE can split where one key swells a partition."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "LeftOuter" in plan and "BatchEvalPython" not in plan


def records_shuffled(df):
    """Rows written to the shuffles of an executed plan."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += plan.metrics().apply("shuffleRecordsWritten").value()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_pruning_shrinks_the_shuffle_of_the_target(spark):
    some = spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey % 50 = 7").select("o_orderkey")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines = lines.union(lines)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        made = {p: lookup_join(some, lines, "o_orderkey", "l_orderkey", "l_shipdate", prune=p) for p in (False, True)}
        plain, pruned = records_shuffled(made[False]), records_shuffled(made[True])
    assert pruned < plain / 4
    assert sorted(made[False].collect()) == sorted(made[True].collect())


def test_a_chain_shuffles_the_main_table_once(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        out = QUERIES["lookup_chain_contracted"](spark, SF)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
        executed = plan_of(out, executed=True)
    # The lines meet two tables, one for each chain: all other joins are between targets.
    top = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(top) == 6 and "skew=" not in plan and "lineitem" in executed
    assert out.count() == lines
    with_lines = [line for line in top if "l_orderkey" in line.split("[")[1] or "l_suppkey" in line.split("[")[1]]
    assert len(with_lines) == 2
