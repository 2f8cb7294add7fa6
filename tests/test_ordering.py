from reportloom.operators.ordering import sort_rows


def test_case_insensitive_with_missing_last_both_ways(spark):
    data = [("b", 1.0), ("A", 2.0), (None, 3.0), ("a", 1.0), ("B", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "s string, d double").repartition(4)
    up = [r.s for r in sort_rows(df, [("s", True)]).collect()]
    assert [s and s.lower() for s in up] == ["a", "a", "b", "b", "c", None]
    down = [r.s for r in sort_rows(df, [("s", False)]).collect()]
    assert [s and s.lower() for s in down] == ["c", "b", "b", "a", "a", None]
    for ascending, first in ((True, [1.0, 1.0, 2.0, 3.0]), (False, [3.0, 2.0, 1.0, 1.0])):
        found = [r.d for r in sort_rows(df, [{"col": "d", "asc": ascending}]).collect()]
        assert found[:4] == first
        assert all(d is None or d != d for d in found[4:])


def test_several_keys_and_unknown_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, "X"), (3, "a")], "n int, s string").repartition(3)
    out = sort_rows(df, [("s", True), ("nope", True), ("n", False)])
    assert [r.n for r in out.collect()] == [3, 2, 1]
    assert sort_rows(df, [("nope", True)]) is df


def test_ties_spread_over_tasks(spark):
    """Rows that share one sort value must not all land in one task."""
    df = spark.range(20_000, numPartitions=8).selectExpr("id", "'same' AS s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sort_rows(df, [("s", True)]).selectExpr("spark_partition_id() AS p").groupBy("p").count()
        sizes = [r["count"] for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
