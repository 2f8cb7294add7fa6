import os
import time

import pytest

from reportloom.sources.folders import merge_folder, skipped_table
from reportloom.sources.listing import list_children, list_data_files, template_of
from reportloom.sources.outputs import convert_folder, convert_table, write_output
from reportloom.sources.tables import list_sheets, scan_csv, scan_sheet, scan_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, data, age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    moment = time.time() - age
    os.utime(path, (moment, moment))


def test_csv_is_text_and_ragged_rows_are_kept_or_dropped(spark, tmp_path):
    put(tmp_path / "t.csv", 'id,name,,note\n007,"a, ""b""",1,""\n1,short\n2,x,y,z,extra\n')
    path = str(tmp_path / "t.csv")
    df = scan_csv(spark, path)
    assert df.dtypes == [("id", "string"), ("name", "string"), ("Unnamed_2", "string"), ("note", "string")]
    assert rows(df) == [("007", 'a, "b"', "1", ""), ("1", "short", None, None), ("2", "x", "y", "z")]
    assert rows(scan_csv(spark, path, bad_rows="drop")) == [("007", 'a, "b"', "1", "")]
    assert scan_csv(spark, path, ["note", "nope", "id"]).columns == ["note", "id"]
    assert scan_table(spark, path).count() == 3


def test_line_breaks_inside_quotes(spark, tmp_path):
    put(tmp_path / "d.csv" / "a.csv", 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    put(tmp_path / "d.csv" / "b.csv", 'id,note\n3,"one ""line"""\n')
    path = str(tmp_path / "d.csv")
    expected = [("1", 'two\nlines, "quoted"'), ("2", "plain"), ("3", 'one "line"')]
    assert rows(scan_csv(spark, path, multiline=True)) == expected
    assert scan_csv(spark, path).count() == 4
    df, _ = merge_folder(spark, path, multiline=True)
    assert rows(df) == expected


def test_gbk(spark, tmp_path):
    put(tmp_path / "g.csv", "编号,城市\n1,北京\n2,上海\n".encode("gbk"))
    df = scan_table(spark, str(tmp_path / "g.csv"), encoding="GBK")
    assert df.columns == ["编号", "城市"]
    assert rows(df) == [("1", "北京"), ("2", "上海")]


def test_parquet_keeps_types_and_misses_loudly(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "x", 2.0)], "a bigint, b string, c double").write.parquet(path)
    assert scan_table(spark, path, ["c", "a"]).dtypes == [("c", "double"), ("a", "bigint")]
    with pytest.raises(Exception, match="nope"):
        scan_table(spark, path, ["nope"])
    with pytest.raises(ValueError, match="not decoded"):
        scan_table(spark, str(tmp_path / "book.xlsx"))


def test_sheets_of_a_book(spark, tmp_path):
    book = tmp_path / "book"
    put(book / "beta.csv", "x\n2\n")
    put(book / "alpha.csv", "x,y\n1,7\n")
    spark.range(3).write.parquet(str(book / "gamma.parquet"))
    assert list_sheets(spark, str(book)) == ["alpha", "beta", "gamma"]
    assert rows(scan_sheet(spark, str(book), 1)) == [("2",)]
    assert rows(scan_sheet(spark, str(book), "alpha", ["y", "no"])) == [("7",)]
    assert scan_sheet(spark, str(book), "gamma").count() == 3
    for bad in (3, -1, "delta"):
        with pytest.raises(ValueError, match="no sheet"):
            scan_sheet(spark, str(book), bad)


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "in folder"
    put(root / "old.csv", "a,b,c\n1,2,3\n", age=300)
    put(root / "turned.csv", "b,a\n20,10\n", age=200)
    put(root / "lacking.csv", "a,z\n5,5\n", age=150)
    put(root / "~$old.csv", "a,b\n9,9\n", age=140)
    put(root / "readme.txt", "a,b\n9,9\n", age=130)
    put(root / "broken.parquet", "this is no parquet file", age=120)
    put(root / "book.xlsx", "binary", age=110)
    spark.createDataFrame([(100, "200", 1)], "a int, b string, more int").write.parquet(str(root / "typed.parquet"))
    put(root / "sheets" / "one.csv", "a,b\n7,8\n", age=90)
    put(root / "sheets" / "two.csv", "a,b\n77,88\n", age=90)
    put(root / "new.csv", "a,b\n3,4\n", age=-60)
    return str(root)


def test_listing(spark, folder):
    names = [c.name for c in list_children(spark, folder)]
    assert names[0] == "old.csv" and names[-1] == "new.csv"
    assert set(names) == {"old.csv", "turned.csv", "lacking.csv", "broken.parquet", "book.xlsx", "typed.parquet", "new.csv"}
    assert template_of(list_children(spark, folder)).name == "new.csv"
    listed = list_data_files(spark, folder).collect()
    assert [r.name for r in listed] == names and listed[0].length == 12


def test_folder_merge(spark, folder):
    df, skipped = merge_folder(spark, folder)
    assert df.columns == ["a", "b"]
    assert rows(df) == [("1", "2"), ("10", "20"), ("100", "200"), ("3", "4"), ("7", "8")]
    reasons = dict(skipped)
    assert set(reasons) == {"lacking.csv", "broken.parquet", "book.xlsx"}
    assert reasons["lacking.csv"] == "lacks b"
    assert skipped_table(spark, skipped).count() == 3
    df, skipped = merge_folder(spark, folder, ["z"])
    assert rows(df) == [("5",)] and len(skipped) == 7
    df, _ = merge_folder(spark, folder, ["b", "a"], sheet="two")
    assert ("88", "77") in rows(df)
    with pytest.raises(ValueError, match="has the columns"):
        merge_folder(spark, folder, ["nowhere"])


def test_empty_and_missing_folders(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no data files"):
        merge_folder(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no folder"):
        merge_folder(spark, str(tmp_path / "missing"))


def test_output_is_split_at_the_row_cap(spark, tmp_path):
    out = tmp_path / "capped"
    assert write_output(spark.range(25).coalesce(1), str(out), max_rows=10) == 25
    sizes = sorted(spark.read.parquet(str(f)).count() for f in out.glob("part-*.parquet"))
    assert sizes == [5, 10, 10]
    assert spark.read.parquet(str(out)).count() == 25


def test_numbered_sheets_keep_the_global_order(spark, tmp_path):
    out = tmp_path / "numbered"
    df = spark.range(1_000, numPartitions=7).selectExpr("id", "(id * 7919) % 1000 AS k").orderBy("k")
    assert write_output(df, str(out), max_rows=300, numbered_sheets=True) == 1_000
    back = spark.read.parquet(str(out))
    assert back.columns == ["id", "k", "sheet_no"]
    spans = back.groupBy("sheet_no").agg({"k": "min", "id": "count"}).orderBy("sheet_no").collect()
    assert [tuple(r) for r in spans] == [(1, 0, 300), (2, 300, 300), (3, 600, 300), (4, 900, 100)]
    first = [r.k for r in spark.read.parquet(str(out / "sheet_no=1")).collect()]
    assert first == list(range(300))


def test_empty_results_are_written_and_counted(spark, tmp_path):
    nothing = spark.range(10).where("false")
    sorted_nothing = spark.range(10).where("id > 100").orderBy("id")
    assert write_output(nothing, str(tmp_path / "a")) == 0
    assert write_output(sorted_nothing, str(tmp_path / "b")) == 0
    assert write_output(sorted_nothing, str(tmp_path / "c"), numbered_sheets=True) == 0
    assert spark.read.parquet(str(tmp_path / "a")).count() == 0


def test_csv_output_reads_back(spark, tmp_path):
    out = str(tmp_path / "o.csv")
    write_output(spark.createDataFrame([(1, "x,y")], "a int, b string"), out, file_format="csv")
    assert rows(scan_table(spark, out)) == [("1", "x,y")]


def test_converting_tables_and_sheets(spark, tmp_path):
    put(tmp_path / "t.csv", "a\n1\n2\n")
    put(tmp_path / "book" / "x.csv", "a\n1\n")
    put(tmp_path / "book" / "y.csv", "a\n5\n6\n7\n")
    dst = str(tmp_path / "out")
    report = convert_table(spark, str(tmp_path / "t.csv"), dst)
    assert rows(report) == [("t.parquet", True, 2, "")]
    report = convert_table(spark, str(tmp_path / "book"), dst, ["y", 0, 9])
    found = {r.file: (r.ok, r.rows) for r in report.collect()}
    assert found == {"book_9.parquet": (False, None), "book_y.parquet": (True, 3), "book_x.parquet": (True, 1)}
    assert rows(scan_table(spark, f"{dst}/book_x.parquet")) == [("1",)]


@pytest.mark.parametrize(
    "sheets, expected",
    [
        ("ALL", {"t.parquet": 1, "book_x.parquet": 1, "book_y.parquet": 2, "solo.parquet": 1}),
        (0, {"t.parquet": 1, "book.parquet": 1, "solo.parquet": 1}),
        (5, {"t.parquet": 1, "book.parquet": 2, "solo.parquet": 1}),
        ("y", {"t.parquet": 1, "book.parquet": 2, "solo": None}),
    ],
)
def test_converting_a_folder(spark, tmp_path, sheets, expected):
    src, dst = tmp_path / "src", str(tmp_path / "dst")
    put(src / "t.csv", "a\n1\n")
    put(src / "book" / "x.csv", "a\n1\n")
    put(src / "book" / "y.csv", "a\n5\n6\n")
    put(src / "solo" / "x.csv", "a\n1\n")
    spark.range(2).write.parquet(str(src / "done.parquet"))
    put(src / "bad.xlsx", "binary")
    report = {r.file: (r.ok, r.rows) for r in convert_folder(spark, str(src), dst, sheets).collect()}
    assert report.pop("bad.xlsx") == (False, None)
    assert report == {name: (n is not None, n) for name, n in expected.items()}


def started_jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_many_files_are_converted_together(spark, tmp_path):
    src = tmp_path / "many files"
    headers = ["a,b", "b,a", 'a,"b, ""c"""']
    expected = {}

    def write(folder, count):
        for k in range(count):
            lines = [f"{k},{j}" for j in range(k % 4)]
            put(folder / f"t {k}.csv", "\n" * (k % 2) + "\n".join([headers[k % 3], *lines]) + "\n")
            expected[f"t {k}.parquet"] = (True, len(lines))

    write(src, 12)
    put(src / "twice.csv", "a,a\n1,2\n")
    put(src / "twice too.csv", "a,a\n1,2\n")
    spark.createDataFrame([("1", "2")] * 5, "a string, b string").repartition(3).write.option("header", True).csv(str(src / "parts.csv"))
    spark.createDataFrame([("1", "2")] * 7, "a string, b string").repartition(2).write.option("header", True).csv(str(src / "more.csv"))
    dst = str(tmp_path / "dst")
    report = {r.file: (r.ok, r.rows) for r in convert_folder(spark, str(src), dst).collect()}
    assert report["parts.parquet"] == (True, 5) and report["more.parquet"] == (True, 7)
    assert report["twice.parquet"] == report["twice too.parquet"] == (True, 1)
    assert {name: report[name] for name in expected} == expected
    for k in range(12):
        back = scan_table(spark, f"{dst}/t {k}.parquet")
        assert back.columns == [["a", "b"], ["b", "a"], ["a", 'b, "c"']][k % 3]
        assert rows(back) == sorted((str(k), str(j)) for j in range(k % 4))
    assert sorted(p.name for p in (tmp_path / "dst").iterdir() if p.name.startswith(".")) == []
    again = {r.file: r.ok for r in convert_folder(spark, str(src), dst, mode="errorifexists").collect()}
    assert not any(again.values())

    jobs = []
    # Spark lists more than 32 paths by a job, so both folders have more of each header, a quarter of them without rows.
    for count in (144, 288):
        write(tmp_path / f"n{count}", count)
        before = started_jobs(spark)
        assert convert_folder(spark, str(tmp_path / f"n{count}"), str(tmp_path / f"d{count}")).count() == count
        df, _ = merge_folder(spark, str(tmp_path / f"n{count}"), ["a"])
        jobs.append(started_jobs(spark) - before)
    assert jobs[0] == jobs[1] < 40


def test_headers_of_long_tables(spark, tmp_path, monkeypatch):
    from reportloom.sources import headers

    monkeypatch.setattr(headers, "WHOLE", 100)
    for k in range(4):
        put(tmp_path / f"long{k}.csv", f"a,b{k % 2}\n" + "1,2\n" * 50_000)
    put(tmp_path / "short.csv", "a,c\n1,2\n")
    put(tmp_path / "blank.csv", "\n \n")
    children = list_children(spark, str(tmp_path))
    found = {path.rsplit("/", 1)[1]: names for path, names in headers.csv_headers(spark, children).items()}
    assert found.pop("blank.csv") == []
    assert found == {"long0.csv": ["a", "b0"], "long1.csv": ["a", "b1"], "long2.csv": ["a", "b0"], "long3.csv": ["a", "b1"], "short.csv": ["a", "c"]}
