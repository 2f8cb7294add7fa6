import json

import pytest

from reportloom.plans.job import Journal, analyze_pool, build_outputs, output_paths, run_report_job
from reportloom.plans.spec import JobSpec, OutputTask


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "lines.csv").write_text(
        "dept,planner,year,qty,day\nA,ann,2023,1.5,2023-01-02\nA,ann,2024,2,2024/1/3\n"
        "B,bob,2023,4,2023-02-01\nB,cid,2024,,2024-02-02\nC,,2023,8,\n"
    )
    (tmp_path / "people.csv").write_text("name,city,qty\nann,Oslo,9\nbob,Bergen,9\nann,Arendal,9\n")
    return tmp_path


def spec_of(files, **more):
    return {
        "master": {"path": f"{files}/lines.csv"},
        "rules": [
            {"target_path": f"{files}/people.csv", "master_keys": "B", "target_keys": "name",
             "pick_cols": "city + qty", "col_prefix": "", "by_letter": True},
            {"target_path": f"{files}/gone.csv", "master_keys": "B", "target_keys": "name", "pick_cols": "x"},
        ],
        "tasks": [
            {"name": "by dept",
             "pivot_cfg": {"enabled": True, "group_by": ["dept"], "pivot_cols": ["year"],
                           "values_agg": {"qty": "sum"}, "renames": {"qty": "units"}}},
            {"name": "detail",
             "calc_fields": [["double", "qty * 2"], ["bad", "nowhere + 1"], "note"],
             "filter_expr": {"col": "city", "op": "!=", "value": "Bergen"},
             "col_map": [{"src": "planner", "dst": "who"}, {"src": "city", "dst": "town"},
                         {"src": "double", "dst": "twice"}, {"src": "day", "dst": "day"},
                         {"src": "nothing", "dst": "empty"}],
             "sort_config": [{"col": "who", "asc": False}, {"col": "gone", "asc": True}]},
            {"name": "broken", "filter_expr": {"col": "city", "op": "<", "value": 5}},
        ],
        "output": f"{files}/out",
    } | more


def test_job_writes_outputs_and_reports_failures(spark, files):
    spec = json.loads(json.dumps(spec_of(files)))
    report = run_report_job(spark, spec)
    seen = [(r.stage, r.status) for r in report.collect()]
    assert ("lookup:people.csv", "done") in seen and ("lookup:gone.csv", "FAIL") in seen
    assert ("derive:detail", "FAIL") in seen
    assert ("output:by dept", "done") in seen and ("output:detail", "done") in seen
    assert ("output:broken", "FAIL") in seen and seen[-1] == ("job", "done")
    details = {r.stage: r.detail for r in report.collect()}
    assert details["output:detail"] == "rows=4 columns=5"
    assert "qty_dup=bigint" in details["types"] and "day=timestamp_ntz" in details["types"]

    by_dept = spark.read.parquet(f"{files}/out/by_dept")
    assert by_dept.columns == ["dept", "units_2023", "units_2024"]
    assert [tuple(r) for r in by_dept.collect()] == [("A", 1.5, 2.0), ("B", 4.0, 0.0), ("C", 8.0, 0.0)]
    detail = spark.read.parquet(f"{files}/out/detail")
    assert detail.columns == ["who", "town", "twice", "day", "empty"]
    found = [(r.who, r.town, r.twice) for r in detail.collect()]
    assert found[0] == ("cid", None, None) and found[-1] == (None, None, 16.0)
    assert {r[1] for r in found[1:3]} == {"Arendal"}
    assert spark.read.parquet(f"{files}/out/run_report").count() == len(seen)


@pytest.mark.parametrize("more", [{"share_pool": True}, {"numbered_sheets": True, "max_rows": 2}, {"file_format": "csv"}])
def test_other_ways_of_writing_hold_the_same_rows(spark, files, more):
    spec = spec_of(files, **more)
    run_report_job(spark, spec)
    path = f"{files}/out/detail"
    back = spark.read.csv(path, header=True) if more.get("file_format") else spark.read.parquet(path)
    assert back.count() == 4


def test_build_outputs_raises_instead(spark, files):
    with pytest.raises(Exception, match="gone.csv"):
        build_outputs(spark, spec_of(files))
    spec = spec_of(files)
    spec["rules"].pop()
    spec["tasks"] = spec["tasks"][:1]
    out = build_outputs(spark, spec)
    assert list(out) == ["by dept"] and out["by dept"].count() == 3


def test_master_from_folder_and_sheets(spark, files):
    (files / "in").mkdir()
    for name, text in (("a", "x,y\n1,2\n"), ("b", "y,x\n4,3\n"), ("c", "x\n9\n")):
        (files / "in" / f"{name}.csv").write_text(text)
    task = {"name": "all"}
    merged = {"master": {"path": f"{files}/in", "folder": True, "columns": ["x", "y"]}, "tasks": [task]}
    assert rows(build_outputs(spark, merged)["all"]) == [(1, 2), (3, 4)]
    run_report_job(spark, merged | {"output": f"{files}/merged"})
    report = spark.read.parquet(f"{files}/merged/run_report")
    assert report.where("stage = 'skip:c.csv' AND detail = 'lacks y'").count() == 1
    sheets = {"master": {"path": f"{files}/in", "sheet": ["a", 1]}, "tasks": [task]}
    assert rows(build_outputs(spark, sheets)["all"]) == [(1, 2), (3, 4)]
    aligned = {"master": {"path": f"{files}/in", "sheet": ["a", "c"], "combine": "align"}, "tasks": [task]}
    assert rows(build_outputs(spark, aligned)["all"]) == rows(spark.createDataFrame([(1, 2), (9, None)], "a long, b long"))
    one = {"master": {"path": f"{files}/in", "sheet": "b", "columns": ["x"]}, "tasks": [task]}
    assert rows(build_outputs(spark, one)["all"]) == [(3,)]


def test_fatal_errors_are_reported_too(spark, files):
    spec = spec_of(files)
    spec["master"]["path"] = f"{files}/none.csv"
    with pytest.raises(Exception):
        run_report_job(spark, spec)
    report = spark.read.parquet(f"{files}/out/run_report")
    assert [tuple(r) for r in report.select("stage", "status").collect()] == [("job", "FAIL")]


def test_specification_round_trip(files):
    spec = JobSpec.from_dict(spec_of(files))
    again = JobSpec.from_dict(json.loads(json.dumps(spec.to_dict())))
    assert again == spec
    assert OutputTask.from_dict({"name": "x", "pivot_cfg": {"enabled": True}}).pivot_cfg.values_agg == {}
    with pytest.raises(ValueError, match="has no"):
        OutputTask.from_dict({"name": "x", "sorting": []})


def test_presets_and_rename_text(spark, files):
    spec = spec_of(files)
    spec["rules"].pop()
    task = spec["tasks"][0]
    task["pivot_cfg"]["renames"] = "qty=units; 2023 = last"
    preset = {
        "master": f"{files}/lines.csv", "master_sheet": 0, "master_is_folder": False,
        "master_schema_cols": ["dept", "planner", "qty", "year"], "output": "",
        "folder_sheet": 0, "rules": spec["rules"], "tasks": [task | {"calc_fields": ""}],
    }
    loaded = JobSpec.from_preset(preset)
    assert analyze_pool(spark, loaded) == ["dept", "planner", "qty", "year", "city", "qty_dup"]
    assert loaded.tasks[0].pivot_cfg.renames == {"qty": "units", "2023": "last"}
    out = build_outputs(spark, loaded)["by dept"]
    # Every pair is read against the original names; where two hit one column the later counts.
    assert out.columns == ["dept", "qty_last", "units_2024"]
    folder = JobSpec.from_preset(preset | {"master": str(files), "master_is_folder": True})
    assert folder.master.folder and folder.master.sheet == 0
    with pytest.raises(ValueError, match="os.system"):
        JobSpec.from_preset(preset | {"tasks": [task | {"calc_fields": "x = os.system('ls')"}]})


def test_formulas_of_presets_run_in_a_job(spark, files):
    spec = spec_of(files)
    spec["rules"].pop()
    formulas = "double = df['qty'] * 2；label = np.where(df['double'] > 10, 'many', 'few')\nbad = df['dept'] * 2, note"
    task = {"name": "t", "calc_fields": formulas, "filter_expr": "`double`>0", "col_map": [{"src": c, "dst": c} for c in ("qty", "double", "label", "bad", "note")]}
    preset = {"master": f"{files}/lines.csv", "rules": spec["rules"], "tasks": [task], "output": f"{files}/presets"}
    loaded = JobSpec.from_preset(preset)
    assert JobSpec.from_dict(json.loads(json.dumps(loaded.to_dict()))) == loaded
    with pytest.raises(TypeError, match="dept"):
        build_outputs(spark, loaded)
    report = {r.stage: r.status for r in run_report_job(spark, loaded).collect()}
    assert report["derive:t"] == "FAIL" and report["output:t"] == "done"
    out = spark.read.parquet(f"{files}/presets/t").collect()
    assert out and all(r.double == 2 * r.qty and r.label == ("many" if r.double > 10 else "few") for r in out)
    assert all(r.bad == "" and r.note is None for r in out)


def test_colliding_names_are_an_error(files):
    spec = JobSpec.from_dict(spec_of(files))
    spec.tasks.append(OutputTask("by/dept"))
    with pytest.raises(ValueError, match="used twice"):
        output_paths(spec)
    spec.tasks[-1].name = "run report"
    with pytest.raises(ValueError, match="used twice"):
        output_paths(spec)


def test_report_details_are_kept_in_full(spark):
    report = Journal()
    report.note("s", "done", "x" * 6_000)
    assert len(report.table(spark).first().detail) == 6_000
