"""The report job: read, link, infer, then derive, filter, shape, sort and write each output."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from reportloom.operators.columns import clean_output_name, keep_columns, project_detail
from reportloom.operators.combine import align_tables, append_tables
from reportloom.operators.derive import derive
from reportloom.operators.infer import apply_types, infer_schema
from reportloom.operators.lookup import link_tables
from reportloom.operators.ordering import sort_rows
from reportloom.operators.pivot import pivot_table
from reportloom.operators.predicates import filter_rows
from reportloom.plans.errors import STEP_ERRORS, reason
from reportloom.plans.preset_formulas import preset_column
from reportloom.plans.session import configure
from reportloom.plans.spec import JobSpec, LookupRule, OutputTask, Source
from reportloom.plans.staging import collecting, dropped_afterwards, settle
from reportloom.sources.folders import merge_folder
from reportloom.sources.listing import list_children
from reportloom.sources.outputs import write_output
from reportloom.sources.tables import scan_sheet, scan_table

REPORT_NAME = "run_report"
_OUTPUTS_AT_ONCE = 4
REPORT_COLUMNS = "time timestamp, stage string, status string, detail string"


@dataclass(frozen=True)
class Step:
    """One entry of a run's journal, kept in full."""

    time: datetime
    stage: str
    status: str
    detail: str


class Journal(list[Step]):
    """What a run did, step by step, in order."""

    def note(self, stage: str, status: str, detail: object = "") -> None:
        self.append(Step(datetime.now(), stage, status, str(detail)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(step) for step in self], REPORT_COLUMNS)


def _csv_options(source: Source | LookupRule) -> dict:
    return {"encoding": source.encoding, "bad_rows": source.bad_rows, "multiline": source.multiline}


def _is_folder_of_tables(spark: SparkSession, path: str) -> bool:
    """Whether a path without a data ending holds tables by name rather than one table's part files."""
    if path.rstrip("/").lower().endswith((".csv", ".parquet", ".xlsx", ".xls")):
        return False
    names = [child.name for child in list_children(spark, path)]
    return any(not name.startswith(("part-", "_", ".")) for name in names)


def read_master(spark: SparkSession, source: Source, report: Journal | None = None) -> DataFrame:
    """The main table of a job."""
    options = _csv_options(source)
    if source.folder or (source.sheet is None and _is_folder_of_tables(spark, source.path)):
        sheet = 0 if source.sheet is None else source.sheet
        df, skipped = merge_folder(spark, source.path, source.columns, sheet, **options)
        for name, said in skipped if report is not None else ():
            report.note(f"skip:{name}", "skipped", said)
        return df
    if isinstance(source.sheet, list) and len(source.sheet) > 1:
        if source.combine not in ("append", "align"):
            raise ValueError(f"combine is 'append' or 'align', not {source.combine!r}")
        sheets = [scan_sheet(spark, source.path, s, source.columns, **options) for s in source.sheet]
        df = append_tables(sheets) if source.combine == "append" else align_tables(sheets, ordered=False)
    elif source.sheet is not None:
        sheet = source.sheet[0] if isinstance(source.sheet, list) else source.sheet
        df = scan_sheet(spark, source.path, sheet, source.columns, **options)
    else:
        df = scan_table(spark, source.path, **options)
    return keep_columns(df, source.columns) if source.columns else df


def _target(spark: SparkSession, rule: LookupRule) -> Callable[[], DataFrame]:
    def read() -> DataFrame:
        if rule.sheet_idx is None or rule.target_path.lower().endswith((".csv", ".parquet")):
            return scan_table(spark, rule.target_path, **_csv_options(rule))
        return scan_sheet(spark, rule.target_path, rule.sheet_idx, **_csv_options(rule))

    return read


def used_columns(columns: Sequence[str], tasks: Sequence[OutputTask]) -> list[str]:
    """Columns that some output may refer to: all, where an output has no list of its own or a formula cannot be read."""
    used: set[str] = set()
    for task in tasks:
        formulas = [item if isinstance(item, str) else item[1] for item in task.calc_fields]
        pivot = task.pivot_cfg
        if not (pivot.enabled or task.col_map) or any(isinstance(f, Column) for f in formulas):
            return list(columns)
        named = [pivot.group_by, pivot.pivot_cols, list(pivot.values_agg), pivot.order_by, task.sort_config, task.col_map]
        said = json.dumps([formulas, task.filter_expr, *named], ensure_ascii=False, default=str).lower()
        used |= {c for c in columns if json.dumps(c, ensure_ascii=False)[1:-1].lower() in said}
    return [c for c in columns if c in used]


def build_pool(
    spark: SparkSession, spec: JobSpec, report: Journal | None = None, on_error="raise", planning: bool = False
) -> DataFrame:
    """Main table with all lookups and inferred types, as far as the outputs use its columns.

    Lazy but for the inference counts, and for the pool's own table where several read it; ``planning`` does without both.
    """
    pool = read_master(spark, spec.master, report)
    if report is not None:
        report.note("master", "done", f"columns={len(pool.columns)}")
    rules = [
        {
            "target": _target(spark, rule),
            "label": rule.target_path,
            "master_keys": rule.master_keys,
            "target_keys": rule.target_keys,
            "pick": rule.pick_cols,
            "prefix": rule.col_prefix,
            "order_by": rule.order_by,
            "by_letter": rule.by_letter,
            "unique": rule.unique,
            # Counting the main keys takes a job, which planning does without.
            "prune": rule.prune and not planning,
        }
        for rule in spec.rules
    ]

    def note(rule: dict, error: Exception | None, picks: int) -> None:
        if report is not None:
            stage = f"lookup:{rule['label'].rstrip('/').rsplit('/', 1)[-1]}"
            report.note(stage, "FAIL" if error else "done", reason(error) if error else f"picked={picks}")

    pool = link_tables(pool, rules, on_error, note)
    infers = spec.types is None and spec.infer
    pool = keep_columns(pool, used_columns(pool.columns, spec.tasks)) if spec.tasks else pool
    # Inference and every output read the pool: with lookups in it, it is written once for all of them.
    if spec.share_pool or (spec.rules and infers + len(spec.tasks) > 1 and not planning):
        pool = settle(pool, "pool")
    if spec.types is not None:
        return apply_types(pool, spec.types)
    if spec.infer:
        types = infer_schema(pool, spec.keep_text)
        pool = apply_types(pool, types)
        if report is not None:
            report.note("types", "done", ", ".join(f"{c}={t}" for c, t in types.items()))
    return pool


def analyze_pool(spark: SparkSession, spec: JobSpec | dict) -> list[str]:
    """Names of the joined table's columns. Headers are read, data is not."""
    spec = JobSpec.from_dict(spec) if isinstance(spec, dict) else spec
    bare = replace(spec, infer=False, types=None, share_pool=False, tasks=[])
    return build_pool(spark, bare, planning=True).columns


def build_output(pool: DataFrame, task: OutputTask, report: Journal | None = None) -> DataFrame:
    """One output of the joined table, as a lazy plan (but for unknown pivot values)."""
    df = pool
    for item in task.calc_fields:
        name, formula = (item, None) if isinstance(item, str) else item
        try:
            if isinstance(formula, dict):
                formula = preset_column(df, formula["preset"])
            df = derive(df, [(name, formula)])
        except STEP_ERRORS as error:
            if report is None:
                raise
            report.note(f"derive:{task.name}", "FAIL", f"{name}: {reason(error)}")
    df = filter_rows(df, task.filter_expr)
    pivot = task.pivot_cfg
    if pivot.enabled:
        known = pivot.pivot_values
        if known is not None:
            known = [tuple(v) if isinstance(v, list) else v for v in known]
        df = pivot_table(
            df, pivot.group_by, pivot.pivot_cols, pivot.values_agg, known, pivot.renames, pivot.order_by
        )
    elif task.col_map:
        df = project_detail(df, task.col_map)
    by = task.sort_config or (pivot.group_by if pivot.enabled else [])
    return sort_rows(df, by)


def build_outputs(spark: SparkSession, spec: JobSpec | dict) -> dict[str, DataFrame]:
    """All outputs of a job by name, not yet written."""
    spec = JobSpec.from_dict(spec) if isinstance(spec, dict) else spec
    configure(spark)
    pool = build_pool(spark, spec)
    return {task.name: build_output(pool, task) for task in spec.tasks}


def output_paths(spec: JobSpec) -> dict[str, str]:
    """Folder of each output; names that become equal once cleaned are an error."""
    if not spec.output:
        raise ValueError("the job names no output folder")
    paths: dict[str, str] = {}
    taken = {REPORT_NAME}
    for task in spec.tasks:
        name = clean_output_name(task.name)
        if name.lower() in taken:
            raise ValueError(f"output name {task.name!r} is used twice")
        taken.add(name.lower())
        paths[task.name] = f"{spec.output.rstrip('/')}/{name}"
    return paths


def run_report_job(spark: SparkSession, spec: JobSpec | dict) -> DataFrame:
    """Write every output and return the run report, which is also written beside them.

    An unusable lookup is skipped, a failing derived column left out and a failing output
    recorded; the rest still runs.
    """
    spec = JobSpec.from_dict(spec) if isinstance(spec, dict) else spec
    paths = output_paths(spec)
    configure(spark)
    report, began = Journal(), time.monotonic()
    try:
        with dropped_afterwards(spark) as staged, ThreadPoolExecutor(_OUTPUTS_AT_ONCE) as jobs:
            pool = build_pool(spark, spec, report, on_error="skip")

            def run(task: OutputTask) -> Journal:
                with collecting(staged):
                    return _run_output(pool, task, spec, paths[task.name])

            for steps in jobs.map(run, spec.tasks):
                report.extend(steps)
        report.note("job", "done", f"seconds={time.monotonic() - began:.1f}")
    except Exception as error:
        report.note("job", "FAIL", reason(error))
        raise
    finally:
        table = report.table(spark).coalesce(1)
        table.write.mode("append").parquet(f"{spec.output.rstrip('/')}/{REPORT_NAME}")
    return report.table(spark)


def _run_output(pool, task: OutputTask, spec: JobSpec, path: str) -> Journal:
    """Write one output; its own journal, so that outputs written side by side keep their order in the report."""
    report = Journal()
    report.note(f"output:{task.name}", "started")
    try:
        df = build_output(pool, task, report)
        rows = write_output(
            df, path, spec.max_rows, spec.file_format, spec.mode, spec.numbered_sheets
        )
        report.note(f"output:{task.name}", "done", f"rows={rows} columns={len(df.columns)}")
    except STEP_ERRORS as error:
        report.note(f"output:{task.name}", "FAIL", reason(error))
    return report
