"""Specification of a report job: dataclasses that read and write plain JSON data.

Fixed values: the names of the fields, which saved presets use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from reportloom.operators.predicates import split_values
from reportloom.plans.preset import preset_filter
from reportloom.plans.preset_formulas import preset_fields


def _known(cls, data: dict) -> dict:
    names = {f.name for f in fields(cls)}
    unknown = set(data) - names
    if unknown:
        raise ValueError(f"{cls.__name__} has no {sorted(unknown)}; it takes {sorted(names)}")
    return dict(data)


class _Plain:
    @classmethod
    def from_dict(cls, data: dict):
        return cls(**_known(cls, data))

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Source(_Plain):
    """The main table: a path, one or several sheets of a book, or a folder of tables.

    ``combine`` says how several sheets become one table: ``append`` or ``align``.
    """

    path: str
    columns: list[str] | None = None
    sheet: int | str | list | None = None
    folder: bool = False
    combine: str = "append"
    encoding: str | None = None
    bad_rows: str = "keep"
    multiline: bool = False


@dataclass
class LookupRule(_Plain):
    """One lookup: where the target lies, which columns pair up, what to bring back.

    ``unique`` and ``prune`` are those of :func:`~reportloom.operators.lookup.lookup_join`.
    """

    target_path: str
    master_keys: str | list[str]
    target_keys: str | list[str]
    pick_cols: str | list[str]
    col_prefix: str = ""
    sheet_idx: int | str | None = None
    by_letter: bool = False
    order_by: str | list[str] | None = None
    unique: bool = False
    prune: bool = False
    encoding: str | None = None
    bad_rows: str = "keep"
    multiline: bool = False


@dataclass
class PivotSpec(_Plain):
    """A pivot table or grouped aggregate. ``pivot_values`` spares the job that finds them.

    ``renames`` may be text such as ``"sales=turnover, 2023=last year"``.
    """

    enabled: bool = False
    group_by: list[str] = field(default_factory=list)
    pivot_cols: list[str] = field(default_factory=list)
    values_agg: dict[str, str] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    pivot_values: list | None = None
    order_by: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if isinstance(self.renames, str):
            pairs = (part.partition("=") for part in split_values(self.renames))
            self.renames = {old.strip(): new.strip() for old, sign, new in pairs if sign}


@dataclass
class OutputTask(_Plain):
    """One output: derive, filter, then project or pivot, then sort.

    ``calc_fields`` are names of empty columns, ``[name, SQL]`` pairs, or ``[name, {"preset": formula}]`` as presets write them.
    """

    name: str
    filter_expr: str | dict | None = None
    calc_fields: Sequence = field(default_factory=list)
    sort_config: list[dict] = field(default_factory=list)
    col_map: list[dict] = field(default_factory=list)
    pivot_cfg: PivotSpec = field(default_factory=PivotSpec)

    @classmethod
    def from_dict(cls, data: dict) -> OutputTask:
        known = _known(cls, data)
        pivot = known.get("pivot_cfg")
        if isinstance(pivot, dict):
            known["pivot_cfg"] = PivotSpec.from_dict(pivot)
        return cls(**known)


@dataclass
class JobSpec(_Plain):
    """The whole job.

    ``infer`` turns type inference over the joined table on; ``keep_text`` names columns
    it leaves alone, ``types`` gives known types and spares its scan. ``share_pool``
    writes the joined table once for all outputs; by default each output reads only the
    columns and rows it needs, which is less work unless shuffled lookups dominate.
    """

    master: Source
    tasks: list[OutputTask]
    rules: list[LookupRule] = field(default_factory=list)
    output: str | None = None
    infer: bool = True
    keep_text: list[str] = field(default_factory=list)
    types: dict[str, str] | None = None
    share_pool: bool = False
    file_format: str = "parquet"
    mode: str = "errorifexists"
    max_rows: int = 1_048_575
    numbered_sheets: bool = False

    @classmethod
    def from_dict(cls, data: dict) -> JobSpec:
        known = _known(cls, data)
        known["master"] = _as(Source, known["master"])
        known["rules"] = [_as(LookupRule, r) for r in known.get("rules", [])]
        known["tasks"] = [_as(OutputTask, t) for t in known["tasks"]]
        return cls(**known)

    @classmethod
    def from_preset(cls, data: dict) -> JobSpec:
        """The job of a saved preset, whose master settings lie side by side.

        Formulas and filter texts are read in the forms that presets write (:func:`~reportloom.plans.preset_formulas.preset_fields`,
        :func:`~reportloom.plans.preset.preset_filter`); any other text is an error, and Python text is not run.
        """
        tasks = []
        for task in data.get("tasks", []):
            try:
                if isinstance(task.get("calc_fields"), str):
                    task = task | {"calc_fields": preset_fields(task["calc_fields"])}
                if isinstance(task.get("filter_expr"), str):
                    task = task | {"filter_expr": preset_filter(task["filter_expr"])}
            except ValueError as error:
                raise ValueError(f"output {task['name']!r}: {error}") from None
            tasks.append(task)
        folder = bool(data.get("master_is_folder", False))
        path, sheet = data["master"], data.get("folder_sheet" if folder else "master_sheet")
        single_table = not folder and path.rstrip("/").lower().endswith((".csv", ".parquet"))
        master = {
            "path": path,
            "folder": folder,
            "sheet": None if single_table else sheet,
            "columns": data.get("master_schema_cols") or None,
        }
        rest = {"rules": data.get("rules", []), "tasks": tasks, "output": data.get("output")}
        return cls.from_dict({"master": master, **rest})


def _as(cls, data):
    return cls.from_dict(data) if isinstance(data, dict) else data
