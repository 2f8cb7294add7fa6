"""Lookup joins: every main row keeps exactly one place, whatever the target holds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.operators.columns import present, ref, repeated_name, resolve_columns, value_of
from reportloom.plans.errors import STEP_ERRORS
from reportloom.plans.staging import settle

Selector = str | Iterable[str]

COLLISION_SUFFIX = "_dup"  # fixed value

_SAME_AS_TEXT = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def matching_type(left: T.DataType, right: T.DataType) -> str:
    """Type in which two key columns are compared.

    Keys match when their texts are equal. Whole numbers, and two columns of one
    text or time type, give the same answer without the cast, which keeps hashing
    and sorting on the native value.
    """
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return "bigint"
    if isinstance(left, _SAME_AS_TEXT) and type(left) is type(right):
        return left.simpleString()
    return "string"


def first_per_key(df: DataFrame, keys: Selector, order_by: Selector | None = None) -> DataFrame:
    """One row per key: the smallest by ``order_by``, ties and default by the other columns in order."""
    key_names = resolve_columns(keys, df.columns)
    ordered = resolve_columns(order_by, df.columns)
    rest = [c for c in df.columns if c not in key_names]
    ranked = list(dict.fromkeys([*ordered, *rest]))
    if not ranked:
        return df.dropDuplicates(key_names)
    # A struct is never null, so rows whose order value is null still count (nulls come first).
    smallest = F.min(F.struct(*[ref(c).alias(f"f{i}") for i, c in enumerate(ranked)]))
    picked = df.groupBy(*[ref(k).alias(k) for k in key_names]).agg(smallest.alias("__first"))
    fields = {c: F.col(f"__first.f{i}").alias(c) for i, c in enumerate(ranked)}
    return picked.select([ref(c) if c in key_names else fields[c] for c in df.columns])


def picked_names(master: Sequence[str], picks: Sequence[str], prefix: str = "") -> list[str]:
    """Result names of picked columns: prefixed, and suffixed where the main table has that name."""
    taken = {c.lower() for c in master}
    names = [prefix + c for c in picks]
    names = [n + COLLISION_SUFFIX if n.lower() in taken else n for n in names]
    twice = repeated_name([*master, *names])
    if twice is not None:
        raise ValueError(f"column {twice!r} exists already, also with {COLLISION_SUFFIX!r}; set a prefix")
    return names


#: Keys of a main table up to which a bitmap of them is broadcast (16 bits a key, one of its words in 64 bits beside its place).
PRUNING_KEYS = 1 << 22
_BITS_A_KEY = 16


def key_bitmap(keys: DataFrame) -> DataFrame | None:
    """Which of some hashes (column ``h``) occur, as words of a bitmap; None for more than ``PRUNING_KEYS`` of them.

    Hashes are folded to 16 bits a key, as counted, so about one in sixteen that do not occur seems to. Words combine
    before the shuffle and are written once. Columns: ``__place`` (of the word), ``__word``, and ``__size`` (bits in all).
    """
    n = keys.agg(F.approx_count_distinct("h")).first()[0]
    if n > PRUNING_KEYS:
        return None
    size = 1 << max(10, (n * _BITS_A_KEY - 1).bit_length())
    words = keys.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at")).groupBy(F.shiftright("at", 6).alias("__place"))
    return settle(words.agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("__word"), F.lit(size).alias("__size")), "key-bitmap")


def _pruned(target: DataFrame, keys: list[Column], bitmap: DataFrame) -> DataFrame:
    """Target rows whose keys may occur in the main table; they are dropped where they are read, before any shuffle."""
    size = (bitmap.select("__size").first() or [1 << 10])[0]
    at = F.xxhash64(*keys).bitwiseAND(F.lit(size - 1))
    found = target.withColumn("__at", at).join(F.broadcast(bitmap.drop("__size")), F.shiftright("__at", 6) == F.col("__place"))
    return found.where("shiftleft(1L, CAST(__at & 63 AS INT)) & __word <> 0").drop("__at", "__place", "__word")


@dataclass
class _Lookup:
    """One rule, resolved: which columns pair up, what is picked, and under which names."""

    m_keys: list[str]
    t_keys: list[str]
    picks: list[str]
    order: list[str]
    names: list[str]

    @classmethod
    def resolve(cls, columns, target, master_keys, target_keys, pick, prefix, order_by, by_letter) -> _Lookup:
        m_keys = resolve_columns(master_keys, columns, by_letter)
        t_keys = resolve_columns(target_keys, target.columns, by_letter)
        picks = resolve_columns(pick, target.columns, by_letter)
        if not m_keys or len(m_keys) != len(t_keys):
            raise ValueError(f"key columns do not pair up: {m_keys} and {t_keys}")
        if not picks:
            raise ValueError("no column to pick")
        if set(picks) & set(t_keys):
            raise ValueError(f"a target key cannot be picked: {sorted(set(picks) & set(t_keys))}")
        order = resolve_columns(order_by, target.columns, by_letter)
        return cls(m_keys, t_keys, picks, order, picked_names(columns, picks, prefix))


def _found(master: DataFrame, target: DataFrame, lookup: _Lookup, unique: bool, prune: bool) -> DataFrame:
    """The target with one row per key: ``__k0``, ... in the type that main keys compare in, and the picks by their result names."""
    types = [matching_type(master.schema[m].dataType, target.schema[t].dataType) for m, t in zip(lookup.m_keys, lookup.t_keys)]
    keys = [value_of(target, t).cast(ty) for t, ty in zip(lookup.t_keys, types)]
    found = target.where(reduce(lambda a, b: a & b, [present(target, t) for t in lookup.t_keys]))
    if prune:
        left = [value_of(master, m).cast(t) for m, t in zip(lookup.m_keys, types)]
        given = reduce(lambda a, b: a & b, [present(master, m) for m in lookup.m_keys])
        bitmap = key_bitmap(master.where(given).select(F.xxhash64(*left).alias("h")))
        found = found if bitmap is None else _pruned(found, keys, bitmap)
    key_cols = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    if unique:
        return found.select(*key_cols, *[ref(c).alias(name) for c, name in zip(lookup.picks, lookup.names)])
    order_cols = [ref(c).alias(f"__o{i}") for i, c in enumerate(lookup.order)]
    pick_cols = [ref(c).alias(f"__p{i}") for i, c in enumerate(lookup.picks)]
    found = found.groupBy(*key_cols).agg(F.min(F.struct(*order_cols, *pick_cols)).alias("__row"))
    picked = [F.col(f"__row.__p{i}").alias(name) for i, name in enumerate(lookup.names)]
    return found.select(*[F.col(f"__k{i}") for i in range(len(keys))], *picked)


def _with_found(master: DataFrame, m_keys: list[str], found: DataFrame, plain: bool) -> DataFrame:
    """The main table with what was found for its keys. ``plain`` joins by the keys alone, for tables bucketed by them."""
    types = [found.schema[f"__k{i}"].dataType for i in range(len(m_keys))]
    names = [c for c in found.columns if c not in {f"__k{i}" for i in range(len(m_keys))}]
    # Until the join is done the found columns have names of their own: the main table may be found columns too.
    inner = {f"__k{i}": f"__j{i}" for i in range(len(m_keys))} | {name: f"__p{i}" for i, name in enumerate(names)}
    right = [F.col(f"__j{i}") for i in range(len(m_keys))]
    left = [value_of(master, m).cast(t) for m, t in zip(m_keys, types)]
    pairs = [a == b for a, b in zip(left, right)]
    if not plain:
        # The hash is implied by the keys. As a further join key it gives the grouped
        # target an exchange of its own, and only a join that reads two plain
        # exchanges lets AQE split a partition swollen by one hot (or null) main key.
        pairs.append(F.xxhash64(*left) == F.xxhash64(*right))
    joined = master.join(found.withColumnsRenamed(inner), reduce(lambda a, b: a & b, pairs), "left")
    joined = joined.drop(*[f"__j{i}" for i in range(len(m_keys))])
    return joined.withColumnsRenamed({f"__p{i}": name for i, name in enumerate(names)})


def lookup_join(
    master: DataFrame,
    target: DataFrame,
    master_keys: Selector,
    target_keys: Selector,
    pick: Selector,
    prefix: str = "",
    order_by: Selector | None = None,
    by_letter: bool = False,
    unique: bool = False,
    prune: bool = False,
) -> DataFrame:
    """Left join that brings ``pick`` columns of ``target`` to ``master``, at most one match per row.

    Of several target rows with one key, the smallest by ``order_by`` (default: by
    the picked columns) is used. ``unique=True`` promises that target keys are
    unique, which saves that step and lets tables bucketed by the keys meet without
    a shuffle. ``prune=True`` is for a target much larger than the main table: a job counts the main keys, and unless
    they are too many a bitmap of them drops most other target rows where they are read. The rows are the same either way.

    Nothing is hinted: Catalyst broadcasts the target when its known size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
    """
    lookup = _Lookup.resolve(master.columns, target, master_keys, target_keys, pick, prefix, order_by, by_letter)
    return _with_found(master, lookup.m_keys, _found(master, target, lookup, unique, prune), unique)


@dataclass
class _Pending:
    """A lookup that the main table has yet to meet, with the lookups that hang on its picks already in it."""

    m_keys: list[str]
    found: DataFrame
    names: list[str]
    plain: bool
    small: bool


def _estimate(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a table, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def link_tables(
    master: DataFrame, rules: Iterable[dict], on_error: str = "raise", on_event=None, contract: bool = True
) -> DataFrame:
    """Apply lookup rules in order; later keys may use earlier picks.

    A rule is a dict of :func:`lookup_join` arguments plus ``target``, a DataFrame
    or a function returning one. With ``on_error='skip'`` a rule whose target or
    columns are unusable is left out. ``on_event(rule, error_or_none, picks)`` hears
    about each rule. Spark checks names and types while the plan is built, so both
    happen before any job.

    A rule whose keys are all picks of one earlier rule is looked up from that rule's target, reduced to one row per key,
    instead of from the main table: a chain of targets becomes one table before the main table meets it, and the main table is
    shuffled once for the whole chain. That is done where the earlier target is not larger than the main table by Catalyst's
    estimate; ``contract=False`` turns it off. Rows, names and their order are the same either way.
    """
    pending: list[_Pending] = []
    columns = list(master.columns)

    def flushed() -> DataFrame:
        joined = master
        for lookup in pending:
            joined = _with_found(joined, lookup.m_keys, lookup.found, lookup.plain)
        pending.clear()
        return joined.select([ref(c) for c in columns]) if joined is not master else master

    for rule in rules:
        options = {k: v for k, v in rule.items() if k not in ("target", "label", "unique", "prune")}
        options = {"prefix": "", "order_by": None, "by_letter": False} | options
        unique, prune = rule.get("unique", False), rule.get("prune", False)
        try:
            target = rule["target"]() if callable(rule["target"]) else rule["target"]
            lookup = _Lookup.resolve(columns, target, **options)
            needed = set(lookup.m_keys)
            hosts = [p for p in pending if needed & set(p.names)]
            host = hosts[0] if len(hosts) == 1 and needed <= set(hosts[0].names) and hosts[0].small else None
            if hosts and host is None:
                master = flushed()
            base = master if host is None else host.found
            found = _found(base, target, lookup, unique, prune)
            if host is not None:
                linked = _with_found(base, lookup.m_keys, found, unique)
            else:
                small = contract and _estimate(target) <= _estimate(master)
        except STEP_ERRORS as error:
            if on_error == "raise":
                raise
            if on_event:
                on_event(rule, error, 0)
            continue
        if host is not None:
            host.found, host.plain = linked, False
            host.names += lookup.names
        else:
            pending.append(_Pending(lookup.m_keys, found, list(lookup.names), unique, small))
        columns += lookup.names
        if on_event:
            on_event(rule, None, len(lookup.names))
    return flushed()


def pool_columns(master: DataFrame, rules: Iterable[dict]) -> list[str]:
    """Names the joined table will have. Only the analyzer runs."""
    return link_tables(master, rules).columns


def rows_in_table(df: DataFrame, names: Selector, values: DataFrame, value_names: Selector) -> DataFrame:
    """Rows whose ``names`` occur among the values of another table."""
    return _by_value_table(df, names, values, value_names, "left_semi")


def rows_not_in_table(df: DataFrame, names: Selector, values: DataFrame, value_names: Selector) -> DataFrame:
    """Rows whose ``names`` do not occur among the values; rows without a value stay."""
    return _by_value_table(df, names, values, value_names, "left_anti")


def mark_rows(df: DataFrame, names: Selector, values: DataFrame, value_names: Selector, mark: str) -> DataFrame:
    """All rows, with a column ``mark``: whether their ``names`` occur among the values of another table.

    Where a semi or anti join decides about rows, this leaves the decision to a condition that looks at more than that.
    Rows without a value are marked false.
    """
    marked = _by_value_table(df, names, values.withColumn(mark, F.lit(True)), value_names, "left", mark)
    return marked.withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def _by_value_table(df, names, values, value_names, how, mark: str | None = None) -> DataFrame:
    names = resolve_columns(names, df.columns)
    value_names = resolve_columns(value_names, values.columns)
    types = [
        matching_type(df.schema[n].dataType, values.schema[v].dataType) for n, v in zip(names, value_names)
    ]
    left = [value_of(df, n).cast(t) for n, t in zip(names, types)]
    right = [F.col(f"__k{i}") for i in range(len(names))]
    listed = values.where(reduce(lambda a, b: a & b, [present(values, v) for v in value_names]))
    listed = listed.select(
        *[value_of(values, v).cast(t).alias(f"__k{i}") for i, (v, t) in enumerate(zip(value_names, types))],
        *([mark] if mark else []),
    ).distinct()
    # The hash is a further key for the same reason as in lookup_join.
    pairs = [*[a == b for a, b in zip(left, right)], F.xxhash64(*left) == F.xxhash64(*right)]
    return df.join(listed, reduce(lambda a, b: a & b, pairs), how).drop(*[f"__k{i}" for i in range(len(names))])
