"""Putting tables below or beside each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportloom.operators.columns import ref, repeated_name, value_of
from reportloom.operators.lookup import matching_type, rows_not_in_table
from reportloom.operators.ordering import tie_breaker
from reportloom.plans.staging import settle


#: Bytes of one table's rows that meet others in one group, as far as single rows allow, and what a row counts besides its texts.
_BLOCK, _ROW = 4 << 20, 1024


def _common_type(types: Sequence[T.DataType]) -> str | None:
    """Cast needed so that a column can be stacked; None when Spark's own widening is safe."""
    if all(t == types[0] for t in types):
        return None
    if all(isinstance(t, (T.NumericType, T.NullType)) for t in types):
        return None
    # Spark would cast the text side to a number and fail on the first non-number.
    return "string"


def append_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing from one is null there, duplicates stay."""
    if not tables:
        raise ValueError("no table to append")
    # Spark matches names without case, so types are gathered that way; the first spelling names the column.
    seen: dict[str, list[T.DataType]] = {}
    spelled: dict[str, str] = {}
    for df in tables:
        for field in df.schema.fields:
            folded = field.name.lower()
            seen.setdefault(folded, []).append(field.dataType)
            spelled.setdefault(folded, field.name)
    casts = {name: _common_type(types) for name, types in seen.items()}

    def fitted(name: str) -> Column:
        cast = casts[name.lower()]
        return (ref(name).cast(cast) if cast else ref(name)).alias(spelled[name.lower()])

    aligned = [df.select([fitted(c) for c in df.columns]) for df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def align_tables(tables: Sequence[DataFrame], ordered: bool = True) -> DataFrame:
    """Full outer join on all columns the tables share, sorted by them.

    Null keys match nothing. Every other column must belong to one table only. Two tables are joined by a lazy plan; three or
    more are read once each, written below one another in the shared folder, and meet in one exchange.
    """
    if len(tables) < 2:
        raise ValueError("aligning takes at least two tables")
    common = [c for c in tables[0].columns if all(c in df.columns for df in tables[1:])]
    if not common:
        raise ValueError("the tables share no column")
    extra = [c for df in tables for c in df.columns if c not in common]
    twice = repeated_name([*common, *extra])
    if twice is not None:
        raise ValueError(f"column {twice!r} is in several tables but not in all")

    types = {c: tables[0].schema[c].dataType for c in common}
    casts = {c: types[c].simpleString() for c in common}
    for df in tables[1:]:
        for c in common:
            if df.schema[c].dataType != types[c]:
                casts[c] = matching_type(df.schema[c].dataType, types[c])
    keyed = [
        df.select([_key(value_of(df, c).cast(casts[c]), casts[c]).alias(c) if c in casts else ref(c) for c in df.columns])
        for df in tables
    ]
    joined = _full_outer(*keyed, common) if len(keyed) == 2 else _beside(keyed, common)
    joined = joined.select([ref(c) for c in [*common, *extra]])
    if not ordered:
        return joined
    order = [*[ref(c).asc_nulls_last() for c in common], F.col("__tie")]
    return joined.withColumn("__tie", tie_breaker(joined)).orderBy(order).drop("__tie")


def _key(value: Column, kind: str) -> Column:
    """The key with one zero only: joins take both for the same, the texts of keys do not."""
    return F.when(value == 0, F.lit(0).cast(kind)).otherwise(value) if kind in ("float", "double") else value


def _full_outer(a: DataFrame, b: DataFrame, common: Sequence[str]) -> DataFrame:
    """Matches and, apart, the rows of each side without one.

    AQE cannot split a hot key in a full outer join, and in a left join only on the left; in an inner and in an anti join
    it can wherever it lies. That is worth reading a side once more. A key that is frequent on both sides
    gives all its pairs: that is what the join means.
    """
    matched = a.join(b, list(common))
    left_only = rows_not_in_table(a, common, b, common)
    right_only = rows_not_in_table(b, common, a, common)
    return matched.unionByName(left_only, allowMissingColumns=True).unionByName(
        right_only, allowMissingColumns=True
    )


def _size(df: DataFrame, names: Sequence[str]) -> Column:
    """About the bytes of a row."""
    texts = [c for c in names if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    return reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(ref(c)), F.lit(0)) for c in texts], F.lit(_ROW)).cast("bigint")


def _beside(tables: Sequence[DataFrame], common: Sequence[str]) -> DataFrame:
    """Rows of all tables that share a key side by side, each with each; a table without the key gives nulls.

    The tagged rows of all tables are written once. One exchange brings those of a key together. Where a table has more than
    ``_BLOCK`` bytes of a key, its rows are dealt out to blocks and the other tables' rows of the key go to each of them, so a
    group holds at most one block of each table, however frequent a key is in whichever of them. Only such hot
    keys are counted out: their table has a row for each block's worth of input at most. A row without a key is a group of its own.
    """
    keys = [f"k{j}" for j in range(len(common))]
    sides = [f"t{i}" for i in range(len(tables))]
    extra = [[c for c in df.columns if c not in common] for df in tables]
    tagged = []
    for i, (df, names) in enumerate(zip(tables, extra)):
        row = F.struct(F.lit(True).alias("here"), *[ref(c).alias(f"c{k}") for k, c in enumerate(names)])
        own = [ref(c).alias(k) for c, k in zip(common, keys)]
        tagged.append(df.select(*own, F.lit(i).alias("of"), _size(df, names).alias("size"), row.alias(sides[i])))
    rows = settle(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), "align")

    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    sizes = rows.where(~keyless).groupBy(*keys, "of").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("size") > _BLOCK)
    blocks = [f"n{i}" for i in range(len(tables))]
    # No more blocks than rows: then a row is never copied more often than it is in the result.
    needed = F.least(F.ceil(F.col("size") / _BLOCK), "rows")
    hot = large.groupBy(*keys).agg(*[F.max(F.when(F.col("of") == i, needed)).alias(n) for i, n in enumerate(blocks)])
    dealt = rows.withColumn("id", F.monotonically_increasing_id()).join(settle(hot, "align-hot"), keys, "left")
    dealt = dealt.fillna(1, blocks).withColumn("alone", F.when(keyless, F.col("id")))
    cells = [f"b{i}" for i in range(len(tables))]
    for i, (cell, n) in enumerate(zip(cells, blocks)):
        mine = F.array(F.pmod(F.xxhash64("id"), F.col(n)))
        every = F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
        dealt = dealt.withColumn(cell, F.explode(F.when(F.col("of") == i, mine).otherwise(every)))
    gathered = [F.collect_list(side).alias(side) for side in sides]
    groups = dealt.groupBy(*keys, "alone", *cells, *blocks).agg(*gathered)
    # A table of several blocks has the key: where one of them stayed empty, there is nothing to put beside the others.
    groups = groups.where(reduce(lambda a, b: a & b, [(F.col(n) == 1) | (F.size(t) > 0) for n, t in zip(blocks, sides)]))
    for side in sides:
        groups = groups.withColumn(side, F.explode_outer(side))
    picked = [F.col(side)[f"c{k}"].alias(c) for side, names in zip(sides, extra) for k, c in enumerate(names)]
    return groups.select(*[F.col(k).alias(c) for k, c in zip(keys, common)], *picked)
