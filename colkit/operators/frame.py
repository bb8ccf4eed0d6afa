"""Group-by, join, order and alignment with the conventions of data frames: null keys are dropped by groups, meet in
joins, and come last in orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def group_agg(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], dropna: bool = True, first_seen: str | None = None) -> DataFrame:
    """Groups without null keys; with ``first_seen`` in the order in which keys first appear by that column."""
    rows = df.dropna(subset=list(keys)) if dropna else df
    out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()], *([F.min(first_seen).alias("__first")] if first_seen else []))
    return out.orderBy("__first").drop("__first") if first_seen else out


def group_transform(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """The group's aggregate beside each row.  Aggregated first and joined, so a hot key is not one window partition."""
    sums = df.groupBy(*keys).agg(value.alias(name))
    named = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def group_apply(df: DataFrame, keys: Sequence[str], func: Callable, schema: str | T.StructType) -> DataFrame:
    """``func`` over each group as a pandas frame."""
    return df.groupBy(*keys).applyInPandas(func, schema)


#: Rows a side, about, of a cell in which a full outer merge pairs rows of one key.
SIDE = 2048


def merge(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """A join on equality where null meets null.  Columns of a full outer merge are picked by name, or by ``alias`` of a frame."""
    if how.lower().replace("_", "") in ("full", "outer", "fullouter") and not (left.isStreaming or right.isStreaming):
        return _merge_full(left, right, left_on, right_on)
    return left.join(right, left[f"`{left_on}`"].eqNullSafe(right[f"`{right_on}`"]), how)


def _merge_full(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """A left outer join, with a row of nulls added on the left for each key that only the right side has.  Spark's compiled
    full outer join puts all pairs of a key into memory before it passes on the first, this one those of one left row.
    A key of over ``SIDE`` rows is dealt out, its left rows to lines and its right rows to columns of a grid, and joined cell
    by cell, so it is no single task.  Rows are dealt by their content, so that a task that runs again deals them alike;
    equal rows share a cell."""
    a, b = F.col(f"`{left_on}`"), F.col(f"`{right_on}`")
    keys = left.select(a.alias("__key"), F.lit(1).alias("__l"), F.lit(0).alias("__r")).union(right.select(b, F.lit(0), F.lit(1)))
    kind, one = keys.schema["__key"].dataType, F.lit(1).cast("bigint")
    groups = keys.groupBy("__key").agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).where("__r > 0")
    sized = groups.select("__key", *[F.greatest(F.ceil(F.col(n) / SIDE), one).alias(m) for n, m in (("__l", "__lines"), ("__r", "__columns"))], (F.col("__l") == 0).alias("__absent"))
    grids = sized.where("__lines + __columns > 2").drop("__absent")

    def dealt(df: DataFrame, key: Column, side: str, own: str, other: str) -> DataFrame:
        """Each row in one line (column) of its key's grid and there in every column (line); keys without a grid are one cell."""
        names = [c.lower() for c in df.columns]
        content = ["`" + c.replace("`", "``") + "`" for c, t in df.dtypes if names.count(c.lower()) == 1 and "map<" not in t and "variant" not in t]
        found = df.withColumn(side, key.cast(kind)).join(grids, F.col(side).eqNullSafe(F.col("__key")), "left")
        every = F.explode(F.sequence(one, F.coalesce(other, one)))
        placed = found.withColumn(f"{side}_own", F.pmod(F.xxhash64(*content), F.coalesce(own, one)) + 1).withColumn(f"{side}_other", every)
        return placed.withColumn(f"{side}_grid", F.col(own).isNotNull()).drop("__key", "__lines", "__columns")

    x, y = dealt(left, a, "__x", "__lines", "__columns"), dealt(right, b, "__y", "__columns", "__lines")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema]
    x = x.union(sized.where("__absent").select(*nulls, "__key", one, F.explode(F.sequence(one, "__columns")), F.lit(True)))
    cell = F.col("__x").eqNullSafe(F.col("__y")) & (F.col("__x_own") == F.col("__y_other")) & (F.col("__x_other") == F.col("__y_own"))
    # A cell can lack right rows, but not the whole grid: its left rows are matched in other cells.  The hint: with one side
    # broadcast, the cells of the other would stay in the few tasks that read it.
    pairs = x.join(y.hint("merge"), cell, "left").where(F.col("__y_own").isNotNull() | ~F.col("__x_grid"))
    return pairs.drop(*[side + part for side in ("__x", "__y") for part in ("", "_own", "_other", "_grid")])


def sort_values(df: DataFrame, by: str, ascending: bool = True, tie: str | None = None, key: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Nulls last either way."""
    c = key(F.col(f"`{by}`"))
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *([tie] if tie else []))


def argsort(df: DataFrame, by: str, order_by: Sequence[str], name: str = "rank", na_position: str = "last") -> DataFrame:
    """Each row with its position in the sorted order, nulls last or first, ties in row order."""
    from .rows import with_row_id

    if na_position not in ("first", "last"):
        raise ValueError("na_position is first or last")
    order_by = [order_by] if isinstance(order_by, str) else order_by
    flagged = df.withColumn("__null", F.col(f"`{by}`").isNull() == F.lit(na_position == "last"))
    return with_row_id(flagged, ["__null", by, *order_by], name).drop("__null")


def to_list(df: DataFrame, column: str, order_by: Sequence[str]) -> list:
    """All values in order, on the driver: for results, not for tables at scale."""
    return [r[0] for r in df.orderBy(*order_by).select(F.col(f"`{column}`")).toLocalIterator()]


def concat_columns(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames side by side, aligned by ``key``: all keys of all, null where a frame has none; other columns need names of their own."""
    out = frames[0]
    for df in frames[1:]:
        right = df.withColumnRenamed(key, "__right")
        joined = out.join(right, F.col(key).eqNullSafe(F.col("__right")), "full")
        out = joined.select(F.coalesce(key, "__right").alias(key), *[c for c in [*out.columns, *df.columns] if c != key])
    return out


def argmin(by: Column, at: Column) -> Column:
    """Aggregate: the smallest ``at`` among the smallest values."""
    return F.min(F.when(by.isNotNull(), F.struct(by.alias("v"), at.alias("at"))))["at"]


def argmax(by: Column, at: Column) -> Column:
    """Aggregate: the smallest ``at`` among the largest values (numeric ``at``)."""
    return -F.max(F.when(by.isNotNull(), F.struct(by.alias("v"), (-at).alias("at"))))["at"]


def searchsorted(by: Column, value) -> Column:
    """Aggregate: where ``value`` goes in the sorted column (left side)."""
    return F.count_if(by < F.lit(value))


def where(c: Column, condition: Column, other) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), c).otherwise(other if isinstance(other, Column) else F.lit(other))


def combine_first(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def replace_values(c: Column, values: Sequence, new) -> Column:
    return F.when(c.isin(list(values)), F.lit(new)).otherwise(c)


def diff(df: DataFrame, column: str, periods: int, order_by: Sequence[str], name: str = "diff") -> DataFrame:
    from .rows import shift

    return shift(df, column, periods, order_by, name="__before").withColumn(name, F.col(f"`{column}`") - F.col("__before")).drop("__before")


def repeat(df: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times."""
    return df.withColumn("__k", F.explode(F.array_repeat(F.lit(0), n))).drop("__k")


def delete(df: DataFrame, positions: Sequence[int], order_by: Sequence[str]) -> DataFrame:
    from .rows import with_row_id

    return with_row_id(df, order_by, "__rid").where(~F.col("__rid").isin(list(positions))).drop("__rid")


def reindex(df: DataFrame, key: str, keys: DataFrame, fill_value=None) -> DataFrame:
    """A row for each of ``keys`` (one column), null or ``fill_value`` where the frame has none."""
    name = keys.columns[0]
    renamed = df.withColumnsRenamed({key: "__key"}).withColumn("__hit", F.lit(True))
    joined = keys.join(renamed, F.col(name).eqNullSafe(F.col("__key")), "left")
    rest = [F.when(F.col("__hit"), F.col(f"`{c}`")).otherwise(F.lit(fill_value)).alias(c) for c in df.columns if c != key]
    return joined.select(F.col(name).alias(key), *rest)


def align(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """A full outer join on a key; names: of the value columns (the frames' second columns)."""
    a = left.select(F.col(key).alias("__a"), F.col(left.columns[1]).alias(names[0]))
    b = right.select(F.col(key).alias("__b"), F.col(right.columns[1]).alias(names[1]))
    return a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full").select(F.coalesce("__a", "__b").alias(key), *names)


def stack(df: DataFrame, key: str, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot([key], list(columns), name, value)


def unstack(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """The names become columns; given, so that no pass is needed to find them."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def equals(a: DataFrame, b: DataFrame) -> bool:
    """The same rows, as often, whatever their order."""
    return a.schema.simpleString() == b.schema.simpleString() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def hash_rows(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def insert(df: DataFrame, position: int, values: dict, order_by: Sequence[str], name: str = "rid") -> DataFrame:
    """One more row before a position; ``name`` numbers the rows of the result."""
    from .rows import with_row_id

    numbered = with_row_id(df, order_by, name).withColumn(name, F.col(name) + (F.col(name) >= position).cast("bigint"))
    new = df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema).withColumn(name, F.lit(position).cast("bigint"))
    return numbered.unionByName(new)


def apply_elementwise(c: Column, func: Callable, returns: str) -> Column:
    """A Python function of each value, null included, in Arrow batches: for what no expression can say."""
    @pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([func(None if x is None or x != x else x) for x in s], dtype=object)

    return run(c)


def combine(a: Column, b: Column, func: Callable[[Column, Column], Column]) -> Column:
    """``func`` of two aligned columns, as an expression."""
    return func(a, b)


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows become columns: for small frames only, as Spark's own limit on pivoted values holds."""
    return df.transpose(F.col(index))


def memory_usage(df: DataFrame, column: str) -> int:
    from ..sources.io import metadata

    return metadata(df, column)["nbytes"]
