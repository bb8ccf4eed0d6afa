"""Operators on row positions.  Spark's rows have no order, so each takes the columns that define it.

Positions are dense numbers from 0.  They come from a range partitioning by the order columns, counts per
partition, and row numbers inside each partition: no window over all rows.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a block of consecutive positions.
BLOCK = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``: a folder that driver and executors share.

    Where the session does not name one, a temporary folder stands in if driver and executors are one process; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_colkit_folder", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark._colkit_folder = "file://" + tempfile.mkdtemp(prefix="colkit-")
    return path.rstrip("/")


def ensure_checkpoint_dir(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))


def with_row_id(df: DataFrame, order_by: Sequence[str] | str, name: str = "rid") -> DataFrame:
    """``df`` with each row's position in the order of ``order_by``, nulls first.

    The ranged rows are checkpointed: range bounds are sampled, so both uses must see the same partitions.  A chain of operators on positions
    numbers its rows once: where ``order_by`` is a single name instead of a list, that column holds the positions already.
    """
    if isinstance(order_by, str):
        return df.withColumn(name, F.col(f"`{order_by}`").cast("bigint"))
    keys = [F.col(f"`{c}`") for c in order_by]
    ensure_checkpoint_dir(df)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).checkpoint()
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    # one row per partition: its size is bounded by the number of partitions
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__part", "__at", "__offset")


def getitem(df: DataFrame, column: str, i: int, order_by: Sequence[str]):
    """The value at a position; negative counts from the end; None beyond the ends."""
    needed = [column, *([order_by] if isinstance(order_by, str) else order_by)]
    rows = with_row_id(df.select(*[f"`{c}`" for c in dict.fromkeys(needed)]), order_by, "__rid")
    if i < 0:
        i += df.count()
    row = rows.where(F.col("__rid") == i).select(column).first()
    return None if row is None else row[0]


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int | None, order_by: Sequence[str], name: str = "rid") -> DataFrame:
    """Python's slice of the rows; ``name`` holds the position in the result's order."""
    n = df.count()
    picked = range(*slice(start, stop, step).indices(n))
    rows = with_row_id(df, order_by, name)
    if not len(picked):
        return rows.where(F.lit(False))
    low, high, stride = min(picked[0], picked[-1]), max(picked[0], picked[-1]), abs(picked.step)
    at = F.col(name)
    kept = rows.where((at >= low) & (at <= high) & ((at - low) % stride == 0))
    new = (at - low) / stride if picked.step > 0 else (F.lit(high) - at) / stride
    return kept.withColumn(name, new.cast("bigint"))


def index(df: DataFrame, key, order_by: Sequence[str], column: str | None = None, name: str = "rid"):
    """What ``key`` stands for: an int a value of ``column``, a slice rows, a boolean column a mask, a list or array of ints or of booleans
    the rows at these positions (``name`` numbers them).  Anything else is an ``IndexError``.
    """
    import numpy as np

    if isinstance(key, Column):
        return filter_mask(df, key)
    if isinstance(key, slice):
        if any(not isinstance(x, (int, np.integer, type(None))) for x in (key.start, key.stop, key.step)):
            raise IndexError("slices take whole numbers")
        return slice_rows(df, key.start, key.stop, key.step, order_by, name)
    if isinstance(key, (int, np.integer)) and not isinstance(key, (bool, np.bool_)):
        if column is None:
            raise IndexError("a single position needs a column")
        return getitem(df, column, int(key), order_by)
    if not isinstance(key, (list, np.ndarray)):
        raise IndexError(f"positions, slices and masks are indexers, {type(key).__name__} is not")
    values = np.asarray(key)
    if values.ndim != 1 or (values.size and values.dtype.kind not in "iub"):
        raise IndexError("an indexer is one row of whole numbers or booleans")
    if values.dtype.kind == "b":
        if values.size != df.count():
            raise IndexError("a mask has as many values as there are rows")
        values = np.flatnonzero(values)
    wanted = df.sparkSession.createDataFrame([(k, int(v)) for k, v in enumerate(values)], f"`{name}` bigint, idx bigint")
    return take(df, wanted, order_by, pos=name)


def filter_mask(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask is true; null is false."""
    return df.where(F.coalesce(mask, F.lit(False)))


def take(df: DataFrame, indices: DataFrame, order_by: Sequence[str], *, allow_fill: bool = False, fill_value=None, pos: str = "pos", idx: str = "idx") -> DataFrame:
    """The rows at the positions in ``indices`` (pos, idx), one per row of it, with ``pos``.

    Negative positions count from the end; with ``allow_fill`` -1 stands for ``fill_value`` (null) and lower ones are errors.
    Positions beyond the ends raise ``IndexError``, found by one aggregation.
    """
    kind = indices.schema[idx].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("positions must be integers")
    n = df.count()
    bounds = indices.agg(F.min(idx).alias("low"), F.max(idx).alias("high")).first()
    if bounds["low"] is not None:
        if allow_fill and bounds["low"] < -1:
            raise ValueError("with allow_fill, -1 is the only negative position")
        if bounds["high"] >= n or (not allow_fill and bounds["low"] < -n):
            raise IndexError("position out of bounds")
    rows = with_row_id(df, order_by, "__rid")
    keys = [order_by] if isinstance(order_by, str) else order_by
    wanted = indices.select(F.col(pos).alias("__pos"), F.col(idx).cast("bigint").alias("__idx"))
    at = F.col("__idx") if allow_fill else F.when(F.col("__idx") < 0, F.col("__idx") + n).otherwise(F.col("__idx"))
    got = wanted.withColumn("__rid", at).join(rows, "__rid", "left")
    values = [(F.when(F.col("__idx") == -1, F.lit(fill_value)).otherwise(F.col(f"`{c}`")) if allow_fill and fill_value is not None and c not in keys else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return got.select(F.col("__pos").alias(pos), *values)


def set_where(c: Column, condition: Column, value) -> Column:
    """``value`` where the condition holds (null does not), else the column."""
    return F.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(c)


def setitem(df: DataFrame, column: str, key, value, order_by: Sequence[str]) -> DataFrame:
    """Assigns to positions: an int, a list of ints, a slice, or a mask column; ``value`` is a constant or a list as long as the key.

    A list as a value of list type is refused; lengths that differ are a ``ValueError``.
    """
    if isinstance(key, Column):
        return df.withColumn(column, set_where(F.col(f"`{column}`"), key, value))
    n = df.count()
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType):
        raise ValueError("cells of a list column cannot be assigned by position")
    if isinstance(key, slice) and not isinstance(value, (list, tuple)):  # a range of any length, by arithmetic
        picked = range(*key.indices(n))
        if not len(picked):
            return df
        low, high, stride, at = min(picked[0], picked[-1]), max(picked[0], picked[-1]), abs(picked.step), F.col("__rid")
        hit = (at >= low) & (at <= high) & ((at - low) % stride == 0)
        new = F.lit(None if isinstance(value, float) and value != value else value).cast(kind)
        return with_row_id(df, order_by, "__rid").withColumn(column, F.when(hit, new).otherwise(F.col(f"`{column}`"))).select(*[f"`{c}`" for c in df.columns])
    if isinstance(key, slice) and len(value) != len(range(*key.indices(n))):
        raise ValueError("as many values as positions are needed")
    positions = [key] if isinstance(key, int) else list(range(*key.indices(n))) if isinstance(key, slice) else list(key)
    positions = [p + n if p < 0 else p for p in positions]
    if any(p < 0 or p >= n for p in positions):
        raise IndexError("position out of bounds")
    values = list(value) if isinstance(value, (list, tuple)) else [value] * len(positions)
    if len(values) != len(positions):
        raise ValueError("as many values as positions are needed")
    clean = [None if isinstance(v, float) and v != v else v for v in values]
    new = df.sparkSession.createDataFrame(list({p: (p, v) for p, v in zip(positions, clean, strict=True)}.values()), T.StructType([T.StructField("__rid", T.LongType()), T.StructField("__new", kind), ]))
    joined = with_row_id(df, order_by, "__rid").join(new.withColumn("__hit", F.lit(True)), "__rid", "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(f"`{column}`"))).select(*[f"`{c}`" for c in df.columns])


def concat(*frames: DataFrame, name: str = "part") -> DataFrame:
    """All rows of all frames, with the number of the frame; columns by name, types widened."""
    out = frames[0].withColumn(name, F.lit(0))
    for k, df in enumerate(frames[1:], 1):
        out = out.unionByName(df.withColumn(name, F.lit(k)))
    return out


def shift(df: DataFrame, column: str, periods: int, order_by: Sequence[str], fill_value=None, name: str = "shifted") -> DataFrame:
    """The value ``periods`` rows before; a join on positions, so it needs no window over all rows."""
    rows = with_row_id(df, order_by, "__rid")
    moved = rows.select((F.col("__rid") + periods).alias("__rid"), F.col(f"`{column}`").alias("__moved"), F.lit(True).alias("__hit"))
    joined = rows.join(moved, "__rid", "left")
    return joined.withColumn(name, F.when(F.col("__hit"), F.col("__moved")).otherwise(F.lit(fill_value))).drop("__rid", "__moved", "__hit")


def flatten(df: DataFrame, column: str, *keep: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """A row per list element; null and empty lists vanish."""
    return df.select(*keep, F.posexplode(F.col(f"`{column}`")).alias(pos, value))


def cast(c: Column, kind: str | T.DataType, source: T.DataType | None = None) -> Column:
    """A strict cast (bad values are errors); lists become Python's notation when cast to text."""
    target = kind if isinstance(kind, str) else kind.simpleString()
    if isinstance(source, T.ArrayType) and target == "string":
        quote = isinstance(source.elementType, T.StringType)
        shown = F.transform(c, lambda e: F.coalesce(F.concat(F.lit("'"), e, F.lit("'")) if quote else e.cast("string"), F.lit("None")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")))
    return c.cast(kind)
