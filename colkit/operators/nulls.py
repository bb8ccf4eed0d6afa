"""Missing values: tests, constants, and filling in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import BLOCK, with_row_id

#: Blocks whose summaries one window takes.
SPAN = 1024


def isna(c: Column) -> Column:
    return c.isNull()


def notna(c: Column) -> Column:
    return c.isNotNull()


def fillna(c: Column, value) -> Column:
    """``value``: a constant, or a column of the same frame."""
    return F.coalesce(c, value if isinstance(value, Column) else F.lit(value))


def validate_fill(value, method) -> None:
    if (value is None) == (method is None):
        raise ValueError("give either a value or a method")
    if method not in (None, "ffill", "pad", "bfill", "backfill"):
        raise ValueError(f"no fill method {method!r}")


def fill_in_order(df: DataFrame, column: str, order_by: list[str], *, method: str = "ffill", limit: int | None = None) -> DataFrame:
    """The last (ffill) or next (bfill) value that is not null, at most ``limit`` rows away.

    Not one window over all rows: rows are numbered and cut in blocks; a window works inside each block, the value that a block inherits comes
    from one summary row per block, in windows over ``SPAN`` blocks, and what these inherit from one row for each ``SPAN`` blocks.
    """
    validate_fill(None, method)
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    forward = method in ("ffill", "pad")
    numbered = with_row_id(df, order_by, name="__rid")
    numbered = numbered.withColumn("__block", F.floor(F.col("__rid") / BLOCK))
    sign = 1 if forward else -1
    key = F.col("__rid") * sign
    seen = F.when(F.col(f"`{column}`").isNotNull(), F.struct(F.col("__rid").alias("at"), F.col(f"`{column}`").alias("value")))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max_by(seen, key) if forward else F.min_by(seen, F.col("__rid"))
    summary = numbered.where(F.col(f"`{column}`").isNotNull()).groupBy("__block").agg(best.alias("own"))
    blocks = numbered.groupBy("__block").agg(F.lit(1).alias("one")).drop("one").join(summary, "__block", "left")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__span", F.floor(F.col("__block") / SPAN))
    latest = F.max_by if forward else F.min_by
    spans = blocks.groupBy("__span").agg(latest(F.when(F.col("own").isNotNull(), F.col("own")), F.when(F.col("own").isNotNull(), F.col("__block"))).alias("own"))
    spans = spans.select("__span", F.last("own", ignorenulls=True).over(upto(Window.orderBy(F.col("__span") * sign))).alias("far"))
    near = F.last("own", ignorenulls=True).over(upto(Window.partitionBy("__span").orderBy(F.col("__block") * sign)))
    carried = blocks.select("__block", "__span", near.alias("near")).join(spans, "__span").select("__block", F.coalesce("near", "far").alias("__carried"))
    filled = numbered.withColumn("__near", F.last(seen, ignorenulls=True).over(inside)).join(carried, "__block")
    source = F.coalesce("__near", "__carried")
    close = F.lit(True) if limit is None else F.abs(F.col("__rid") - source["at"]) <= limit
    return filled.withColumn(column, F.when(close, source["value"])).select(*[f"`{c}`" for c in df.columns])
