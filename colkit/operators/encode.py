"""Distinct values, codes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import literal
from .rows import with_row_id


def unique(df: DataFrame, column: str, order_by: str, name: str = "first_at") -> DataFrame:
    """Distinct values, null too, each with where it is first seen (the smallest ``order_by``)."""
    return df.groupBy(F.col(f"`{column}`")).agg(F.min(f"`{order_by}`").alias(name))


def value_counts(df: DataFrame, column: str, *, dropna: bool = True, normalize: bool = False, name: str = "count") -> DataFrame:
    rows = df.where(F.col(f"`{column}`").isNotNull()) if dropna else df
    counts = rows.groupBy(F.col(f"`{column}`")).agg(F.count(F.lit(1)).alias(name))
    if normalize:
        total = rows.agg(F.count(F.lit(1)).alias("__all"))
        counts = counts.crossJoin(F.broadcast(total)).withColumn(name, F.col(name) / F.col("__all")).drop("__all")  # one row
    return counts


def factorize(df: DataFrame, column: str, order_by: str, *, na_sentinel: int = -1, name: str = "code") -> DataFrame:
    """``df`` with a code per value, numbered as they are first seen; null gets ``na_sentinel``."""
    firsts = unique(df.where(F.col(f"`{column}`").isNotNull()), column, order_by, "__first")
    codes = with_row_id(firsts, ["__first"], "__code").select(F.col(f"`{column}`").alias("__value"), "__code")
    joined = df.join(codes, F.col(f"`{column}`") == F.col("__value"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__code"), F.lit(na_sentinel)).cast("bigint")).drop("__value", "__code")


def get_dummies(df: DataFrame, column: str, *keep: str, sep: str = "|", most: int = 2000) -> DataFrame:
    """A 0/1 column per token of the split text; a null row has only zeros.

    Two passes: the tokens become columns, so there must be at most ``most``, a parameter; more are a ``ValueError``, none is left out.
    """
    parts = F.split(F.col(f"`{column}`"), literal(sep))
    tokens = [r[0] for r in df.select(F.explode(parts).alias("t")).where("t <> ''").distinct().orderBy("t").limit(most + 1).collect()]
    if len(tokens) > most:
        raise ValueError(f"more than {most} tokens")
    held = df.select(*keep, parts.alias("__parts"))
    return held.select(*keep, *[F.coalesce(F.array_contains("__parts", t), F.lit(False)).cast("bigint").alias(t) for t in tokens])


def duplicated(df: DataFrame, column: str, order_by: str, name: str = "duplicated") -> DataFrame:
    """True for all but the first row of each value; ``order_by`` tells rows apart.  A value's first row is aggregated and joined, so a value
    that very many rows have is split by the skew join.
    """
    firsts = df.groupBy(F.col(f"`{column}`").alias("__value")).agg(F.min(f"`{order_by}`").alias("__first"))
    joined = df.join(firsts, F.col(f"`{column}`").eqNullSafe(F.col("__value")))
    return joined.withColumn(name, F.col(f"`{order_by}`") != F.col("__first")).drop("__value", "__first")


def contains_value(df: DataFrame, column: str, value) -> bool:
    """Whether a value (null too) is among the rows."""
    return not df.where(F.col(f"`{column}`").eqNullSafe(F.lit(value))).isEmpty()
