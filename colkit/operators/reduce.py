"""Reductions as aggregate expressions, so that Spark combines them in partitions before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boolean import all_, any_


def _product(c: Column) -> Column:
    return F.product(c)


def exact_product(c: Column) -> Column:
    """For integers whose product a decimal of 38 digits holds; gathers a group's values, so for small groups only."""
    return F.aggregate(F.collect_list(c.cast("decimal(38,0)")), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))


def _skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(c))


def _kurt(c: Column) -> Column:
    n = F.count(c).cast("double")
    safe = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, (n - 1) / safe * ((n + 1) * F.kurtosis(c) + 6))


def _min(c: Column, floating: bool) -> Column:
    return F.when(F.bool_or(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c)) if floating else F.min(c)


_PLAIN = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(_product(c), F.lit(1.0)),
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    #: the sum over all rows by the number of all rows, nulls included
    "mean_all_rows": lambda c: F.coalesce(F.sum(c), F.lit(0)) / F.nullif(F.count(F.lit(1)), F.lit(0)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "skew": _skew,
    "kurt": _kurt,
    "median": F.median,
}


def reduce_expr(name: str, c: Column, skipna: bool = True, floating: bool = False) -> Column:
    """The aggregate ``name``.  Without ``skipna`` any null makes it null.  ``floating``: NaN is kept by min."""
    if name in ("any", "all"):
        return any_(c, skipna) if name == "any" else all_(c, skipna)
    if name not in _PLAIN:
        raise TypeError(f"no reduction {name!r}")
    value = _min(c, floating) if name == "min" else _PLAIN[name](c)
    return value if skipna else F.when(F.count(F.lit(1)) == F.count(c), value)


def reduce(df: DataFrame, column: str, name: str, skipna: bool = True):
    """The reduction of a whole column as a value: checked types, and ``ValueError`` for the extremes of nothing."""
    kind = df.schema[column].dataType
    if name in ("any", "all"):
        if not isinstance(kind, T.BooleanType):
            raise TypeError(f"{name} of {kind.simpleString()}")
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} of {kind.simpleString()}")
    c = F.col(f"`{column}`")
    if name == "median":
        return None if not skipna and not df.where(c.isNull()).isEmpty() else median(df, column)
    row = df.agg(reduce_expr(name, c, skipna, isinstance(kind, (T.FloatType, T.DoubleType))).alias("value"), F.count(c).alias("n"), F.count(F.lit(1)).alias("all")).first()
    if name in ("max", "min") and row["n"] == 0 and (skipna or row["all"] == 0):
        raise ValueError(f"{name} of no values")
    return row["value"]


def median(df: DataFrame, column: str) -> float | None:
    """By the positions of the sorted values, so no task holds all distinct ones, as the aggregate's buffer does."""
    from .rows import with_row_id

    known = with_row_id(df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("v")), ["v"], "at")
    n = known.count()
    if not n:
        return None
    return float(known.where(F.col("at").isin((n - 1) // 2, n // 2)).agg(F.avg(F.col("v").cast("double"))).first()[0])
