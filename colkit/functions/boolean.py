"""Three-valued OR, and any / all with the null rules of a nullable boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType


def check_boolean(kind: DataType) -> None:
    if not isinstance(kind, BooleanType):
        raise NotImplementedError("only booleans can be joined by |")


def or_(a: Column, b) -> Column:
    """Kleene: true wins over null, null wins over false.  ``b`` may be a column, None, True or False."""
    if b is None:
        return a | F.lit(None).cast("boolean")
    if b is True:
        return F.lit(True)
    if b is False:
        return a
    return a | b


def all_true_like(a: Column) -> Column:
    """True wherever ``a`` is not null."""
    return F.when(a.isNotNull(), F.lit(True))


def any_(a: Column, skipna: bool = False) -> Column:
    """An aggregate.  Without ``skipna`` a null counts as true; no rows: false."""
    return F.coalesce(F.bool_or(a if skipna else F.coalesce(a, F.lit(True))), F.lit(False))


def all_(a: Column, skipna: bool = False) -> Column:
    """An aggregate.  Nulls are ignored, whatever ``skipna`` says; no rows: true."""
    return F.coalesce(F.bool_and(a), F.lit(True))
