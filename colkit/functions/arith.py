"""Arithmetic and comparison with NumPy's rules, as Column expressions.

Null propagates.  ``add``, ``subtract`` and ``multiply`` have the wider of their inputs' types, as in NumPy; an integer overflow is an
error (ANSI) where NumPy would wrap, so narrow columns whose results may not fit are cast to bigint first (``wide``).  Floor division and
remainder work in bigint, or with ``floating`` in double precision; the remainder has the divisor's sign.  A zero
divisor gives 0 for integers, an infinity or NaN in floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boolean import any_

INF, NAN = float("inf"), float("nan")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wide(x) -> Column:
    """An integer column as bigint."""
    return _col(x).cast("bigint")


def _whole(x) -> Column:
    """As bigint; values of a floating-point type are an error, as their fractions would be lost."""
    c = _col(x)
    told = F.raise_error(F.lit("floor division of floating-point values needs floating=True")).cast("bigint")
    return F.when(F.typeof(c).isin("float", "double") & c.isNotNull(), told).otherwise(c.cast("bigint"))


def add(a, b) -> Column:
    return _col(a) + _col(b)


def subtract(a, b) -> Column:
    return _col(a) - _col(b)


def multiply(a, b) -> Column:
    return _col(a) * _col(b)


def _float_divmod(a, b) -> tuple[Column, Column]:
    """Quotient and remainder in double precision, both from the exact remainder of the division."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    safe = F.nullif(b, F.lit(0.0))
    rest = a % safe
    off = (rest != 0) & ((safe < 0) != (rest < 0)) & ~F.isnan(rest)
    quotient = (a - rest) / safe - off.cast("double")
    down = F.when(F.abs(quotient) < 2.0**53, F.floor(quotient).cast("double")).otherwise(quotient)
    down = down + F.when(quotient - down > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    remainder = F.when(b == 0, F.when(a.isNotNull(), F.lit(NAN))).otherwise(F.when(off, rest + safe).otherwise(rest))
    return F.when(b == 0, truediv(a, b)).otherwise(down), remainder


def floordiv(a, b, floating: bool = False) -> Column:
    """Towards minus infinity.  Integers: 0 for a zero divisor; ``floating``: as ``truediv`` there."""
    if floating:
        return _float_divmod(a, b)[0]
    a, b = _whole(a), _whole(b)
    safe = F.nullif(b, F.lit(0).cast("bigint"))
    quotient = F.call_function("div", a, safe)
    down = ((a % safe != 0) & ((a < 0) != (safe < 0))).cast("bigint")
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(quotient - down)


def mod(a, b, floating: bool = False) -> Column:
    """The remainder has the divisor's sign.  Integers: 0 for a zero divisor; ``floating``: NaN there."""
    if floating:
        return _float_divmod(a, b)[1]
    a, b = _whole(a), _whole(b)
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0).cast("bigint"))).otherwise(a - b * floordiv(a, b))


def divmod_(a, b, floating: bool = False) -> tuple[Column, Column]:
    return floordiv(a, b, floating), mod(a, b, floating)


def truediv(a, b) -> Column:
    """In double precision; x / 0 is an infinity of x's sign (the other one for -0.0), 0 / 0 is NaN."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    infinity = F.when((b == 0) & b.cast("string").startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))
    zero = F.when(F.isnan(a), F.lit(NAN)).when(a > 0, infinity).when(a < 0, -infinity).when(a == 0, F.lit(NAN))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def power(a, b, integral: bool = False) -> Column:
    """Integers stay integers where ``integral`` says so; a negative exponent is then an error."""
    if not integral:
        return F.pow(_col(a), _col(b))
    e = F.when(_col(b) < 0, F.raise_error(F.lit("Integers to negative integer powers are not allowed.")).cast("bigint")).otherwise(wide(b))
    return F.pow(_col(a), e).cast("bigint")


def negative(a) -> Column:
    return -_col(a)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def maximum(a, b) -> Column:
    """Null if either is (``greatest`` skips nulls)."""
    a, b = _col(a), _col(b)
    return _both(a, b, F.greatest(a, b))


def minimum(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _both(a, b, F.least(a, b))


_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def compare(op: str, a, b, numeric: bool) -> Column:
    """Numbers: null propagates.  Other types: never null; a null is unequal to all and in no order."""
    plain = _COMPARE[op](_col(a), _col(b))
    return plain if numeric else F.coalesce(plain, F.lit(op == "!="))


def isnan(a) -> Column:
    """The missing-value test that the ufunc ``isnan`` stands for: true for null, not for NaN."""
    return _col(a).isNull()


_UFUNCS = {
    "add": add, "subtract": subtract, "multiply": multiply, "divide": truediv, "true_divide": truediv, "floor_divide": floordiv, "remainder": mod, "mod": mod,
    "power": power, "maximum": maximum, "minimum": minimum, "equal": lambda a, b: compare("==", a, b, True), "not_equal": lambda a, b: compare("!=", a, b, True),
    "less": lambda a, b: compare("<", a, b, True), "less_equal": lambda a, b: compare("<=", a, b, True), "greater": lambda a, b: compare(">", a, b, True),
    "greater_equal": lambda a, b: compare(">=", a, b, True),
}


def ufunc(name: str, *inputs, out=None, **kwargs) -> Column:
    """The binary ufuncs by name, ``isnan`` and the aggregate ``logical_or.reduce``; anything else is not implemented.  ``floating`` is for the divisions."""
    floating = kwargs.pop("floating", False)
    if out is not None or kwargs:
        raise NotImplementedError("columns are immutable and take no ufunc options")
    if name == "isnan" and len(inputs) == 1:
        return isnan(inputs[0])
    if name == "logical_or.reduce" and len(inputs) == 1:
        return any_(inputs[0])
    if len(inputs) != 2 or name not in _UFUNCS:
        raise NotImplementedError(f"ufunc {name} with {len(inputs)} inputs")
    if floating and _UFUNCS[name] in (floordiv, mod):
        return _UFUNCS[name](*inputs, floating=True)
    return _UFUNCS[name](*inputs)
