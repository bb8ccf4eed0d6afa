"""Column types: names, their Spark types, the way from Arrow, and sample values."""

from __future__ import annotations

import datetime as dt
import decimal

import pyarrow as pa
from pyspark.sql import types as T

#: Arrow's name of each plain type and its Spark type (fixed values).  Unsigned types widen to what holds them.
BY_NAME: dict[str, T.DataType] = {
    "null": T.NullType(),
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "date32": T.DateType(),
    "date32[day]": T.DateType(),
    "date64": T.DateType(),
    "date64[ms]": T.DateType(),
    "binary": T.BinaryType(),
    "string": T.StringType(),
    "utf8": T.StringType(),
    "large_string": T.StringType(),
    "large_binary": T.BinaryType(),
    **{f"timestamp[{unit}]": T.TimestampNTZType() for unit in ("s", "ms", "us", "ns")},
    **{f"duration[{unit}]": T.DayTimeIntervalType() for unit in ("s", "ms", "us", "ns")},
}


def parse_dtype(name: str) -> T.DataType:
    """The Spark type of an Arrow type name, which may be wrapped as ``layout[name]`` or in ``list<item: name>``."""
    if not isinstance(name, str):
        raise TypeError(f"a type name is needed, not {type(name).__name__}")
    for layout in ("chunked", "continuous"):
        if name.startswith(f"{layout}[") and name.endswith("]"):
            return parse_dtype(name[len(layout) + 1 : -1])
    for kind in ("list", "large_list"):
        if name.startswith(f"{kind}<") and name.endswith(">"):
            return T.ArrayType(parse_dtype(name[len(kind) + 1 : -1].partition(": ")[2] or name[len(kind) + 1 : -1]), True)
    try:
        return BY_NAME[name]
    except KeyError:
        raise TypeError(f"unknown type {name!r}") from None


def format_dtype(kind: T.DataType) -> str:
    """The Arrow name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"list<item: {format_dtype(kind.elementType)}>"
    if isinstance(kind, T.DecimalType):
        return "uint64" if (kind.precision, kind.scale) == (20, 0) else f"decimal128({kind.precision}, {kind.scale})"
    own = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.TimestampNTZType: "timestamp[us]", T.DayTimeIntervalType: "duration[us]", T.DateType: "date32[day]", T.StringType: "string", T.BinaryType: "binary", T.BooleanType: "bool", T.NullType: "null"}
    try:
        return own[type(kind)]
    except KeyError:
        raise TypeError(f"no name for {kind.simpleString()}") from None


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def kind_letter(kind: T.DataType) -> str:
    """NumPy's kind: O for dates and lists, U for text."""
    if isinstance(kind, (T.DateType, T.ArrayType)):
        return "O"
    for types, letter in ((T.StringType, "U"), (T.BooleanType, "b"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "i"), ((T.FloatType, T.DoubleType), "f"), (T.TimestampNTZType, "M"), (T.DayTimeIntervalType, "m"), (T.BinaryType, "S")):
        if isinstance(kind, types):
            return letter
    return "O"


def itemsize(kind: T.DataType) -> int | None:
    """Bytes of a value; None where it varies."""
    sizes = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampNTZType: 8, T.DayTimeIntervalType: 8}
    return sizes.get(type(kind))


def example(kind: T.DataType):
    """A sample value of the type."""
    if isinstance(kind, T.ArrayType):
        return [None, example(kind.elementType)]
    samples = {
        T.NullType: None, T.BooleanType: True, T.ByteType: -1, T.ShortType: -1, T.IntegerType: -1, T.LongType: -1, T.FloatType: -0.1, T.DoubleType: -0.1,
        T.DateType: dt.date(2010, 9, 8), T.TimestampNTZType: dt.datetime(2013, 12, 11, 10, 9, 8), T.DayTimeIntervalType: dt.timedelta(seconds=9),
        T.BinaryType: b"122", T.StringType: "\N{THINKING FACE}", T.DecimalType: decimal.Decimal(1),
    }
    try:
        return samples[type(kind)]
    except KeyError:
        raise TypeError(f"no sample of {kind.simpleString()}") from None


def examples(kind: T.DataType) -> list:
    """Two rows: a null and a sample, for testing with partitioned data."""
    return [None, example(kind)]


def plain_arrow_type(kind: pa.DataType) -> pa.DataType:
    """The nearest Arrow type that Spark takes, without loss where there is one."""
    t = pa.types
    if t.is_dictionary(kind):
        return plain_arrow_type(kind.value_type)
    if t.is_list(kind) or t.is_large_list(kind):
        return pa.list_(plain_arrow_type(kind.value_type))
    if t.is_large_string(kind):
        return pa.string()
    if t.is_large_binary(kind):
        return pa.binary()
    for test, plain in ((t.is_uint8, pa.int16()), (t.is_uint16, pa.int32()), (t.is_uint32, pa.int64()), (t.is_uint64, pa.decimal128(20, 0)), (t.is_float16, pa.float32()), (t.is_date64, pa.date32())):
        if test(kind):
            return plain
    if t.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if t.is_duration(kind):
        return pa.duration("us")
    return kind


def normalize_arrow_table(table: pa.Table) -> pa.Table:
    """Columns cast to types that Spark takes; nanoseconds are cut to microseconds."""
    columns = []
    for field, column in zip(table.schema, table.columns, strict=True):
        plain = plain_arrow_type(field.type)
        if pa.types.is_uint64(field.type):
            column = pa.chunked_array([pa.array([None if x is None else decimal.Decimal(x) for x in c.to_pylist()], plain) for c in column.chunks], plain)
        elif field.type != plain:
            column = column.cast(plain, safe=False)
        columns.append(column)
    return pa.table(columns, names=table.schema.names)
