"""Reading and writing: Parquet, Arrow, Python sequences, NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import normalize_arrow_table, parse_dtype


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The file or folder at ``path``; only ``columns`` are read.  Filters that follow are pushed into the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_parquet(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Columns without a type (all null) are written as text, which Parquet can hold."""
    void = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)}
    df.withColumns(void).write.mode(mode).partitionBy(*partition_by).parquet(path)


def from_arrow(spark: SparkSession, data: pa.Table | pa.RecordBatch | pa.Array | pa.ChunkedArray, name: str = "value") -> DataFrame:
    """A table or record batch as it is, an array as the one column ``name``."""
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif isinstance(data, (pa.Array, pa.ChunkedArray)):
        data = pa.table({name: data})
    elif not isinstance(data, pa.Table):
        raise NotImplementedError(f"no frame from {type(data).__name__}")
    plain = normalize_arrow_table(data)
    df = spark.createDataFrame(plain)
    naive = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in plain.schema if pa.types.is_timestamp(f.type) and f.type.tz is None}
    return df.withColumns(naive) if naive else df


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows as one Arrow table on the driver: for results, not for tables at scale."""
    return df.toArrow()


def to_numpy(df: DataFrame, column: str):
    return df.select(column).toPandas()[column].to_numpy()


def from_sequence(spark: SparkSession, values: Sequence, dtype: str | T.DataType | None = None, name: str = "value") -> DataFrame:
    """A one-column frame; None, NaN and NA among plain values become null.  ``dtype``: an Arrow type name or a Spark type."""
    if values is None:
        raise ValueError("an array or a sequence is needed")
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return from_arrow(spark, values, name)
    clean = [None if x is None or (isinstance(x, float) and x != x) or type(x).__name__ in ("NAType", "NaTType") else x.item() if hasattr(x, "item") and not isinstance(x, (list, str)) else x for x in values]
    kind = parse_dtype(dtype) if isinstance(dtype, str) else dtype
    if kind is None:
        return from_arrow(spark, pa.array(clean), name)
    return spark.createDataFrame([(x,) for x in clean], T.StructType([T.StructField(name, kind, True)]))


def metadata(df: DataFrame, column: str) -> dict:
    """size, shape, ndim, dtype and bytes of a column, by one aggregation."""
    from ..types import format_dtype, itemsize

    kind = df.schema[column].dataType
    width = itemsize(kind)
    c = F.col(column)
    used = F.sum(F.octet_length(c)) if width is None and isinstance(kind, (T.StringType, T.BinaryType)) else F.count("*") * (width or 0)
    row = df.agg(F.count("*").alias("n"), F.coalesce(used, F.lit(0)).alias("bytes")).first()
    return {"size": row["n"], "shape": (row["n"],), "ndim": 1, "dtype": format_dtype(kind), "nbytes": row["bytes"], "itemsize": width}
