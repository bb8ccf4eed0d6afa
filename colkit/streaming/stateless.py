"""Streams.  Every function in ``colkit.functions`` is a stateless expression and works on a streaming frame as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Operators that need an order of all rows and so a table that ends.
POSITIONAL = ("with_row_id", "take", "slice_rows", "shift", "fill_in_order", "factorize", "argsort")


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def with_columns(stream: DataFrame, **columns: Column) -> DataFrame:
    """Adds stateless expressions to a streaming or static frame."""
    return stream.withColumns(columns)
