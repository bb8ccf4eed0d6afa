import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from colkit import types
from colkit.sources import io


@pytest.mark.parametrize("name", [*types.BY_NAME, "list<item: string>", "large_list<item: int64>", "chunked[int8]", "continuous[list<item: double>]"])
def test_names_have_types_and_types_have_names(name):
    kind = types.parse_dtype(name)
    assert types.parse_dtype(types.format_dtype(kind)) == kind


@pytest.mark.parametrize("name", ["int7", "", "list<item: x>", "struct<a: int8>"])
def test_unknown_names_are_type_errors(name):
    with pytest.raises(TypeError):
        types.parse_dtype(name)


def test_kinds_and_sizes():
    assert [types.kind_letter(types.parse_dtype(n)) for n in ("date32", "list<item: string>", "string", "int8", "double", "bool")] == ["O", "O", "U", "i", "f", "b"]
    assert types.itemsize(T.LongType()) == 8 and types.itemsize(T.StringType()) is None


def all_types() -> pa.Table:
    day, stamp = dt.date(2010, 9, 8), dt.datetime(2013, 12, 11, 10, 9, 8)
    cols = {n: pa.array([None, -1], t) for n, t in (("int8", pa.int8()), ("int16", pa.int16()), ("int32", pa.int32()), ("int64", pa.int64()))}
    cols |= {n: pa.array([None, 1], t) for n, t in (("uint8", pa.uint8()), ("uint16", pa.uint16()), ("uint32", pa.uint32()), ("uint64", pa.uint64()))}
    cols |= {"float16": pa.array([None, np.float16(-0.5)], pa.float16()), "float32": pa.array([None, -0.5], pa.float32()), "float64": pa.array([None, -0.1], pa.float64())}
    cols |= {"bool": pa.array([None, True]), "date32": pa.array([None, day], pa.date32()), "date64": pa.array([None, day], pa.date64()), "binary": pa.array([None, b"122"]), "string": pa.array([None, "🤔"])}
    cols |= {f"ts_{u}": pa.array([None, stamp], pa.timestamp(u)) for u in ("s", "ms", "us", "ns")}
    cols |= {f"d_{u}": pa.array([None, dt.timedelta(seconds=9)], pa.duration(u)) for u in ("s", "ms", "us", "ns")}
    cols |= {"list": pa.array([None, [None, "🤔"]]), "dict": pa.array([None, "a"]).dictionary_encode()}
    return pa.table(cols)


def test_all_types_come_and_go_in_two_partitions(spark):
    table = all_types()
    df = io.from_arrow(spark, table).repartition(2)
    rows = {r["int8"]: r for r in df.collect()}
    assert all(v is None for v in rows[None])
    got = rows[-1]
    assert got["ts_us"] == dt.datetime(2013, 12, 11, 10, 9, 8) and got["d_ms"] == dt.timedelta(seconds=9) and got["list"] == [None, "🤔"] and int(got["uint64"]) == 1 and got["dict"] == "a"
    assert df.schema["ts_ns"].dataType == T.TimestampNTZType()
    assert io.to_arrow(df).num_rows == 2


def test_examples_have_their_type(spark):
    for name in ("int8", "double", "date32", "timestamp[us]", "duration[us]", "binary", "string", "list<item: string>", "bool"):
        kind = types.parse_dtype(name)
        df = spark.createDataFrame([(x,) for x in types.examples(kind)], T.StructType([T.StructField("x", kind)]))
        assert df.count() == 2


def test_parquet_round_trip_with_chosen_columns(spark, tmp_path):
    table = pa.table({"str": pa.array(["a", None, "c"]), "int": pa.array([1, None, -2], pa.int32()), "bool": pa.array([True, None, False])})
    pq.write_table(table, tmp_path / "in.parquet")
    df = io.read_parquet(spark, str(tmp_path / "in.parquet"), ["str", "bool"])
    assert df.columns == ["str", "bool"]
    assert "ReadSchema: struct<str:string,bool:boolean>" in df._jdf.queryExecution().toString()
    io.write_parquet(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted([("a", True), (None, None), ("c", False)], key=str)


@pytest.mark.parametrize("make", [lambda: pa.array(["a", "b", "c"]), lambda: pa.chunked_array([["a"], ["b", "c"]]), lambda: pa.record_batch({"value": ["a", "b", "c"]}), lambda: pa.table({"value": ["a", "b", "c"]})])
def test_arrow_containers(spark, make):
    assert [r["value"] for r in io.from_arrow(spark, make()).collect()] == ["a", "b", "c"]


def test_other_containers_are_refused(spark):
    with pytest.raises(NotImplementedError):
        io.from_arrow(spark, {"a": [1]})
    with pytest.raises(ValueError):
        io.from_sequence(spark, None)


def test_missing_values_in_sequences_become_null(spark):
    df = io.from_sequence(spark, [1.5, float("nan"), None, np.float64(2)], "double")
    assert [r[0] for r in df.collect()] == [1.5, None, None, 2.0]
    assert io.metadata(df, "value") == {"size": 4, "shape": (4,), "ndim": 1, "dtype": "double", "nbytes": 32, "itemsize": 8}
    assert io.to_numpy(io.from_sequence(spark, [3, 4], "int64"), "value").tolist() == [3, 4]
