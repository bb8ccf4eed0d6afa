"""Indexers by kind of key, NumPy's float division, and operators that must not gather rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colkit.functions import arith
from colkit.functions import text as T
from colkit.functions.accessor import text, text_strict
from colkit.operators import encode, frame, nulls, rows
from colkit.operators.reduce import reduce

INF, NAN = float("inf"), float("nan")


def test_float_division_is_numpys(spark):
    values = [0.0, -0.0, 1.0, -1.0, 7.9, -7.9, 7.5, 2.5, 0.5, -0.5, 0.1, 0.3, 1e300, -1e300, 1e-300, 3.0, 2.0**60, INF, -INF, NAN]
    pairs = [(a, b) for a in values for b in values]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a double, b double")
    q, r = arith.divmod_(F.col("a"), F.col("b"), floating=True)
    got = df.select("k", q.alias("q"), r.alias("r")).orderBy("k").collect()
    with np.errstate(all="ignore"):
        for (a, b), row in zip(pairs, got, strict=True):
            want = np.floor_divide(a, b), np.remainder(a, b)
            assert np.array_equal([row["q"], row["r"]], want, equal_nan=True), (a, b, row, want)
    nulls_ = spark.createDataFrame([(None, 2.0), (2.0, None), (None, 0.0)], "a double, b double")
    assert all(x is None for r in nulls_.select(*arith.divmod_(F.col("a"), F.col("b"), floating=True)).collect() for x in r)


def test_floats_are_not_cut_silently(spark):
    df = spark.createDataFrame([(7.9, 7)], "a double, n int")
    with pytest.raises(Exception, match="floating=True"):
        df.select(arith.floordiv(F.col("a"), F.lit(0.5))).collect()
    assert df.select(arith.floordiv(F.col("n"), 2).alias("q"), arith.ufunc("mod", F.col("a"), F.lit(2.5), floating=True).alias("r")).first()["q"] == 3


def test_indexers(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(10)], "k int, v string").repartition(3)
    at = lambda key: [r["v"] for r in rows.index(df, key, ["k"], "v").orderBy("rid").collect()]
    assert rows.index(df, 3, ["k"], "v") == "v3" and rows.index(df, np.int64(-1), ["k"], "v") == "v9"
    assert at(slice(8, 2, -3)) == ["v8", "v5"]
    assert at([1, -1, 1]) == ["v1", "v9", "v1"] and at(np.array([2, 0])) == ["v2", "v0"]
    assert at([k % 4 == 0 for k in range(10)]) == ["v0", "v4", "v8"] and at([]) == []
    assert [r["v"] for r in rows.index(df, F.col("k") > 8, ["k"]).collect()] == ["v9"]
    for key in ("a", 1.5, None, [0.5], ["x"], [[0]], (1, 2), {1}, True, slice("a", None), [True]):
        with pytest.raises(IndexError):
            rows.index(df, key, ["k"], "v")
    with pytest.raises(IndexError):
        rows.index(df, [10], ["k"])


@pytest.mark.parametrize("key", [slice(2, 9, 3), slice(None, None, -2), slice(7, 3), slice(None)])
def test_slices_are_set_by_arithmetic(spark, key):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "k int, v double").repartition(3)
    want = np.arange(10.0)
    want[key] = -1
    assert [r["v"] for r in rows.setitem(df, "v", key, -1.0, ["k"]).orderBy("k").collect()] == want.tolist()
    n = len(range(*key.indices(10)))
    want[key] = np.arange(n)
    assert [r["v"] for r in rows.setitem(df, "v", key, [float(x) for x in range(n)], ["k"]).orderBy("k").collect()] == want.tolist()
    with pytest.raises(ValueError):
        rows.setitem(df, "v", key, [0.0] * (n + 1), ["k"])


@pytest.mark.parametrize("method,limit", [("ffill", None), ("bfill", None), ("ffill", 7), ("bfill", 7)])
def test_fills_over_blocks_and_spans(spark, monkeypatch, method, limit):
    import pandas as pd

    monkeypatch.setattr(nulls, "BLOCK", 3)
    monkeypatch.setattr(nulls, "SPAN", 2)
    rnd = np.random.default_rng(0)
    values = [float(k) if rnd.random() < 0.15 else None for k in range(90)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(4)
    want = getattr(pd.Series(values, dtype=float), method)(limit=limit)
    got = [r["v"] for r in nulls.fill_in_order(df, "v", ["k"], method=method, limit=limit).orderBy("k").collect()]
    assert np.array_equal(np.array(got, dtype=float), want.to_numpy(), equal_nan=True)


def test_duplicates_need_no_window(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(30)], "k int, v int").repartition(3)
    out = encode.duplicated(df, "v", "k")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    seen, want = set(), {}
    for k in range(30):
        v = None if k % 5 == 0 else k % 3
        want[k] = v in seen
        seen.add(v)
    assert {r["k"]: r["duplicated"] for r in out.collect()} == want


def test_median_by_position(spark):
    for values in ([5.0, 1.0, None, 3.0], [4.0, 1.0], [None], [2.0] * 7, []):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        known = [v for v in values if v is not None]
        assert reduce(df, "v", "median") == (float(np.median(known)) if known else None)
        assert reduce(df, "v", "median", skipna=False) == (float(np.median(known)) if known and len(known) == len(values) else None)


def test_split_to_the_widest_row(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b c d"), (3, None), (4, "")], "k int, s string")
    out = T.expand_rows(df, T.split(F.col("s"), " "), "k")
    assert out.columns == ["k", "0", "1", "2", "3"]
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == {1: ("a", "b", None, None), 2: ("a", "b", "c", "d"), 3: (None,) * 4, 4: ("", None, None, None)}
    assert T.expand_rows(df.where("k = 3"), T.split(F.col("s"), " "), "k").columns == ["k"]


def test_exact_classes_in_the_accessor(spark):
    texts = ["ⅷ", "ªº", "٣", "²", "ǅ", "中", "a1", "Ab", "", "\x1f"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    for name in ("isalnum", "isalpha", "isdecimal", "isdigit", "islower", "isnumeric", "isspace", "istitle", "isupper"):
        got = [r["v"] for r in df.select("k", getattr(text(F.col("s")), name)(exact=True).alias("v")).orderBy("k").collect()]
        assert got == [getattr(t, name)() for t in texts], name
    with pytest.raises(TypeError):
        text_strict(F.col("s")).isalpha(exact=True)


def test_frames_side_by_side_lists_and_null_positions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, b string")
    got = {tuple(r) for r in frame.concat_columns([a, b], "k").collect()}
    assert got == {(1, "x", None), (2, "y", "z"), (3, None, "w"), (None, "n", None)}
    assert frame.to_list(a, "a", ["a"]) == ["n", "x", "y"]
    df = spark.createDataFrame([(0, 5), (1, None), (2, 3)], "k int, v int")
    for place, want in (("first", [1, 2, 0]), ("last", [2, 0, 1])):
        assert [r["k"] for r in frame.argsort(df, "v", ["k"], na_position=place).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        frame.argsort(df, "v", ["k"], na_position="middle")


def test_reader_and_builder():
    import pyarrow as pa

    from colkit.functions.udf import Utf8Builder, Utf8Reader

    texts = ["é1", None, "", "日本"]
    for array in (pa.array(texts), pa.array(["x", *texts])[1:], pa.chunked_array([texts[:2], texts[2:]]), pa.array(texts, pa.large_string())):
        r = Utf8Reader(array)
        assert len(r) == 4 and r.is_null(1) and not r.is_null(2) and r.total_bytes() == 9
        assert [r.byte_length(i) for i in range(4)] == [3, 0, 0, 6] and r.text(0) == "é1" and bytes(r.view(3)) == "日本".encode()
    assert len(Utf8Reader(pa.array([], pa.string()))) == 0
    out = Utf8Builder()
    out.put(0x61)
    out.put(b"bc")
    out.end_text()
    out.put(b"lost")
    out.end_null()
    out.end_text()
    assert out.build().to_pylist() == ["abc", None, ""] and Utf8Builder().build().to_pylist() == []
    out.put(0xFF)
    out.end_text()
    with pytest.raises(pa.ArrowInvalid):
        out.build()


def test_texts_written_batch_by_batch(spark):
    from colkit.functions.udf import apply_utf8

    df = spark.createDataFrame([(k, None if k % 3 == 0 else f"t{k}") for k in range(10)], "k int, s string").repartition(3)

    def twice(texts, out):
        for i in range(len(texts)):
            out.put(texts.view(i))
            out.put(texts.view(i))
            out.end_null() if texts.is_null(i) else out.end_text()

    got = {r["k"]: r["v"] for r in df.select("k", apply_utf8(F.col("s"), func=twice).alias("v")).collect()}
    assert got == {k: None if k % 3 == 0 else f"t{k}" * 2 for k in range(10)}
    with pytest.raises(Exception, match="0 texts"):
        df.select(apply_utf8(F.col("s"), func=lambda texts, out: None)).collect()


def test_a_chain_numbers_its_rows_once(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(20)], "k int, v double").repartition(3)
    numbered = rows.with_row_id(df.orderBy(F.desc("k")), ["k"], "at")
    assert rows.getitem(numbered, "v", -2, "at") == 18.0
    picked = rows.take(numbered, spark.createDataFrame([(0, 3), (1, -1)], "pos int, idx int"), "at")
    assert sorted((r["pos"], r["v"]) for r in picked.collect()) == [(0, 3.0), (1, 19.0)]
    set_ = rows.setitem(numbered, "v", slice(0, 20, 5), -1.0, "at")
    moved = rows.shift(set_, "v", 1, "at").orderBy("k").collect()
    assert [r["shifted"] for r in moved] == [None] + [-1.0 if k % 5 == 0 else float(k) for k in range(19)]
    assert [r["v"] for r in nulls.fill_in_order(numbered.withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v"))), "v", "at").orderBy("k").collect()] == [float(k // 4 * 4) for k in range(20)]
