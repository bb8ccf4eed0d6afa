import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colkit.operators import encode, frame, rows

N = 30


@pytest.fixture(scope="module")
def df(spark):
    data = [(k, None if k % 7 == 0 else f"v{k % 5}", float(k)) for k in range(N)]
    return spark.createDataFrame(data, "k int, s string, x double").repartition(4)


VALUES = [None if k % 7 == 0 else f"v{k % 5}" for k in range(N)]


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(10_000).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    got = rows.with_row_id(df, ["key"]).orderBy("key").select("rid").collect()
    assert [r[0] for r in got] == list(range(10_000))
    assert rows.with_row_id(df.where("id < 0"), ["key"]).count() == 0


@pytest.mark.parametrize("i", [0, 5, -1, -N, N, -N - 1])
def test_getitem(df, i):
    assert rows.getitem(df, "k", i, ["k"]) == (i % N if -N <= i < N else None)


@pytest.mark.parametrize("cut", [(None, None, None), (2, 20, 3), (-5, None, 1), (None, None, -1), (20, 3, -4), (5, 5, 1), (100, None, 1)])
def test_slices(df, cut):
    got = rows.slice_rows(df, *cut, ["k"]).orderBy("rid").collect()
    assert [r["k"] for r in got] == list(range(N))[slice(*cut)]
    assert [r["rid"] for r in got] == list(range(len(got)))


def test_take(spark, df):
    def take(positions, **kw):
        idx = spark.createDataFrame([(p, i) for p, i in enumerate(positions)], "pos int, idx int")
        return [(r["k"], r["s"]) for r in rows.take(df.select("k", "s"), idx, ["k"], **kw).orderBy("pos").collect()]

    assert take([3, -1, 3, 0]) == [(3, VALUES[3]), (N - 1, VALUES[-1]), (3, VALUES[3]), (0, None)]
    assert take([3, -1], allow_fill=True) == [(3, VALUES[3]), (None, None)]
    # a genuine null stays null; only -1 is filled
    assert take([0, -1], allow_fill=True, fill_value="F") == [(0, None), (None, "F")]
    assert take([]) == []
    for bad, error, kw in (([N], IndexError, {}), ([-N - 1], IndexError, {}), ([-2], ValueError, {"allow_fill": True})):
        with pytest.raises(error):
            take(bad, **kw)
    with pytest.raises(ValueError):
        rows.take(df, spark.createDataFrame([(0, 1.5)], "pos int, idx double"), ["k"])
    with pytest.raises(IndexError):
        rows.take(df.where("k < 0"), spark.createDataFrame([(0, 0)], "pos int, idx int"), ["k"])


def test_take_of_lists(spark):
    data = spark.createDataFrame([(0, [1, 2]), (1, [None, 3]), (2, [4, 5])], "k int, v array<int>")
    idx = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "pos int, idx int")
    assert [r["v"] for r in rows.take(data, idx, ["k"]).orderBy("pos").collect()] == [[None, 3], [4, 5], [None, 3]]


def test_setitem(df):
    def assigned(key, value):
        return [r["s"] for r in rows.setitem(df.select("k", "s"), "s", key, value, ["k"]).orderBy("k").collect()]

    def by_hand(positions, new):
        out = list(VALUES)
        for p, v in zip(positions, new, strict=True):
            out[p] = v
        return out

    assert assigned(15, "X") == by_hand([15], ["X"])
    assert assigned([10, -1], ["a", None]) == by_hand([10, -1], ["a", None])
    assert assigned(slice(2, 8, 3), "Z") == by_hand([2, 5], ["Z", "Z"])
    assert assigned([3], [float("nan")]) == by_hand([3], [None])
    mask = F.when(F.col("k") % 7 != 0, F.col("k") > 20)
    assert assigned(mask, "M") == ["M" if k % 7 and k > 20 else v for k, v in enumerate(VALUES)]
    with pytest.raises(ValueError):
        assigned([1, 2], ["only one"])
    with pytest.raises(IndexError):
        assigned(N, "X")
    with pytest.raises(ValueError):
        rows.setitem(df.select("k", F.array("s").alias("l")), "l", [1], [["x"]], ["k"])


def test_shift_flatten_concat_cast(spark, df):
    for periods in (2, -3, 0):
        got = rows.shift(df.select("k", "x"), "x", periods, ["k"], fill_value=-1.0).orderBy("k").collect()
        assert [r["shifted"] for r in got] == pd.Series(np.arange(float(N))).shift(periods, fill_value=-1.0).tolist()
    lists = spark.createDataFrame([(0, [1, 2]), (1, None), (2, []), (3, [3, None])], "k int, l array<int>")
    assert [r["value"] for r in rows.flatten(lists, "l", "k").orderBy("k", "pos").collect()] == [1, 2, 3, None]
    both = rows.concat(spark.range(2).select(F.col("id").cast("int").alias("v")), spark.range(1).select(F.col("id").alias("v")))
    assert sorted(map(tuple, both.collect())) == [(0, 0), (0, 1), (1, 0)] or sorted((r["part"], r["v"]) for r in both.collect()) == [(0, 0), (0, 1), (1, 0)]
    texts = spark.createDataFrame([(["a", None],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in texts.select(rows.cast(F.col("l"), "string", T.ArrayType(T.StringType()))).collect()] == ["['a', None]", "[]", None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.where("s is not null").select(rows.cast(F.col("s"), "int")).collect()


def test_encoding(spark, df):
    firsts = {r["s"]: r["first_at"] for r in encode.unique(df, "s", "k").collect()}
    assert firsts == {v: VALUES.index(v) for v in set(VALUES)}
    codes, uniques = pd.factorize(np.array(VALUES, dtype=object))
    assert [r["code"] for r in encode.factorize(df, "s", "k").orderBy("k").collect()] == codes.tolist()
    counts = {r["s"]: r["count"] for r in encode.value_counts(df, "s", dropna=False).collect()}
    assert counts == {v: VALUES.count(v) for v in set(VALUES)}
    assert None not in {r["s"] for r in encode.value_counts(df, "s").collect()}
    assert sum(r["count"] for r in encode.value_counts(df, "s", normalize=True).collect()) == pytest.approx(1)
    assert [r["duplicated"] for r in encode.duplicated(df, "s", "k").orderBy("k").collect()] == pd.Series(VALUES).duplicated().tolist()
    assert encode.contains_value(df, "s", None) and encode.contains_value(df, "s", "v1") and not encode.contains_value(df, "s", "no")


def test_get_dummies(spark):
    df = spark.createDataFrame([(0, "a|b"), (1, None), (2, "a|c")], "k int, s string")
    got = encode.get_dummies(df, "s", "k").orderBy("k")
    assert got.columns == ["k", "a", "b", "c"]
    assert [tuple(r)[1:] for r in got.collect()] == [(1, 1, 0), (0, 0, 0), (1, 0, 1)]
    with pytest.raises(ValueError):
        encode.get_dummies(df, "s", most=2)


def test_groups_drop_null_keys(spark):
    df = spark.createDataFrame([("a", 10), ("a", 5), ("b", 24), (None, 6)], "s string, v int")
    assert sorted(map(tuple, frame.group_agg(df, ["s"], {"t": F.sum("v")}).collect())) == [("a", 15), ("b", 24)]
    assert sorted(r["t"] for r in frame.group_transform(df, ["s"], F.sum("v"), "t").collect()) == [6, 15, 15, 24]
    applied = frame.group_apply(df.dropna(), ["s"], lambda p: p.assign(v=p["v"] * 2), "s string, v int")
    assert sorted(r["v"] for r in applied.collect()) == [10, 20, 48]


def test_joins_match_nulls(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "ka string, a int")
    b = spark.createDataFrame([("x", 10), ("x", 11), (None, 20), ("z", 30)], "kb string, b int")
    assert sorted((r["a"], r["b"]) for r in frame.merge(a, b, "ka", "kb").collect()) == [(1, 10), (1, 11), (2, 20)]
    outer = frame.merge(a, b, "ka", "kb", "full").select("a", "b").collect()
    assert sorted(map(tuple, outer), key=str) == sorted([(1, 10), (1, 11), (2, 20), (3, None), (None, 30)], key=str)


def test_orders(spark, df):
    data = spark.createDataFrame([(0, "B"), (1, None), (2, "A"), (3, "B")], "k int, v string")
    assert [r["k"] for r in frame.sort_values(data, "v", tie="k").collect()] == [2, 0, 3, 1]
    assert [r["k"] for r in frame.sort_values(data, "v", ascending=False, tie="k").collect()] == [0, 3, 2, 1]
    assert {r["k"]: r["rank"] for r in frame.argsort(data, "v", ["k"]).collect()} == {2: 0, 0: 1, 3: 2, 1: 3}
    row = data.agg(frame.argmin(F.col("v"), F.col("k")).alias("lo"), frame.argmax(F.col("v"), F.col("k")).alias("hi"), frame.searchsorted(F.col("v"), "B").alias("at")).first()
    assert tuple(row) == (2, 0, 1)


def test_alignment_and_reshaping(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, frame.align(a, b, "k", ("x", "y")).collect())) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    keys = spark.createDataFrame([(2,), (9,)], "k int")
    assert sorted(map(tuple, frame.reindex(a, "k", keys, "none").collect())) == [(2, "b"), (9, "none")]
    long = frame.stack(a.withColumn("w", F.upper("v")), "k", ["v", "w"])
    assert sorted(map(tuple, long.collect())) == [(1, "v", "a"), (1, "w", "A"), (2, "v", "b"), (2, "w", "B")]
    assert sorted(map(tuple, frame.unstack(long, "k", "column", "value", ["v", "w"]).collect())) == [(1, "a", "A"), (2, "b", "B")]
    assert frame.equals(a, a.repartition(3)) and not frame.equals(a, b)
    assert sorted(r["k"] for r in frame.repeat(a, 2).collect()) == [1, 1, 2, 2]
    assert [r["k"] for r in frame.delete(a, [0], ["k"]).collect()] == [2]
    got = a.select(frame.where(F.col("v"), F.col("k") > 1, "-"), frame.combine_first(F.lit(None).cast("string"), F.col("v")), frame.replace_values(F.col("v"), ["a"], "z")).collect()
    assert sorted(map(tuple, got)) == [("-", "a", "z"), ("b", "b", "b")]
    assert [r["diff"] for r in frame.diff(a.select("k"), "k", 1, ["k"]).orderBy("k").collect()] == [None, 1]


def test_stateless_functions_work_on_streams(spark, tmp_path):
    from colkit.functions.accessor import text_strict
    from colkit.streaming.stateless import read_parquet_stream, with_columns

    source = spark.createDataFrame([("ab",), (None,), ("b",)], "s string")
    source.write.parquet(str(tmp_path / "in"))
    stream = with_columns(read_parquet_stream(spark, str(tmp_path / "in"), source.schema), c=text_strict(F.col("s")).contains("a"))
    query = stream.writeStream.format("memory").queryName("out_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["c"] for r in spark.table("out_stream").collect()), key=str) == [False, None, True]
