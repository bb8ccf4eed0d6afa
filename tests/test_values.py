"""Arithmetic, booleans, nulls and reductions against Python, NumPy and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colkit.functions import arith, boolean
from colkit.operators import nulls
from colkit.operators.reduce import exact_product, reduce

A, B = F.col("a"), F.col("b")


def frame(spark, rows, kinds="a bigint, b bigint"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + kinds).repartition(3)


def values(df, *cols):
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in sorted(df.select("i", *cols).collect())]


def test_addition_with_nulls(spark):
    rows = [(1, 1), (2, 2), (3, 3), (None, 4), (None, None)]
    df = frame(spark, rows)
    assert values(df, arith.add(A, B)) == values(df, arith.add(B, A)) == [2, 4, 6, None, None]
    assert values(df, arith.add(A, 4)) == [5, 6, 7, None, None]


def test_integer_division_has_numpys_signs(spark):
    rows = [(a, b) for a in range(-7, 8) for b in range(-3, 4)] + [(None, 1), (1, None), (None, 0), (2**53 + 1, -2)]
    q, r = arith.divmod_(A, B)
    for (a, b), (x, y) in zip(rows, values(frame(spark, rows), q.alias("q"), r.alias("r")), strict=True):
        if a is None or b is None:
            assert (x, y) == (None, None)
        else:
            assert (x, y) == ((0, 0) if b == 0 else divmod(a, b))


def test_true_division_by_zero(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    got = values(frame(spark, rows, "a double, b double"), arith.truediv(A, B))
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, None, 1.5]


def test_power_and_ufuncs(spark):
    df = frame(spark, [(2, 10), (3, 0), (None, 2)])
    assert values(df, arith.power(A, B, integral=True)) == [1024, 1, None]
    assert values(df, arith.ufunc("maximum", A, B)) == [10, 3, None]
    assert values(df, arith.ufunc("isnan", A)) == [False, False, True]
    assert values(df, arith.ufunc("less", A, B)) == [True, False, None]
    for bad in (lambda: arith.ufunc("sin", A), lambda: arith.ufunc("add", A, B, A), lambda: arith.ufunc("add", A, B, out=A), lambda: arith.ufunc("add", A, B, where=A)):
        with pytest.raises(NotImplementedError):
            bad()
    with pytest.raises(Exception, match="negative integer powers"):
        values(frame(spark, [(2, -1)]), arith.power(A, B, integral=True))


def test_comparison_of_text_is_never_null(spark):
    rows = [("a", "a"), ("a", "b"), ("b", None), (None, "a"), (None, None)]
    df = frame(spark, rows, "a string, b string")
    want = pd.Series([r[0] for r in rows], dtype=object), pd.Series([r[1] for r in rows], dtype=object)
    assert values(df, arith.compare("==", A, B, numeric=False)) == [x is not None and x == y for x, y in zip(*want, strict=True)]
    assert values(df, arith.compare("!=", A, B, numeric=False)) == [False, True, True, True, True]
    assert values(df, arith.compare("<", A, B, numeric=False)) == [False, True, False, False, False]
    assert values(df, arith.compare("<", A, B, numeric=True)) == [False, True, None, None, None]


T_, N_, F_ = True, None, False


@pytest.mark.parametrize("left,right,want", [([T_, F_], N_, [T_, N_]), ([T_, F_, N_], N_, [T_, N_, N_]), ([T_, F_, N_], True, [T_, T_, T_]), ([T_, F_, N_], False, [T_, F_, N_])])
def test_or_with_scalars(spark, left, right, want):
    df = frame(spark, [(x, None) for x in left], "a boolean, b boolean")
    assert values(df, boolean.or_(A, right)) == want


def test_or_of_columns(spark):
    rows = [(T_, F_), (F_, T_), (N_, F_), (N_, T_), (T_, N_), (F_, N_), (N_, N_)]
    df = frame(spark, rows, "a boolean, b boolean")
    assert values(df, boolean.or_(A, B)) == [T_, T_, N_, T_, T_, N_, N_]
    assert values(df, boolean.all_true_like(A)) == [T_, T_, N_, N_, T_, T_, N_]
    with pytest.raises(NotImplementedError):
        boolean.check_boolean(frame(spark, [(1, 2)]).schema["a"].dataType)


@pytest.mark.parametrize("data", [[], [T_], [F_], [N_], [T_, F_, N_], [F_, F_, F_], [T_] * 10, [T_, N_], [F_, N_]])
def test_any_and_all(spark, data):
    df = frame(spark, [(x, None) for x in data], "a boolean, b boolean")
    known = [x for x in data if x is not None]
    assert reduce(df, "a", "any", skipna=True) == any(known)
    assert reduce(df, "a", "any", skipna=False) == (any(known) or len(known) < len(data))
    assert reduce(df, "a", "all", skipna=True) == reduce(df, "a", "all", skipna=False) == all(known)


@pytest.mark.parametrize("name", ["sum", "prod", "max", "min", "std", "var", "skew", "kurt", "median"])
@pytest.mark.parametrize("data", [[1.5, None, -3.0, 4.0, 4.0, 9.25, None], [2.0, 3.0, 5.0, 7.0]])
def test_reductions_equal_pandas(spark, name, data):
    df = frame(spark, [(x, None) for x in data], "a double, b double")
    assert reduce(df, "a", name) == pytest.approx(getattr(pd.Series(data, dtype="float64"), name)())
    if None in data:
        assert reduce(df, "a", name, skipna=False) is None


def test_reductions_of_nothing(spark):
    df = frame(spark, [(None, None)], "a double, b double")
    assert reduce(df, "a", "sum") == 0 and reduce(df, "a", "prod") == 1
    for name in ("max", "min"):
        with pytest.raises(ValueError):
            reduce(df, "a", name)
    for name in ("median", "std", "skew", "kurt"):
        assert reduce(df, "a", name) is None
    assert reduce(frame(spark, [(1.0, None), (None, None)], "a double, b double"), "a", "mean_all_rows") == 0.5
    with pytest.raises(TypeError):
        reduce(df, "a", "sem")
    with pytest.raises(TypeError):
        reduce(frame(spark, [("x", "y")], "a string, b string"), "a", "sum")
    with pytest.raises(TypeError):
        reduce(df, "a", "any")


def test_nan_in_extremes_and_exact_products(spark):
    df = frame(spark, [(1.0, None), (float("nan"), None)], "a double, b double")
    assert math.isnan(reduce(df, "a", "min")) and math.isnan(reduce(df, "a", "max"))
    big = frame(spark, [(2**31, None), (2**31 + 1, None)])
    assert int(big.agg(exact_product(A)).first()[0]) == 2**31 * (2**31 + 1)


@pytest.mark.parametrize("method", ["ffill", "bfill", "pad", "backfill"])
@pytest.mark.parametrize("limit", [None, 1, 2])
def test_fills_in_order(spark, monkeypatch, method, limit):
    monkeypatch.setattr("colkit.operators.nulls.BLOCK", 4)  # many blocks
    rng = np.random.default_rng(3)
    data = [None if rng.random() < 0.6 else float(k) for k in range(60)]
    df = frame(spark, [(x, None) for x in data], "a double, b double")
    got = values(nulls.fill_in_order(df, "a", ["i"], method=method, limit=limit), A)
    want = getattr(pd.Series(data), {"pad": "ffill", "backfill": "bfill"}.get(method, method))(limit=limit)
    assert got == [None if pd.isna(x) else x for x in want]


def test_fill_arguments(spark):
    df = frame(spark, [("x", "y"), (None, "z")], "a string, b string")
    assert values(df, nulls.fillna(A, "filled")) == ["x", "filled"]
    assert values(df, nulls.fillna(A, B)) == ["x", "z"]
    assert values(df, nulls.isna(A), nulls.notna(A)) == [(False, True), (True, False)]
    for value, method in ((None, None), (1, "ffill"), (None, "sideways")):
        with pytest.raises(ValueError):
            nulls.validate_fill(value, method)
