import os

import numpy as np
import pytest

from colkit.llm import ann
from colkit.llm.ann import probe_steps, search


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v))
    out = {}
    for q, x in good.items():
        if q % every == 0:
            scored = sorted((-float(x @ y / np.sqrt((x @ x) * (y @ y))), i) for i, y in good.items() if i != q and y.size == x.size)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_probe_order_is_by_cost():
    low = np.array([0.1, 0.9, 0.4])
    steps = list(probe_steps(low, 1.0, 100))
    cost = [sum(low[i] ** 2 if d < 0 else (1 - low[i]) ** 2 for i, d in s) for s in steps]
    assert len(set(steps)) == len(steps) == 27 and cost == sorted(cost) and steps[0] == ()


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = brute(rows, 25, 5)
    got: dict = {}
    for r in search(df, every=25, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    vec = dict(rows)
    for q, found in got.items():
        assert len(found) == 5 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            x, y = np.array(vec[q]), np.array(vec[i])
            assert s == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-12)


def test_odd_rows_ties_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [-1.0, 0.2]), (20, [2.0, 0.1]), (30, [1.0, 2.0, 3.0]), (40, [1e300, 1e300]), (10, [-1.0, 0.2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, key int")
    got: dict = {}
    for r in search(df, every=10, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [1, 2, 20]
    assert [i for i, _ in got[40]][:1] == [3] and got[40][0][1] == pytest.approx(1.0)
    assert 30 not in got and len(got[10]) == 3 and len(got[20]) == 3
    assert [i for i, _ in got[20]] == [0, 1, 2]
    assert search(df.where("vec_id = 0"), every=10, k=3).count() == 0
    assert search(df.where("vec_id = 77"), every=10, k=3).count() == 0


def test_a_vector_that_most_rows_share(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(300)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=4).collect()
    assert len(got) == 6 * 4
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50] == [1, 2, 4, 5]


def test_ids_with_several_vectors(spark, monkeypatch):
    """An id is as near as the nearest of its vectors; many vectors of one id crowd out no other id."""
    monkeypatch.setattr(ann, "BLOCK", 6)
    rng = np.random.default_rng(2)
    rows = [(7, [1.0, 0.1, 0.0]), (7, [-1.0, 0.0, 0.1]), (8, [-1.0, 0.0, 0.1])] + [(9, [1.0, 0.1, 1e-3 * k]) for k in range(12)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(10, 31)] + [(20, rng.normal(size=3).tolist()), (20, rng.normal(size=3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want: dict = {}
    for q, x in rows:
        for i, y in rows:
            if i != q and (q % 10 == 0 or q == 7):
                x, y = np.array(x), np.array(y)
                s = float(x @ y / np.sqrt((x @ x) * (y @ y)))
                want.setdefault(q, {})[i] = max(s, want.get(q, {}).get(i, -2))
    for every, asked in ((7, {7}), (10, {10, 20, 30})):
        got: dict = {}
        for r in search(df, every=every, k=4, width=100.0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in asked:
            best = sorted(want[q].items(), key=lambda x: (-x[1], x[0]))[:4]
            assert [i for i, _ in got[q]] == [i for i, _ in best]
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in best], abs=1e-12)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.1", "/root/testdata/check_l"])
def test_recall_on_the_given_tables(spark, sf_dir):
    """Recall at 5 with production parameters, measured against exact search over all rows."""
    path = f"{sf_dir}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no such table")
    vectors = spark.read.parquet(path)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    unit = np.stack([good[i] / np.sqrt(good[i] @ good[i]) for i in ids])
    got: dict = {}
    for r in search(vectors, every=50, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = asked = 0
    for k in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[k]
        score[k] = -2
        hits += len(set(ids[np.lexsort((ids, -score))[:5]].tolist()) & got[int(ids[k])])
        asked += 5
    assert hits >= 0.9 * asked, hits / asked
    print(f"recall at 5 on {len(ids)} rows: {hits / asked:.3f}")
