"""Queries that take every row of their tables, against plain Python."""

import math
import uuid
from collections import defaultdict

from colkit.plans.core_queries import QUERIES


def store(spark, **tables):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/whole-tables-{uuid.uuid4().hex}"
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def test_product_takes_all_orders(spark):
    rows = [(k, k * k % 41) for k in range(1, 1200)]
    want = defaultdict(list)
    for key, customer in rows:
        want[customer].append(1 + key % 3)
    path = store(spark, orders=(rows, "o_orderkey long, o_custkey long"))
    got = {r["o_custkey"]: r["p"] for r in QUERIES["reduce_prod_all_rows"](spark, path).collect()}
    assert got.keys() == want.keys()
    for customer, factors in want.items():
        assert math.isclose(got[customer], math.prod(factors), rel_tol=1e-12)


def test_outer_join_takes_all_rows(spark):
    customers, suppliers = [(k, k % 9) for k in range(40)], [(k, k % 11) for k in range(30)]
    path = store(spark, customer=(customers, "c_custkey long, c_nationkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int"))
    got = [tuple(r) for r in QUERIES["merge_outer_dups_all_rows"](spark, path).collect()]
    want = [(c, s) for c, a in customers for s, b in suppliers if a == b and a not in (3, 5)]
    want += [(c, None) for c, a in customers if a in (3, 5)] + [(None, s) for s, b in suppliers if b in (3, 5) or b > 8]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {c for c, _ in got} == {None, *range(40)} and {s for _, s in got} == {None, *range(30)}


def test_alignment_takes_all_rows(spark):
    nations, regions = [(k, f"n{k}") for k in range(25)], [(k, f"r{k}") for k in range(5)]
    path = store(spark, nation=(nations, "n_nationkey int, n_name string"), region=(regions, "r_regionkey int, r_name string"))
    got = [tuple(r) for r in QUERIES["align_all_rows"](spark, path).collect()]
    want = [(k if k > 3 else k + 100, f"n{k}", "r4" if k == 4 else None) for k in range(25)] + [(k, None, f"r{k}") for k in range(4)]
    assert sorted(got) == sorted(want)
