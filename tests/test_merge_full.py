"""Full outer merges of keys with many rows on both sides."""

import itertools
import os
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colkit.operators import frame

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: 9 million pairs of one key, which no heap of 512 MB holds, and rows of both sides without a match.
LARGE = """
from pyspark.sql import SparkSession, functions as F
from colkit.operators import frame
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
left = spark.range(3003).select(F.col("id").alias("x"), F.when(F.col("id") < 3000, 1).otherwise(2).alias("a"))
right = spark.range(3005).select(F.col("id").alias("y"), F.when(F.col("id") < 3000, 1).otherwise(3).alias("b"))
both = frame.merge(left, right, "a", "b", "full").select("x", "y")
both.write.format("noop").mode("overwrite").save()
print(*both.agg(F.count("*"), F.count("x"), F.count("y"), F.countDistinct("x"), F.countDistinct("y")).collect()[0])
"""


def test_pairs_of_a_key_are_not_held_in_memory():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", LARGE], env=env, capture_output=True, text=True, timeout=400)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.split() == ["9000008", "9000003", "9000005", "3003", "3005"]


def outer(left, right, a, b):
    """Rows as a full outer join has them, in plain Python."""
    pairs = [(*x, *y) for x, y in itertools.product(left, right) if x[a] == y[b]]
    pairs += [(*x, *[None] * len(right[0])) for x in left if all(x[a] != y[b] for y in right)]
    return Counter(pairs + [(*[None] * len(left[0]), *y) for y in right if all(y[b] != x[a] for x in left)])


@pytest.mark.parametrize("side", [1, 3, 50, 2048])
def test_cells_pair_all_rows_once(spark, monkeypatch, side):
    """Null keys, keys of one side, keys large on one side only, copies of rows, cells without rows."""
    monkeypatch.setattr(frame, "SIDE", side)
    left = [(n, k) for k, size in ((1, 40), (2, 40), (3, 1), (4, 9), (None, 20), (6, 1)) for n in range(size)] + [(0, 1)] * 30
    right = [(k, f"r{n}") for k, size in ((1, 17), (2, 1), (3, 40), (5, 30), (None, 11), (6, 1)) for n in range(size)] + [(5, "r0"), (1, "r0")] * 7
    x, y = spark.createDataFrame(left, "n long, k int").repartition(3), spark.createDataFrame(right, "k int, t string").repartition(3)
    merged = frame.merge(x.alias("x"), y.alias("y"), "k", "k", "outer")
    assert merged.columns == ["n", "k", "k", "t"]
    assert Counter(map(tuple, merged.collect())) == outer(left, right, 1, 0)
    picked = Counter(map(tuple, merged.select("x.k", "y.k", "t").collect()))
    assert picked == Counter(map(lambda r: r[1:], outer(left, right, 1, 0).elements()))


@pytest.mark.parametrize("rows, others", [(0, 12), (12, 0), (0, 0)])
def test_empty_sides(spark, rows, others):
    x, y = spark.range(rows).select(F.col("id").alias("a")), spark.range(others).select(F.col("id").alias("b"))
    want = [(k, None) for k in range(rows)] + [(None, k) for k in range(others)]
    assert sorted(map(tuple, frame.merge(x, y, "a", "b", "full").collect()), key=str) == sorted(want, key=str)


def test_columns_of_any_kind_and_keys_of_two_types(spark, monkeypatch):
    """Maps have no hash and two columns of one name no single one; int keys meet bigint keys."""
    monkeypatch.setattr(frame, "SIDE", 2)
    x = spark.range(9).select((F.col("id") % 2).cast("int").alias("a"), F.create_map(F.lit("k"), "id").alias("m"), F.col("id").alias("d"), F.col("id").alias("D"))
    y = spark.range(10).select((F.col("id") % 3).alias("b"), F.array("id").alias("l"))
    got = Counter((r[0], r[1] and r[1]["k"], r[2], r[4], r[5] and r[5][0]) for r in frame.merge(x, y, "a", "b", "full").collect())
    left, right = [(k % 2, k, k) for k in range(9)], [(k % 3, k) for k in range(10)]
    assert got == outer(left, right, 0, 0)
