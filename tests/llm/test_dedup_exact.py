import hashlib
import re

import pytest
from pyspark.sql import functions as F

from colkit.llm.common import written
from colkit.llm.dedup_exact import build_index, exact_dedup

ROWS = [(5, "a  b\tc"), (3, "a b c"), (9, "a b\n\nc"), (4, None), (2, ""), (7, "x y"), (8, " x y"), (6, "long " * 60_000), (1, "long  " * 60_000), (None, "a b c"), (None, "only null"), (10, "twice"), (10, "twice"), (11, "a b c")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [None, lambda c: F.crc32(c.cast("binary")) % 3, lambda c: F.length(c)])
@pytest.mark.parametrize("memtable_rows,fanout", [(1, 2), (5, 8), (None, 2)])
def test_equal_to_brute_force_whatever_the_digest(spark, digest, memtable_rows, fanout):
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in ROWS], "doc_id long, text string, run int, digest string").repartition(3)
    got = exact_dedup(df, digest=digest, memtable_rows=memtable_rows, fanout=fanout).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        want.append((i, min(known) if known else None, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    # exactly one row of each group is kept, and it has the smallest id
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_grow_with_the_rows_and_merge_without_a_shuffle(spark):
    from colkit.llm import dedup_exact

    found = []
    for parts in (1, 4, 16):
        rows = spark.range(40 * parts, numPartitions=parts).select(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("doc_id"), F.unhex(F.sha2((F.col("id") % 30).cast("string").cast("binary"), 256)).alias("digest"))
        rows = written(rows, "lsm-test")
        index, levels = build_index(rows, memtable_rows=40, fanout=2)
        found.append(levels)
        want = {k: sum(1 for i in range(40 * parts) if i % 30 == k) for k in range(30)}
        assert {r["keep_id"]: r["n"] for r in index.collect()} == want
    assert found == [1, 3, 5]
    level = dedup_exact.Level(index.withColumn("run", F.lit(0)))
    level.flush(index.withColumn("run", F.lit(0)))
    level.flush(index.withColumn("run", F.lit(1)))
    plan = level.read().groupBy("digest", F.floor(F.col("run") / 2).alias("run")).agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    level.close()
