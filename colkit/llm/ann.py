"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Vectors are scaled to length 1, where Euclidean order is cosine order.  A table hashes a vector by
``hashes`` Gaussian projections, cut in steps of ``width``; a query visits its own bucket and then those
reached by moving single hash values up or down, in order of estimated success (the smallest sum of squared distances
to the borders that are crossed).  Candidates of all tables are merged and ranked by the exact cosine in double precision.

At scale: equal vectors are one class, with its ``k + 1`` smallest ids, so a vector that a third of
all rows share is one entry of the index.  Buckets are dealt into groups of about ``BLOCK`` entries; a query goes to a group once, with the keys that
it visits there.  Groups meet queries in a grid of blocks of ``BLOCK`` rows, so no task gets
an unbounded bucket, and a block returns ``k`` rows a query.  Queries that find fewer than ``k`` are answered exactly from all blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, partitions, written

TABLES, HASHES, WIDTH, PROBES, SEED = 4, 6, 2.0, 80, 7
#: Rows of a block; pairs whose exact scores are computed at a time.
BLOCK, PAIRS = 4000, 200_000


def projections(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(tables, dim, hashes)), rng.uniform(0, width, size=(tables, hashes))


def probe_steps(low: np.ndarray, width: float, n: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Sets of (hash, step) in order of estimated success.  low: distance to the lower border of each hash."""
    m = low.size
    cost = np.r_[low**2, (width - low) ** 2]
    order = np.argsort(cost, kind="stable")
    cost = cost[order]
    yield ()
    found, heap = 1, [(float(cost[0]), (0,))]
    while heap and found < n:
        total, picked = heapq.heappop(heap)
        which = [int(order[i]) for i in picked]
        if len({i % m for i in which}) == len(which):  # not up and down at once
            found += 1
            yield tuple((i % m, -1 if i < m else 1) for i in which)
        last = picked[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - float(cost[last]) + float(cost[last + 1]), (*picked[:-1], last + 1)))
            heapq.heappush(heap, (total + float(cost[last + 1]), (*picked, last + 1)))


def _key(table: int, dim: int, h: np.ndarray) -> np.ndarray:
    """A 63-bit key of (table, dimension, hash values) for each row of h."""
    out = np.full(h.shape[0], (table * 1_000_003 + dim) & 0x7FFFFFFF, dtype=np.uint64)
    for col in h.T.astype(np.int64).astype(np.uint64):
        out = (out ^ col) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(1)).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row.  Components are scaled by a power of two first, so that squares neither overflow nor vanish."""
    q = np.ldexp(q, -np.frexp(np.abs(q).max(axis=1, keepdims=True))[1])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _matrices(batch: pa.RecordBatch | pa.Table, column: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each dimension in the batch."""
    vecs = batch.column(column).to_pylist()
    sizes = np.array([len(v) for v in vecs], dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(vecs[i] for i in at), dtype="<f8").reshape(at.size, size // 8)


def _usable(vec) -> F.Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda v: v != 0)


def search(
    vectors: DataFrame,
    *,
    every: int,
    k: int,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probes: int = PROBES,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Score is the cosine; ties go to the smaller id; a row is not its own neighbour.  Rows with a null id, and vectors
    that are null, empty, zero or hold null or non-finite components take no part.  Vectors of different lengths
    never meet.  Repeated rows count once.  An id with several vectors is one query and one candidate, and as near as the nearest of
    them.  With fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    rows = columns(vectors, vec_id=id_col, vec=vec_col).where(F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).where(_usable(F.col("vec")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1)
            flat, ends = np.asarray(vecs.flatten(), dtype="<f8") + 0.0, np.asarray(vecs.offsets) - vecs.offsets[0].as_py()
            data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[8 * a : 8 * e] for a, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["vec_id", "vec"])

    with Scratch(vectors.sparkSession) as scratch:
        rows = written(rows.mapInArrow(packed, "vec_id bigint, vec binary"), "ann-rows")
        # classes of equal vectors, each with its smallest ids; the limit on ranks is applied before the shuffle, too
        ranked = rows.select("vec_id", "vec", F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id")).alias("n")).where(F.col("n") <= k + 1)
        classes = ranked.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("cls"), "ids", "vec")
        classes = written(classes, "ann-classes")
        asked = written(rows.where(F.col("vec_id") % every == 0).dropDuplicates(), "ann-queries")
        # vectors of one id, at most: so many classes can have no more than one id
        most = rows.groupBy("vec_id").agg(F.count_distinct(F.xxhash64("vec")).alias("n")).agg(F.max("n")).first()[0] or 1
        size = max(1, -(-tables * classes.count() // BLOCK))  # groups of buckets

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in _matrices(batch):
                    a, b = projections(x.shape[1], tables, hashes, width, seed)
                    part, u = batch.take(pa.array(at)), unit(x)
                    for t in range(tables):
                        key = _key(t, x.shape[1], np.floor((u @ a[t] + b[t]) / width))
                        yield pa.RecordBatch.from_arrays([pa.array(key % size), pa.array(key), part.column("cls"), part.column("ids"), part.column("vec")], names=["part", "key", "cls", "ids", "vec"])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in _matrices(batch):
                    a, b = projections(x.shape[1], tables, hashes, width, seed)
                    u = unit(x)
                    keys, who = [], []
                    for t in range(tables):
                        p = u @ a[t] + b[t]
                        h = np.floor(p / width)
                        low = p - h * width
                        for i in range(at.size):
                            steps = list(probe_steps(low[i], width, probes))
                            moved = np.repeat(h[i][None, :], len(steps), axis=0)
                            for r, step in enumerate(steps):
                                for j, d in step:
                                    moved[r, j] += d
                            keys.append(_key(t, x.shape[1], moved))
                            who.append(np.full(len(steps), at[i]))
                    key, who = np.concatenate(keys), np.concatenate(who)
                    order = np.lexsort((key, key % size, who))
                    key, who = key[order], who[order]
                    edges = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(key % size) != 0), True])
                    part = batch.take(pa.array(who[edges[:-1]]))
                    own = [key[lo:hi].tobytes() for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[edges[:-1]] % size), pa.array(own, pa.binary()), part.column("vec_id"), part.column("vec")], names=["part", "keys", "query_id", "vec"])

        entries = written(classes.select("cls", "ids", "vec").mapInArrow(index, "part bigint, key bigint, cls bigint, ids array<bigint>, vec binary"), "ann-index")
        visits = asked.repartition(partitions(vectors.sparkSession), "vec_id").mapInArrow(probe, "part bigint, keys binary, query_id bigint, vec binary")
        best = written(_ranked(_meet(entries, written(visits, "ann-visits"), k, most), k), "ann-best")
        # too few found: exact search over all blocks, as if all were one bucket
        short = asked.join(best.groupBy("query_id").agg(F.count("*").alias("n")), F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k)
        zero = F.lit(0).cast("long")
        short = written(short.select(zero.alias("part"), F.unhex(F.lit("00" * 8)).alias("keys"), F.col("vec_id").alias("query_id"), "vec"), "ann-short")
        if short.isEmpty():
            return scratch.keep(best, best)
        every_class = classes.select(zero.alias("part"), zero.alias("key"), "cls", "ids", "vec")
        exact = written(_ranked(_meet(every_class, short, k, most), k), "ann-exact")
        return scratch.keep(best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact), best, short, exact)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` nearest ids, an id once."""
    order = np.lexsort((-score, ids, query))
    q, i = query[order], ids[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if q.size else np.zeros(0, dtype=bool)]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    return order[np.arange(q.size) - np.searchsorted(q, q) < k]


def _near(a: pa.Table, b: pa.Table, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, score): of entries ``a`` those in buckets that the queries ``b`` visit, the ``k`` nearest ids of each."""
    n = (k + 1) * most
    a_key, b_id = a.column("key").to_numpy(), b.column("query_id").to_numpy()
    ids, b_keys = a.column("ids").to_pylist(), b.column("keys").to_pylist()
    of = {x.shape[1]: (at, x) for at, x in _matrices(a)}
    for q_at, q in _matrices(b):
        if q.shape[1] not in of:
            continue
        x_at, x = of[q.shape[1]]
        ux, uq, x_key = unit(x), unit(q), a_key[x_at]
        by_key = np.argsort(x_key, kind="stable")
        keys, starts = np.unique(x_key[by_key], return_index=True)
        ends = np.r_[starts[1:], x_key.size]
        visited = [np.frombuffer(b_keys[r], np.int64) for r in q_at.tolist()]
        who, key = np.repeat(np.arange(q_at.size), [v.size for v in visited]), np.concatenate(visited)
        at = np.minimum(np.searchsorted(keys, key), keys.size - 1)
        known = keys[at] == key
        who, at = who[known], at[known]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        edges = np.flatnonzero(np.r_[True, np.diff(at) != 0, True]) if at.size else np.zeros(1, dtype=np.int64)
        i, j = [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine, rows = who[lo:hi], by_key[starts[at[lo]] : ends[at[lo]]]
            if rows.size <= n:
                i.append(np.repeat(mine, rows.size))
                j.append(np.tile(rows, mine.size))
            else:
                s = uq[mine] @ ux[rows].T
                least = np.partition(s, rows.size - n, axis=1)[:, rows.size - n]
                r, c = np.nonzero(s >= least[:, None] - 1e-9)  # ties stay until the exact score decides
                i.append(mine[r])
                j.append(rows[c])
        if not i:
            continue
        i, j = np.concatenate(i), np.concatenate(j)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for lo in range(0, i.size, PAIRS):  # a query whose pairs are cut has its nearest in either part
            p, r = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            score = cosines(q[p], x[r])
            own = [ids[m] for m in x_at[r].tolist()]
            each = np.array([len(v) for v in own])
            query, vec, score = np.repeat(b_id[q_at[p]], each), np.concatenate(own).astype(np.int64), np.repeat(score, each)
            other = np.flatnonzero(query != vec)
            keep = other[_best(query[other], vec[other], score[other], k)]
            yield query[keep], vec[keep], score[keep]


def _meet(entries: DataFrame, visits: DataFrame, k: int, most: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest ids of each query in each block of the buckets that it visits."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias(name))

    grid = written(blocks(entries, "e_blocks").join(blocks(visits, "v_blocks"), "part"), "ann-grid")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = entries.join(grid, "part").select("part", own("cls", "e_blocks").alias("e"), every("v_blocks").alias("v"), "key", "ids", "vec")
    right = visits.join(grid, "part").select("part", every("e_blocks").alias("e"), own("query_id", "v_blocks").alias("v"), "keys", "query_id", "vec")

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(_near(a, b, k, most)) if a.num_rows and b.num_rows else []
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return left.groupBy("part", "e", "v").cogroup(right.groupBy("part", "e", "v")).applyInArrow(block, "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's first ``k`` ids."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
