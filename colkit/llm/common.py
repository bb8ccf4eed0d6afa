"""Helpers shared by the operators: written intermediate tables and connected components."""

from __future__ import annotations

import contextvars
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rows import shared_folder

#: White space as the contracts define it: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/colkit/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Written tables of one operator.  All but those that its result still reads are deleted when it is done.

    ``keep`` names the tables that a result reads; they pass to the scratch around this one, if there is one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept, self.outer = spark, [], [], None

    def __enter__(self) -> Scratch:
        self.outer = _OPEN.get()
        _OPEN.set(self)
        return self

    def keep(self, result: DataFrame, *tables: DataFrame) -> DataFrame:
        self.kept += [t._colkit_path for t in tables]
        return result

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that are not needed any more."""
        for path in [t._colkit_path for t in tables]:
            self.paths.remove(path)
            delete(self.spark, path)

    def __exit__(self, *error) -> None:
        _OPEN.set(self.outer)
        for path in self.paths:
            if path not in self.kept:
                delete(self.spark, path)
            elif self.outer is not None:
                self.outer.paths.append(path)


_OPEN: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("colkit_scratch", default=None)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def register(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Makes the table at ``path``, read as ``df``, one of the open scratch's tables."""
    df._colkit_path = path
    if (scratch := _OPEN.get()) is not None:
        scratch.paths.append(path)
    return df


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and any executor can read it again.

    ``narrow`` rows (a few numbers each, cheap to make) go into an eighth as many files: files cost more than rows there.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        df = df.coalesce(max(1, partitions(spark) // 8))
    df.write.parquet(path)
    return register(spark, spark.read.schema(df.schema).parquet(path), path)


#: Rows that one bitmap stands for (of 4 KB, as Spark's bitmap functions make them); bitmaps that are broadcast at once: 32 MB.
BLOCK_BITS, MOST_BITMAPS = 15, 8192


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table with a number for each row, ``__row``: the part of the table in the upper bits, the place in it in the lower 33."""
    return written(df.withColumn("__row", F.monotonically_increasing_id()), name)


def bit_at(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1


def picked(table: DataFrame, picks: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table that ``picks`` (__row, __copy int) name, once for each copy; without ``__row``.

    Picks travel as a bitmap for each 32768 rows, to where the rows are: no row of the table is shuffled.  ``MOST_BITMAPS`` of them are broadcast
    at once; a table with more is worked through slice by slice, each a range of its parts, which the scan prunes by ``__row``.
    """
    keep = [c for c in table.columns if c != "__row"]
    low = F.col("__row").bitwiseAND((1 << BLOCK_BITS) - 1)
    block = F.shiftright("__row", BLOCK_BITS)
    bitmaps = written(picks.groupBy(block.alias("__block"), "__copy").agg(F.bitmap_construct_agg(low).alias("__bits")), "picks", narrow=True)

    def some(rows: DataFrame, maps: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(maps), block == maps["__block"]).where(bit_at(maps["__bits"], low)).select(*[rows[f"`{c}`"] for c in keep])

    if bitmaps.count() <= MOST_BITMAPS:
        result = some(table, bitmaps)
        result._colkit_reads = [bitmaps]
        return result
    part = F.shiftright("__block", 33 - BLOCK_BITS)
    upto = F.sum("n").over(Window.orderBy("part"))  # a row for each part of the table
    slices = bitmaps.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.floor((upto - F.col("n")) / MOST_BITMAPS).alias("slice"))
    path = new_path(table.sparkSession, "picked")
    for r in slices.groupBy("slice").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).orderBy("slice").toLocalIterator():
        inside = (F.col("__row") >= r["lo"] << 33) & (F.col("__row") < (r["hi"] + 1) << 33)
        some(table.where(inside), bitmaps.where(part.between(r["lo"], r["hi"]))).write.mode("append").parquet(path)
    result = register(table.sparkSession, table.sparkSession.read.schema(table.select(*keep).schema).parquet(path), path)
    result._colkit_reads = [result]
    return result


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under new names, so that other columns cannot clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in wanted.items()])


def chunks(batches: Iterator[pa.RecordBatch], most_rows: int = 2000, most_bytes: int = 1_000_000) -> Iterator[tuple[pa.Array, list]]:
    """(first column, texts of the second) in chunks that hold one text or a bounded number of bytes."""
    for batch in batches:
        texts = batch.column(1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at = size = 0
        for k, length in enumerate(lengths):
            size += length
            if size >= most_bytes or k + 1 - at >= most_rows or k + 1 == len(lengths):
                yield batch.column(0).slice(at, k + 1 - at), texts.slice(at, k + 1 - at).to_pylist()
                at, size = k + 1, 0
    release()


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: idle workers hold on to it, in several processes beside one executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def contracted(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Fewer edges that connect the same vertices.

    A round points each vertex to its smallest smaller neighbour and connects its other smaller neighbours with
    that one; the pointers are kept as edges, the rest goes into the next round.  ``edges`` have a > b.
    """
    kept = None
    for _ in range(rounds):
        low = written(edges.groupBy("a").agg(F.min("b").alias("low")), "pointers", narrow=True)
        rest = edges.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        pointers = low.select("a", F.col("low").alias("b"))
        kept = pointers if kept is None else kept.union(pointers)
        edges = written(rest, "edges", narrow=True)
        if edges.isEmpty():
            return kept
    return kept.union(edges)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long), as rows (id, label); label is the smallest id reached.

    The edges are contracted first.  Then smallest-label propagation with pointer jumping; each round is a written
    table, so a lost executor repeats one round at most.  Nothing is collected but a
    count per round.  Both directions of an edge are joined against a written
    label table, so a vertex with very many edges is split by the skew join.
    """
    with Scratch(edges.sparkSession) as scratch:
        once = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        few = contracted(written(once, "edges", narrow=True))
        both = written(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", narrow=True)
        labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels", narrow=True)
        for _ in range(max_rounds):
            near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
            hooked = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
            step = written(hooked.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", narrow=True)
            if step.where(F.col("was") != F.col("label")).isEmpty():
                return scratch.keep(step.select("id", "label"), step)
            labels = step.select("id", "label")
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
