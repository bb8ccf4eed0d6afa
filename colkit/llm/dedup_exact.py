"""Exact dedup by a log-structured merge index of digests, with DataFrame functions only.

* memtable: consecutive parts of the table, ``memtable_rows`` rows or one part, aggregated by digest to their smallest
  identifier; a memtable is spread over the cluster, so it has as many rows as its tasks hold together;
* run: a memtable flushed to files sorted by digest, in buckets by digest that are the same in all runs;
* compaction: ``fanout`` runs at a time are merged bucket by bucket, without a shuffle, keeping smallest identifiers and adding
  counts, level after level until one run is left;
* filter: a bit set over the digests that several rows share.  Rows that it misses are done at once; only hits are joined with the index;
* hits: the texts of rows that hit are verified byte by byte, by each group's least and greatest text; where these differ (a
  collision) the text itself makes the groups.

At scale: a row's digest is shuffled once, after aggregation in each task; texts travel for hits alone.  The filter has 16 bits a shared
digest, 64 MB at most; beyond that more rows than the hits pass it, and none is lost.  Joins on the digest are between written tables, so the
skew join splits a digest that a third of all rows share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bit_at, columns, new_path, partitions, register, written

#: Runs of white space that are not already one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"
#: Rows of a memtable for each shuffle partition; runs merged at a time.
MEMTABLE_ROWS, FANOUT = 2000, 4
#: 4 KB pieces of the filter: 64 MB at most.
MOST_PIECES = 16384


def normalise(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class Level:
    """The runs of one level: a table partitioned by run and bucketed by digest, in the shared folder."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.buckets = max(1, partitions(self.spark) // 4)  # a file for each in each run
        self.name, self.path = f"colkit_lsm_{uuid.uuid4().hex}", new_path(self.spark, "lsm-level")

    def flush(self, run: DataFrame) -> None:
        run.write.mode("append").partitionBy("run").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """The level as a plain table: its name leaves the catalog, its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return register(self.spark, self.spark.read.schema(self.schema).parquet(self.path), self.path)


def memtables(rows: DataFrame, memtable_rows: int) -> list[tuple[int, int]]:
    """First and last part of the table (upper bits of rid) of each memtable."""
    parts = rows.groupBy(F.shiftright("rid", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each part of the table
    tables = parts.select("part", F.floor(before / memtable_rows).alias("table")).groupBy("table").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    return [(r["lo"], r["hi"]) for r in tables.orderBy("table").collect()]


def build_index(rows: DataFrame, *, memtable_rows: int | None = None, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Written rows (rid, doc_id, digest) -> the compacted index (digest, keep_id, n), and how many levels it took.

    ``keep_id`` is the smallest doc_id, null if there is none.
    """
    merge = lambda df, n: df.agg(F.min("keep_id").alias("keep_id"), n.alias("n"))
    own = rows.select("rid", "digest", F.col("doc_id").alias("keep_id"))
    bounds = memtables(rows, memtable_rows or MEMTABLE_ROWS * partitions(rows.sparkSession))
    level, levels, runs = None, 1, len(bounds)
    for run, (lo, hi) in enumerate(bounds):
        table = own.where((F.col("rid") >= lo << 33) & (F.col("rid") < (hi + 1) << 33))
        flushed = merge(table.groupBy("digest"), F.count("*")).select("digest", "keep_id", "n", F.lit(run).alias("run"))
        level = level or Level(flushed)
        level.flush(flushed)
    if level is None:
        return merge(own.groupBy("digest"), F.count("*")), 0
    while runs > 1:
        merged = merge(level.read().groupBy("digest", F.floor(F.col("run") / fanout).cast("int").alias("run")), F.sum("n"))
        following = Level(level.read())
        following.flush(merged.select("digest", "keep_id", "n", "run"))
        level.close()
        level, levels, runs = following, levels + 1, -(-runs // fanout)
    return level.close().select("digest", "keep_id", "n"), levels


def filter_of(groups: DataFrame) -> tuple[DataFrame, int]:
    """A bit set over the digests of ``groups`` as a written table (piece, bits), and its number of pieces."""
    pieces = min(MOST_PIECES, max(1, -(-16 * groups.count() // 32768)))
    at = F.pmod(F.xxhash64("digest"), F.lit(pieces * 32768)) + 1
    return written(groups.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), "lsm-filter", narrow=True), pieces


def with_hits(rows: DataFrame, bits: DataFrame, pieces: int) -> DataFrame:
    """``rows`` and ``hit``: false if the filter, whose size bounds the broadcast, misses their digest."""
    at = F.pmod(F.xxhash64("digest"), F.lit(pieces * 32768)) + 1
    probe = rows.withColumn("piece", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "piece", "left")
    return probe.select(*rows.columns, F.coalesce(bit_at(F.col("bits"), F.bitmap_bit_position(at)), F.lit(False)).alias("hit"))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    digest: Callable[[Column], Column] | None = None,
    memtable_rows: int | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256, rid).

    ``digest`` maps a normalised text to the index's key, SHA-256 by default; the outcome does not depend
    on it.  Null and empty texts are equal to each other.  Of rows with equal texts that
    with the smallest doc_id stays, null ids last; of rows that also share the doc_id exactly one is
    kept.  An empty table gives an empty result.  ``rid`` numbers the rows; it is ``row_col`` where that names a column with unique
    numbers as ``monotonically_increasing_id`` gives them.
    """
    named = {"doc_id": id_col, "text": text_col} | ({"rid": row_col} if row_col else {})
    source = columns(docs, **named)
    if not row_col:
        source = source.withColumn("rid", F.monotonically_increasing_id())
    body, own = F.col("body"), F.unhex(sha256(F.col("body")))
    key = own if digest is None else digest(body).cast("string").cast("binary")
    with Scratch(docs.sparkSession) as scratch:
        bodies = source.select("rid", "doc_id", normalise(F.col("text")).alias("body"))
        narrow = written(bodies.select("rid", "doc_id", own.alias("sha"), *([] if digest is None else [key.alias("digest")])), "lsm-rows")
        rows = narrow.withColumn("digest", F.col("sha")) if digest is None else narrow
        index, _ = build_index(rows, memtable_rows=memtable_rows, fanout=fanout)
        groups = written(index.where("n > 1"), "lsm-groups")
        bits, pieces = filter_of(groups)
        flagged = with_hits(rows, bits, pieces)
        hits = flagged.where("hit").join(groups, "digest", "left")
        # what passes the filter without being in the index is a group of its own
        hits = hits.select("rid", "doc_id", "digest", "sha", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
        hits = written(hits, "lsm-hits")

        # byte verification of the hits: a group's texts are equal if its least and its greatest are
        texts = with_hits(bodies.select("body", key.alias("digest")), bits, pieces).where("hit")
        mixed = written(texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest")).where("least <> greatest").select("digest"), "lsm-mixed")
        if not mixed.isEmpty():  # digests collide: there the texts themselves make the groups
            again = hits.join(mixed, "digest").groupBy("digest", "sha").agg(F.min("doc_id").alias("keep2"), F.count("*").alias("n2"))
            keep = F.when(F.col("n2").isNull(), F.col("keep_id")).otherwise(F.col("keep2"))
            hits = written(hits.join(again, ["digest", "sha"], "left").select("rid", "doc_id", "sha", keep.alias("keep_id"), F.coalesce("n2", "n").alias("n")), "lsm-hits")
        # of the rows with the smallest doc_id the first one stays
        first = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("sha").alias("of")).agg(F.min("rid").alias("first"))
        first = written(first, "lsm-first")
        stays = hits.join(first, F.col("sha") == F.col("of")).select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("first")).alias("kept"), "sha", "rid")
        alone = flagged.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "rid")
        result = stays.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "rid")
        return scratch.keep(result, narrow, bits, hits, first)
