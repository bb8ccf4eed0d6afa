"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue with a weight, its target number of words.  Documents
queue in shuffled order, and pass through the queue ``max_repeats`` times.  A
document's virtual finish time is the number of words its source has sent when
it is done, divided by the source's target.  All documents are sorted by finish
time over all sources and the mix takes them until the budget is used: in total, and at virtual time 1, when every source has been
served its target (a source whose next document is too long for what is left does not pass its words on to others).

At scale: a hot source is never gathered.  The shuffled order is a uniform hash, so a
source's queue is cut by the leading bits of the hash into blocks; a block's sum is
pre-aggregated, blocks get offsets from prefix sums over block sums, in two levels (a task orders ``SPAN``
blocks, and one sum for each ``SPAN`` blocks of a source), and only within a block are rows ordered in one task.  The global order is a range
partitioning of narrow rows; the driver sees one row, the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, columns, partitions, written

#: Rows that one block of a queue should hold.
BLOCK_ROWS = 250
#: Bits of the number of blocks whose sums are one sum of the upper level.
SPAN = 10


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source) -> (source, weight): sources by code point, null last, weigh ``cycle``, repeating.

    One row per source: the table is as small as the list of weights it stands for.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return sources.select("source", F.element_at(F.array(*[F.lit(w) for w in cycle]), (rank % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def fill_targets(sources: DataFrame, budget_share: float, max_repeats: int) -> DataFrame:
    """(source, weight, source_size) -> the same and target.

    Water filling: targets are proportional to weights, stop at ``max_repeats`` times the
    source's size, and the excess is reshared by weight until none is above.
    With sources ordered by cap / weight those at their cap come first, so the level
    follows from prefix sums and no loop is needed.
    """
    cap = F.col("source_size") * F.lit(max_repeats)
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(budget_share) * total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.nullif(F.sum("weight").over(after), F.lit(0.0))
    filled = sources.select("*", cap.alias("cap"), ratio.alias("ratio")).select("*", level.alias("level"))
    #: the first level that lies under the next cap holds for all that follow
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return filled.select("source", "weight", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target, finish, taken), and the columns ``also``.

    ``weights`` has (source, weight); by default sources weigh 5, 2, 1 in turn.  ``taken`` counts
    the words the mix takes of the document over all passes.  Null texts have size 0, take part
    and are never taken; null is a source like any other; a null doc_id
    is ordered before others; rows that are equal in all columns share one decision.  An
    empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        size = word_count(F.col("text"))
        rows = columns(docs, doc_id=id_col, text=text_col, source=source_col, **{c: c for c in also}).select("doc_id", "source", size.alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))).alias("turn"), F.xxhash64("text").alias("tie"), *also)
        rows = written(rows, "mix-sizes")
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        bits = max(0, (blocks - 1).bit_length())
        #: leading bits of the hash, from its first eight hexadecimal digits
        block = F.shiftright(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), 32 - bits).alias("block")
        rows = rows.select("*", block)
        # an id that very many rows share has one turn, so a block far too large is dealt out by the texts
        full = written(rows.groupBy("source", "block").agg(F.count("*").alias("n")).where(F.col("n") > 8 * BLOCK_ROWS).select(F.col("source").alias("of"), F.col("block").alias("hot"), F.ceil(F.col("n") / BLOCK_ROWS).alias("lots")), "mix-hot", narrow=True)
        low = F.coalesce(F.pmod("tie", "lots"), F.lit(0)).bitwiseAND((1 << 24) - 1)
        rows = rows.join(full, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("hot")), "left").withColumn("block", F.shiftleft("block", 24) + low).drop("of", "hot", "lots")
        sums = written(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks", narrow=True)
        sources = sums.groupBy("source").agg(F.sum("block_size").alias("source_size"))
        if weights is None:
            weights = cyclic_weights(sources.select("source"))
        else:
            weights = columns(weights, source="source", weight="weight")
        weights = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(weights, F.col("source").eqNullSafe(F.col("named")), "left").select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), "source_size")
        targets = fill_targets(sources, budget_share, max_repeats)
        spans = sums.withColumn("span", F.shiftright("block", SPAN + 24))
        upper = spans.groupBy(F.col("source").alias("named"), F.col("span").alias("of")).agg(F.sum("block_size").alias("n"))
        upper = upper.select("named", "of", (F.sum("n").over(Window.partitionBy("named").orderBy("of")) - F.col("n")).alias("before"))
        inner = F.sum("block_size").over(Window.partitionBy("source", "span").orderBy("block")) - F.col("block_size")
        offsets = spans.select("source", "block", "span", inner.alias("inner")).join(upper, F.col("source").eqNullSafe(F.col("named")) & (F.col("span") == F.col("of")))
        offsets = offsets.select("source", "block", (F.col("before") + F.col("inner")).alias("offset"))
        targets = targets.select(F.col("source").alias("named"), "source_size", "target")
        per = offsets.join(targets, F.col("source").eqNullSafe(F.col("named"))).select(F.col("source").alias("named"), F.col("block").alias("at"), "offset", "source_size", "target")
        per = written(per, "mix-offsets", narrow=True)
        inside = Window.partitionBy("source", "block").orderBy("turn", "doc_id", "size", "tie", *also).rowsBetween(Window.unboundedPreceding, 0)
        queued = rows.select("*", F.sum("size").over(inside).alias("sent"))
        queued = queued.join(per, F.col("source").eqNullSafe(F.col("named")) & (F.col("block") == F.col("at"))).select(
            "doc_id", "source", "size", "turn", "source_size", "target", (F.col("offset") + F.col("sent")).alias("sent"), *also
        )
        queued = written(queued, "mix-queue")

        def finish(k: int) -> F.Column:
            return (F.col("sent") + F.lit(k) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))

        passes = F.explode(F.array(*[F.struct(finish(k).alias("finish"), F.lit(k).alias("k")) for k in range(max_repeats)]))
        tags = queued.where("size > 0").select("turn", "doc_id", "size", passes.alias("t")).select(F.col("t.finish").alias("finish"), "turn", "doc_id", "size").where("finish <= 1")
        total = sums.agg(F.sum("block_size")).first()[0] or 0
        cut = _cut(tags, budget_share * total)
        if cut is None:
            taken = F.lit(0).cast("long")
        else:
            last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["turn"]).alias("turn"), F.lit(cut["doc_id"]).cast(queued.schema["doc_id"].dataType).alias("doc_id"))
            ins = [F.coalesce(((finish(k) <= 1) & (F.struct(finish(k).alias("finish"), "turn", "doc_id") <= last)).cast("long"), F.lit(0)) for k in range(max_repeats)]
            taken = sum(ins[1:], ins[0]) * F.col("size")
        result = queued.select("doc_id", "source", "size", "source_size", "target", finish(0).alias("finish"), taken.alias("taken"), *also)
        return scratch.keep(result, queued)


def _cut(tags: DataFrame, budget: float):
    """The last tag that the budget still covers, in order of (finish, turn, doc_id); None if none is.

    Tags are range-partitioned; whole partitions are summed, and only the partition in which the
    budget ends is put in order.
    """
    n = partitions(tags.sparkSession)
    ranged = written(tags.repartitionByRange(n, "finish", "turn", "doc_id").withColumn("part", F.spark_partition_id()), "mix-ranged")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("size"), F.max(F.struct("finish", "turn", "doc_id")).alias("last"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.select("part", "size", "last", F.sum("size").over(order).alias("upto"))  # one row a partition
    open_ = upto.where(F.col("upto") > F.lit(budget)).orderBy("part").select("part", (F.col("upto") - F.col("size")).alias("before")).first()
    whole = upto.where(F.col("upto") <= F.lit(budget)).orderBy(F.desc("part")).select("last.*").first()
    if open_ is None:
        return whole
    inside = Window.partitionBy("part").orderBy("finish", "turn", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ordered = ranged.where(F.col("part") == open_["part"]).select("finish", "turn", "doc_id", (F.sum("size").over(inside) + F.lit(open_["before"])).alias("upto"))
    best = ordered.where(F.col("upto") <= F.lit(budget)).agg(F.max(F.struct("finish", "turn", "doc_id")).alias("last")).first()["last"]
    return best or whole
