"""Substring dedup: content-defined chunks, deduplicated by digest.

Texts, with runs of white space as one space, are cut into chunks of variable length where a gear rolling hash of the last 16 bytes says so, so
that an insertion moves only the boundaries next to it.  A chunk whose digest occurs in several documents
is a duplicate, and a run of such chunks is part of a repeated passage.  A passage starts and ends inside
chunks that differ, so its run is shorter than itself: each run that has ``min_words`` words together with two chunks on either side is a
candidate, however short the run.  Candidates are decided by hashes of stretches of ``min_words`` words: all that start or end where a passage
can start or end, next to the run's first and last chunk, and between these the ones that winnowing picks, whose first words have the least hash of
``PICK`` neighbours, so that all documents pick the same.  Neighbouring stretches that other documents have, too, put together, are the passages.

At scale: digests are pre-aggregated to their smallest and largest document.  Occurrences are read again and pass a bit filter of bounded size before
they are joined with the duplicates, where the skew join splits a chunk that very many documents share; texts travel only for documents with
candidates, which a second filter finds.  Runs are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cdc import chunk_texts
from .common import Scratch, chunks, columns, release, written
from .dedup_exact import filter_of, with_hits
from .hashing import BASE, INVERSE, digests, mix, powers

MIN_WORDS = 50
#: Chunks on either side of a run that a passage can reach into; words of which winnowing picks one.
BESIDE, PICK = 2, 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def word_starts(parts: list[bytes], of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of text ``of`` that start before byte ``at``, for each pair of these."""
    b = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    blank = _SPACE[b]
    total = np.r_[0, 0, np.cumsum(~blank[1:] & blank[:-1])]
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])[of] if of.size else of
    return total[begins + at] - total[begins]


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (doc, no, digest, low, first, last, high): a row per chunk.

    first and last are the numbers of the first word that starts in the chunk and of the first one after it; low and high are the same of the
    chunks ``BESIDE`` places before and behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, texts in chunks(batches):
            parts = [b" ".join(p.split()) for p in encoded(texts)]  # words are numbered, so white space needs no places
            of, start, end, digest = chunk_texts(parts)
            if not of.size:
                continue
            begin = np.searchsorted(of, np.arange(len(parts)))
            final = np.searchsorted(of, np.arange(len(parts)), side="right") - 1
            own = np.arange(of.size)
            first, last = word_starts(parts, of, start), word_starts(parts, of, end)
            places = own - begin[of], first[np.maximum(own - BESIDE, begin[of])], first, last, last[np.minimum(own + BESIDE, final[of])]
            no, *words = (pa.array(x.astype(np.int32)) for x in places)
            yield pa.RecordBatch.from_arrays([known.take(pa.array(of)), no, pa.array(digest.view(np.int64)), *words], names=["doc", "no", "digest", "low", "first", "last", "high"])

    return docs.select("doc", "text").mapInArrow(run, "doc bigint, no int, digest bigint, low int, first int, last int, high int")


def winnowed(h: np.ndarray) -> np.ndarray:
    """Whether each word is picked: its hash is the least of some ``PICK`` words in a row."""
    if h.size < PICK:
        return np.ones(h.size, dtype=bool)
    least = np.lib.stride_tricks.sliding_window_view(h, PICK).min(axis=1)  # of the words from each one on
    edge = np.full(PICK - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    low = np.concatenate([edge, least, edge])
    return (np.lib.stride_tricks.sliding_window_view(low, PICK) == h[:, None]).any(axis=1)


def stretches(part: bytes, regions: list[tuple[int, int, int, int]], n: int) -> tuple[np.ndarray, ...]:
    """(number of the first word, start byte, end byte, two hashes) of stretches of ``n`` words of a text.

    regions: low, first, last and high of runs of chunks.
    """
    b = np.frombuffer(part + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[b]].astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    h = digests(b, start, end)
    picked = winnowed(mix(h, 3))
    take = np.zeros(start.size + 1, dtype=bool)
    for low, first, last, high in regions:
        most = min(high, start.size) - n  # where the last stretch of the region starts
        if most >= low:
            take[low : most + 1] |= picked[low : most + 1]
            # documents pick alike from the PICK-th word of a passage on
            take[low : min(first + PICK, most) + 1] = True
            take[max(low, last - 1 - n) : most + 1] = True
    at = np.flatnonzero(take)
    up, down = powers(BASE, h.size + 1), powers(INVERSE, h.size + 1)
    hashes = []
    for salt in (1, 2):
        total = np.r_[np.uint64(0), np.cumsum(mix(h, salt) * up[: h.size], dtype=np.uint64)]
        hashes.append(mix((total[at + n] - total[at]) * down[at], salt).view(np.int64))
    return at, start[at], end[at + n - 1], *hashes


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per passage of ``min_words`` words or more that other documents share: (doc_id, start_byte, end_byte, n_words, first_doc_id, kept).

    Words are compared as they are, white space between them is not.  Offsets are in the UTF-8 text.  ``first_doc_id`` is the smallest doc_id that
    holds the passage's first ``min_words`` words; ``kept`` is true in that document.  Documents without such a passage have no row.  Rows with a null
    doc_id, null and empty texts take no part.  Rows that share doc_id and text are one document, rows that share only the doc_id are several;
    repeats within a document do not count.  An empty table gives an empty result.
    """
    rows = columns(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        groups = chunk_table(rows).groupBy("digest").agg(F.min("doc").alias("one"), F.max("doc").alias("other"))
        shared = written(groups.where("one <> other").select("digest"), "cdc-shared")
        hits = with_hits(chunk_table(rows), *filter_of(shared)).where("hit").drop("hit").join(shared, "digest").select("doc", "no", "low", "first", "last", "high")
        run = F.col("no") - F.row_number().over(Window.partitionBy("doc").orderBy("no"))
        runs = hits.distinct().withColumn("run", run).groupBy("doc", "run").agg(F.min("low").alias("low"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"))
        regions = runs.where(F.col("high") - F.col("low") >= min_words).groupBy("doc").agg(F.collect_list(F.struct("low", "first", "last", "high")).alias("regions"))
        regions = written(regions, "cdc-regions")
        named = regions.select(F.col("doc").alias("digest"))
        texts = with_hits(rows.withColumn("digest", F.col("doc")), *filter_of(named)).where("hit").select("doc_id", "doc", "text")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    text, spans = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                    found = stretches(encoded([text])[0], [(s["low"], s["first"], s["last"], s["high"]) for s in spans], min_words)
                    if found[0].size:
                        same = pa.array(np.zeros(found[0].size, dtype=np.int64))
                        part = batch.slice(k, 1)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(same), part.column(1).take(same), *map(pa.array, found)], names=["doc_id", "doc", "at", "start", "end", "one", "other"])
            release()

        spans = texts.join(regions, "doc").select("doc_id", "doc", "text", "regions").mapInArrow(verify, f"doc_id {kind}, doc bigint, at bigint, start bigint, end bigint, one bigint, other bigint")
        spans = written(spans, "cdc-stretches")
        found = spans.groupBy("one", "other").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("doc_id").alias("first_doc_id")).where("low <> high")
        found = written(found.select("one", "other", "first_doc_id"), "cdc-found")
        met = written(spans.join(found, ["one", "other"]).select("doc_id", "doc", "at", "start", "end", "first_doc_id"), "cdc-met")
        # within a passage no more than PICK words lie between stretches that all documents take; between two passages, min_words do
        order = Window.partitionBy("doc").orderBy("at")
        apart = F.coalesce((F.col("at") - F.lag("at").over(order) > PICK).cast("int"), F.lit(0))
        islands = met.dropDuplicates(["doc", "at"]).withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
        whole = islands.groupBy("doc_id", "doc", "island").agg(
            F.min("start").alias("start_byte"),
            F.max("end").alias("end_byte"),
            (F.max("at") - F.min("at") + min_words).alias("n_words"),
            F.min_by("first_doc_id", "at").alias("first_doc_id"),
        )
        return scratch.keep(whole.select("doc_id", "start_byte", "end_byte", "n_words", "first_doc_id", (F.col("first_doc_id") == F.col("doc_id")).alias("kept")), met)
