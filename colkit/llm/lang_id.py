"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter: each slot is a mask with one bit per language, in 64-bit words, so the AND of an n-gram's
slots gives all languages that hold the n-gram at once.  A document's language is that with the most
of its n-grams, after each language's count is corrected for its false positives.

At scale: scoring is a map over Arrow batches; a long text is worked on in pieces that overlap by a character, so it has the n-grams of the whole.
N-grams are counted on a sample of ``max_docs`` documents a language at most and aggregated on the executors; the driver gets those
that belong to a language, which the sample bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

UNDETERMINED = "und"
#: Documents that the fit counts in a language.
MAX_DOCS = 2000
#: An n-gram belongs to a language if it is seen so often there, and at this share of its highest relative frequency.
MIN_COUNT, MIN_SHARE = 3, 0.3
#: Counts under MIN_COUNT are enough in a language in which too few n-grams would be known else: under this share of its sample.
KNOWN_MASS = 0.9
HASHES, PIECE_CHARS = 3, 500_000
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: itself if it is a letter, else 0 (a word's edge)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def grams(texts: list[str], before: list[bool] | None = None, after: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter trigrams (around each letter; word edges count as a character) of all texts, and how many each has.

    ``before`` and ``after`` mark texts whose first or last character only stands beside others.
    """
    flat = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = letters()[flat].astype(np.uint64)
    mid = c[1:-1] != 0
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    if before is not None:
        mid[(ends - lengths)[np.array(before, dtype=bool)]] = False
        mid[(ends - 2)[np.array(after, dtype=bool)]] = False
    seen = np.r_[0, np.cumsum(mid)]
    counts = np.diff(np.r_[0, seen[np.minimum(ends, seen.size - 1)]])
    at = np.flatnonzero(mid)
    h = c[at] * np.uint64(0x9E3779B97F4A7C15) + c[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), counts


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts, n-grams, how many of each) of lower-cased texts, a bounded number of characters at a time; a long text goes into several."""
    which, held, before, after, chars = [], [], [], [], 0
    for k, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, max(1, len(low)), PIECE_CHARS):
            which.append(k)
            held.append(low[max(0, at - 1) : at + PIECE_CHARS + 1])
            before.append(at > 0)
            after.append(at + PIECE_CHARS < len(low))
            chars += len(held[-1])
            if chars >= PIECE_CHARS:
                yield which, *grams(held, before, after)
                which, held, before, after, chars = [], [], [], [], 0
    if held:
        yield which, *grams(held, before, after)


def _bit(mask: np.ndarray, k: int) -> np.ndarray:
    """Language k's bit in masks of its word."""
    return (mask >> np.uint64(k % 64)) & np.uint64(1)


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # of 64-bit masks, a row for each 64 languages
    false_positive: np.ndarray  # by language
    held: np.ndarray  # by language: the share of its own sample's n-grams that it holds

    @staticmethod
    def build(languages: list[str], hashes: np.ndarray, masks: np.ndarray, held: np.ndarray | None = None) -> Filter:
        masks = np.atleast_2d(masks)
        most = max([1, *(int(_bit(masks[k // 64], k).sum()) for k in range(len(languages)))])
        slots = np.zeros((masks.shape[0], 1 << max(10, (8 * most - 1).bit_length())), dtype=np.uint64)
        for at in Filter._at(hashes, slots.shape[1]):
            for word in range(masks.shape[0]):
                np.bitwise_or.at(slots[word], at, masks[word])
        fill = np.array([_bit(slots[k // 64], k).mean() for k in range(len(languages))])
        return Filter(languages, slots, fill**HASHES, np.ones(len(languages)) if held is None else held)

    @staticmethod
    def _at(h: np.ndarray, size: int) -> list[np.ndarray]:
        bits = np.uint64(20)
        return [((h >> (bits * np.uint64(k))) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    def holders(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """The mask of languages that hold each n-gram, of the 64 languages of ``word``."""
        mask = None
        for at in self._at(h, self.slots.shape[1]):
            mask = self.slots[word][at] if mask is None else mask & self.slots[word][at]
        return mask

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected share of them in each language)."""
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for which, h, counts in pieces(texts):
            starts = np.cumsum(counts) - counts
            full = np.flatnonzero(counts)
            at = np.array(which)[full]
            np.add.at(n, at, counts[full])
            for k in range(len(self.languages)):
                if full.size:
                    if k % 64 == 0:
                        mask = self.holders(h, k // 64)
                    np.add.at(hits[:, k], at, np.add.reduceat(_bit(mask, k).astype(np.int64), starts[full]))
        share = hits / np.maximum(n, 1)[:, None]
        return n, np.clip((share - self.false_positive) / (1 - self.false_positive), 0, 1)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = MAX_DOCS, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE) -> Filter:
    """Learns from the rows of ``docs``; null languages and texts teach nothing."""
    rows = columns(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filter([], np.zeros((1, 1024), dtype=np.uint64), np.zeros(0), np.zeros(0))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / counts[k]))]), F.col("lang"))
    sample = rows.where(draw < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                mine = batch.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                for _, h, _ in pieces(mine):
                    found, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * found.size, pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the highest count, min_count at most, at which enough of the sample is known
    sums = [F.sum("n").alias("total"), *[F.sum(F.when(F.col("n") >= m, F.col("n"))).alias(f"mass{m}") for m in range(2, min_count + 1)]]
    needed = F.lit(1)
    for m in range(2, min_count + 1):
        needed = F.when(F.col(f"mass{m}") / F.col("total") >= KNOWN_MASS, F.lit(m)).otherwise(needed)
    per_lang = counted.groupBy("lang").agg(*sums).select("lang", "total", needed.alias("needed"))
    ranked = counted.join(per_lang, "lang").where(F.col("n") >= F.col("needed")).select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("f"))
    # what is seen less than min_count times takes nothing from other languages
    sure = F.max(F.when(F.col("n") >= min_count, F.col("f"))).over(Window.partitionBy("gram"))
    own = ranked.select("lang", "gram", "f", sure.alias("top")).where(F.col("f") >= F.lit(min_share) * F.coalesce("top", F.lit(0.0)))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)]), F.col("lang"))
    got = own.select(bit.alias("bit"), "gram", "f").toPandas()
    k = got["bit"].to_numpy(np.int64)
    gram, at = np.unique(got["gram"].to_numpy(np.int64), return_inverse=True)
    masks = np.zeros((-(-len(languages) // 64), gram.size), dtype=np.uint64)
    np.bitwise_or.at(masks, (k // 64, at), np.uint64(1) << (k % 64).astype(np.uint64))
    return Filter.build(languages, gram.view(np.uint64), masks, np.bincount(k, got["f"].to_numpy(np.float64), len(languages)))


def predict(docs: DataFrame, model: Filter, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, lang_pred, score, coverage).

    ``score`` is the winner's share of all languages' corrected shares, ``coverage`` its own corrected share.
    Null texts and texts without a letter are ``und`` with both 0; so is everything if no language was
    learned.  Ties go to the first language by name; doc_id may be null and may repeat.
    """
    rows = columns(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, share = model.score(part.column(1).to_pylist())
                if model.languages:
                    best = share.argmax(axis=1)
                    top, total = share.max(axis=1), share.sum(axis=1)
                    score = np.where(total > 0, top / np.where(total > 0, total, 1), 1 / len(model.languages))
                    none = n == 0
                    best, top, score = np.where(none, len(model.languages), best), np.where(none, 0, top), np.where(none, 0, score)
                else:
                    best, top, score = np.zeros(n.size, dtype=int), np.zeros(n.size), np.zeros(n.size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(top)], names=["doc_id", "lang_pred", "score", "coverage"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, coverage double")


def keep_determined(docs: DataFrame, model: Filter, *, text_col: str = "text", min_coverage: float = 0.2) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has letters and is in some language that ``model`` learned.

    It is in a language that holds at least ``min_coverage`` as large a share of its n-grams as of those of the language's own
    sample, so that bounds of the fit, which both meet, reject nothing.  If no n-gram was learned all texts with letters stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(0, batch.num_rows, 500):
                n, share = held.value.score(batch.column(at).slice(k, 500).to_pylist())
                known = held.value.held > 0
                near = (share >= min_coverage * held.value.held)[:, known].any(axis=1) if known.any() else True
                keep.append((n > 0) & near)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
