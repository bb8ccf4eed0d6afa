"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the tokenizer's pattern.  The symbols of many words lie in one flat
array; each round looks all neighbouring pairs up by binary search over the sorted pair keys, finds
each word's lowest rank, merges its occurrences from left to right and drops finished words.  Results
for words are kept in a bounded cache in each worker.

In a long word a round merges all pairs that are lowest within a window as long as the longest token, not only those that are
lowest in the word: before such a pair's turn nothing can reach it, as a merge from beyond the window would make a longer token than there is.
So the number of rounds depends on the vocabulary, not on the word's length.

At scale: a map over Arrow batches, no shuffle.  The merge tables are as large as the vocabulary, whatever
the input, and are broadcast; texts are worked on in pieces of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, release

#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps; characters that are cut into words at a time.
CACHE_WORDS, PIECE_CHARS = 100_000, 1_000_000
#: Bytes from which on a word is long.
LONG = 600
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(extra)) for b in range(256)]


class Tables:
    """What encoding and decoding need of a tokenizer file: plain arrays, as large as the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("the pre-tokenizer's options are not supported")
        vocab = model["vocab"]
        chars = byte_symbols()
        back = {c: b for b, c in enumerate(chars)}
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in token)
        self.longest = max(map(len, self.tokens))
        for token, i in self.special.items():
            self.tokens[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``_NONE`` if they do not merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def encode_words(words: list[bytes], t: Tables) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    keep = np.flatnonzero(lengths)
    sym = t.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    rank = np.full(sym.size, _NONE)
    rank[:-1] = np.where(word[1:] == word[:-1], t.rank(sym[:-1], sym[1:]), _NONE)
    while keep.size:
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, sym.size])
        done = best == _NONE
        if done.any():
            ids = sym.astype("<u4").tobytes()
            for k in np.flatnonzero(done).tolist():
                out[keep[k]] = ids[4 * starts[k] : 4 * (starts[k] + sizes[k])]
            alive = np.repeat(~done, sizes)
            sym, word, rank = sym[alive], word[alive], rank[alive]
            best, sizes, keep = best[~done], sizes[~done], keep[~done]
            if not keep.size:
                break
        where = np.flatnonzero(rank == np.repeat(best, sizes))
        where = where[(where - run_starts(where)) % 2 == 0]  # of overlapping occurrences (a run of equal symbols) every other one
        sym, rank, word = merged(sym, rank, where, t, word)
    return out


def merged(sym: np.ndarray, rank: np.ndarray, where: np.ndarray, t: Tables, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, ranks and words after the pairs at ``where`` are merged; only pairs with a new symbol are looked up."""
    sym[where] = t.made[rank[where]]
    stay = np.ones(sym.size, dtype=bool)
    stay[where + 1] = False
    changed = where - np.arange(where.size)  # where they are now: each merge before takes one place
    sym, rank, word = sym[stay], rank[stay], word[stay]
    before = changed[changed > 0] - 1
    pair = np.concatenate([before, changed])
    rank[pair] = _NONE
    pair = pair[pair < sym.size - 1]
    pair = pair[word[pair] == word[pair + 1]]
    rank[pair] = t.rank(sym[pair], sym[pair + 1])
    return sym, rank, word


def run_starts(where: np.ndarray) -> np.ndarray:
    """For each of these positions, ascending, the first of its run of neighbouring ones."""
    new = np.r_[True, where[1:] != where[:-1] + 1]
    return where[np.maximum.accumulate(np.where(new, np.arange(where.size), 0))]


def lowest_within(rank: np.ndarray, reach: int) -> np.ndarray:
    """The lowest of ``rank`` within ``reach`` places on either side of each."""
    edge = np.full(reach, _NONE)
    low, span = np.concatenate([edge, rank, edge]), 1
    while 2 * span <= 2 * reach + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = 2 * reach + 1 - span
    return np.minimum(low[: rank.size], low[rest : rest + rank.size])


def encode_long(word: bytes, t: Tables) -> bytes:
    """The ids of one long word: each round merges the pairs that are lowest in their window."""
    sym = t.first[np.frombuffer(word, dtype=np.uint8)]
    rank, one = np.r_[t.rank(sym[:-1], sym[1:]), _NONE], np.zeros(sym.size, dtype=np.int8)
    while (rank != _NONE).any():
        where = np.flatnonzero((rank != _NONE) & (rank == lowest_within(rank, t.longest)))
        run = run_starts(where)
        # a run of overlapping occurrences is merged from its first one on, so that one must be among them
        whole = np.where(run > 0, rank[run - 1] != rank[run], True)
        where = where[whole & ((where - run) % 2 == 0)]
        sym, rank, one = merged(sym, rank, where, t, one)
    return sym.astype("<u4").tobytes()


class Encoder:
    def __init__(self, tables: Tables):
        import regex

        self.t, self.cache = tables, {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(tables.special, key=len, reverse=True)) + ")").split if tables.special else (lambda x: [x])
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in tables.special.items()}

    def _look_up(self, words: set[str]) -> dict[str, bytes]:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = list(words)
        coded = [w.encode() for w in new]
        short = [k for k, w in enumerate(coded) if len(w) < LONG]
        self.cache.update(zip([new[k] for k in short], encode_words([coded[k] for k in short], self.t), strict=True))
        self.cache.update((new[k], encode_long(w, self.t)) for k, w in enumerate(coded) if len(w) >= LONG)
        return self.cache

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        held, chars = [], 0
        for text in texts:
            parts = [(p, self.special.get(p) or self.find(p)) for p in self.cut(text or "") if p]
            held.append([p for _, p in parts])
            chars += len(text or "")
            if chars >= PIECE_CHARS:
                out += self._join(held)
                held, chars = [], 0
        return out + self._join(held)

    def _join(self, held: list[list]) -> list[bytes]:
        ids = self._look_up({w for parts in held for p in parts if isinstance(p, list) for w in p}).__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(ids, p)) for p in parts) for parts in held]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tables: Tables) -> Encoder:
    """One per worker, so that the cache outlives a task."""
    if id(tables) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(tables)] = Encoder(tables)
    return _ENCODERS[id(tables)]


def text_of(ids: bytes, tables: Tables) -> str:
    """What ids decode to; bytes that are not UTF-8 become U+FFFD."""
    return b"".join(map(tables.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: (doc_id, ids binary, n_tokens long), and with ``decoded`` the text that ids decode to, in the same pass.

    ``ids`` holds little-endian unsigned 32-bit integers.  Special tokens that stand in a text get
    their own ids.  Null and empty texts have no tokens; doc_id may be null and may repeat.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id=id_col, text=text_col)
    tables = spark.sparkContext.broadcast(Tables(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tables.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = encoder(part.column(1).to_pylist())
                cols = {"doc_id": part.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if decoded:
                    cols["text"] = pa.array([text_of(x, tables.value) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text): special tokens are not skipped; bytes that are not UTF-8 become U+FFFD; null ids give an empty text."""
    spark = encoded.sparkSession
    rows = columns(encoded, doc_id=id_col, ids=ids_col)
    tables = spark.sparkContext.broadcast(Tables(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [text_of(x or b"", tables.value) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def ids_array(ids) -> F.Column:
    """The ids of a binary column as array<int>, with Spark functions."""
    digits = F.hex(ids)
    at = lambda i, k: F.substring(digits, i * 8 + 1 + 2 * k, F.lit(2))
    n = (F.octet_length(ids) / 4).cast("int")
    one = lambda i: F.conv(F.concat(at(i, 3), at(i, 2), at(i, 1), at(i, 0)), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<int>"))
