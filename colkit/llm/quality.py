"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad.  Its features and those of both neighbouring lines give it an emission score, and transitions
tie neighbours together.  Forward-backward gives each line's marginal of being good; the document's quality is their mean,
weighted by the lines' lengths, mapped to a probability by a logistic curve.

Labels are of documents, lines have none.  So the lines of labelled documents are hidden: they are first fitted one by one, by their own features
only, as if each had its document's label (a kind of line that good documents have, too, comes out as good), then as chains in rounds of expectation and maximisation, in which a document's lines take the marginals that are nearest to the model's among those
with a mean, weighted by length, of ``GOOD`` or more in a good document and of ``BAD`` or less in a bad one.  So a bad document can have good lines,
and a good one some bad ones.

At scale: scoring is a map over Arrow batches, vectorised over the documents of a batch; a chain of many lines is cut into pieces that are worked
on side by side.  The model is fitted on the driver
on a sample of ``max_docs`` labelled documents, of a longer one on ``max_lines`` lines in a row from a place that depends on its id; only line features of
these reach it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns
from .hashing import digests, mix

#: Bounds of the sample that the model is fitted on.
MAX_DOCS, MAX_LINES = 4000, 200
#: Steps of the first fit; rounds after it, and steps of each.
STEPS, ROUNDS, ROUND_STEPS, RATE, PENALTY = 150, 5, 30, 0.05, 1e-3
#: Least share of good lines in a good document, most in a bad one: half.
GOOD, BAD = 0.9, 0.5
#: Lines of a piece of a chain.
PIECE = 128

_KIND = np.zeros(256, dtype=np.uint8)  # 1 blank, 2 upper, 3 lower, 4 digit, 5 other ASCII, 6 beyond ASCII
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[(_KIND == 0) & (np.arange(256) < 128)] = 5
_KIND[128:] = 6
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_ODD = (_KIND == 5) & ~np.isin(np.arange(256), [ord(c) for c in ".,;:'\"()-?"])
N_FEATURES = 15


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, number of lines of each text).  Every text has one line at least."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.r_[0, ends[:-1] + 1]
    limits = np.cumsum([len(p) + 1 for p in parts])
    lines = np.diff(np.r_[0, np.searchsorted(ends, limits)])
    size = (ends - starts).astype(np.float64)
    kind = _KIND[b]

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(mask)]
        return (c[ends] - c[starts]).astype(np.float64)

    blank = kind == 1
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    w_start, w_end = edge[0::2], edge[1::2]
    line = np.searchsorted(ends, w_start)
    words = np.bincount(line, minlength=ends.size).astype(np.float64)
    h = digests(b, w_start, w_end)
    again = np.zeros(h.size, dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[again], minlength=ends.size)
    kept = np.unique(mix(h + mix(line.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(line[kept], minlength=ends.size)
    odd_tail = np.bincount(line[_ODD[b[w_end - 1]]], minlength=ends.size)
    short = np.bincount(line[(w_end - w_start) <= 3], minlength=ends.size)
    letters = np.maximum(total(kind == 2) + total(kind == 3) + total(kind == 6), 1)
    n, m = np.maximum(size, 1), np.maximum(words, 1)
    last = b[np.maximum(ends - 1, 0)]
    f = np.stack(
        [
            np.log1p(size), np.log1p(words), (size - total(blank)) / m / 10, total(kind == 2) / letters, total(kind == 4) / n,
            total(kind == 5) / n, total(_ODD[b]) / n, odd_tail / m, total(b == ord("|")) / n, repeats / m, distinct / m,
            (_END[last] & (size > 0)).astype(np.float64), total(kind == 6) / n, short / m, (size == 0).astype(np.float64),
        ],
        axis=1,
    )
    return f, size, lines


def with_neighbours(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it (0 at a text's ends), and a constant."""
    first = np.zeros(f.shape[0], dtype=bool)
    last = np.zeros(f.shape[0], dtype=bool)
    ends = np.cumsum(lines)
    first[ends - lines] = True
    last[ends - 1] = True
    before, after = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([f, before, after, np.stack([first, last, np.ones(f.shape[0])], axis=1)], axis=1)


def forward_backward(scores: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end: (marginal of good by line, expected transitions 2 x 2, log partition by chain).

    scores: good minus bad, by line; trans[a, b]: score of b after a (0 bad, 1 good).
    Longer chains come first in each step, so a step works on a prefix of the chains.
    """
    order = np.argsort(-lines, kind="stable")
    n = lines[order]
    base = (np.cumsum(lines) - lines)[order]
    top = np.maximum(scores, 0)
    emit = np.stack([np.exp(-top), np.exp(scores - top)], axis=1)
    move = np.exp(trans)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.ones(scores.size)
    steps = int(n[0]) if n.size else 0
    live = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # chains with more than t lines
    for t in range(steps):
        at = base[: live[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = base[: live[t + 1]] + t
        nxt = emit[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ move.T
        pairs += (alpha[at].T @ nxt) * move
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    chain = np.repeat(np.arange(lines.size), lines)
    logz = np.bincount(chain, weights=np.log(scale) + top, minlength=lines.size)
    return good, pairs, logz


def _forward(emit: np.ndarray, lines: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Forward messages of chains laid end to end, each scaled to 1.

    Chains are cut into pieces of ``PIECE`` lines; the products of steps within all pieces go on side by side, then messages go from piece to piece.
    """
    first = np.cumsum(lines) - lines
    per = -(-lines // PIECE)
    chain = np.repeat(np.arange(lines.size), per)
    nth = np.arange(chain.size) - np.repeat(np.cumsum(per) - per, per)
    start = first[chain] + nth * PIECE
    size = np.minimum(PIECE, first[chain] + lines[chain] - start)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, PIECE + 1), side="right")
    step = move[None, :, :] * emit[:, None, :]
    step[first] = emit[first][:, None, :]  # nothing stands before a chain's first line
    product = np.empty_like(step)
    for t in range(int(size.max()) if size.size else 0):
        at = start[order[: live[t]]] + t
        product[at] = step[at] if t == 0 else product[at - 1] @ step[at]
        product[at] /= product[at].sum(axis=(1, 2), keepdims=True)
    into = np.full((chain.size, 2), 0.5)
    for k in range(1, int(per.max()) if per.size else 0):
        here = np.flatnonzero(nth == k)
        v = (into[here - 1][:, None, :] @ product[start[here] - 1])[:, 0, :]
        into[here] = v / v.sum(axis=1, keepdims=True)
    out = (np.repeat(into, size, axis=0)[:, None, :] @ product)[:, 0, :]
    return out / out.sum(axis=1, keepdims=True)


def marginals(scores: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each line's marginal of good, as ``forward_backward`` gives it, for chains of any length."""
    top = np.maximum(scores, 0)
    emit, move = np.stack([np.exp(-top), np.exp(scores - top)], axis=1), np.exp(trans)
    ends = np.cumsum(lines)
    back = np.repeat(2 * ends - lines - 1, lines) - np.arange(scores.size)  # each chain in reverse
    both = _forward(emit, lines, move) * _forward(emit[back], lines, move.T)[back] / emit
    return both[:, 1] / both.sum(axis=1)


def weighted_mean(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The mean of each chain's lines, weighted by length (all alike where no line has any)."""
    if not lines.size:
        return good
    starts = np.cumsum(lines) - lines
    weight = size + (np.add.reduceat(size, starts) == 0).repeat(lines)
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


@dataclass
class Crf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def observe(self, f: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return with_neighbours((f - self.mean) / self.scale, lines)

    def lines(self, f: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Each line's marginal of being good."""
        return marginals(np.clip(self.observe(f, lines) @ self.weights, -30, 30), lines, self.trans)

    def quality(self, f: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document, as log odds."""
        q = weighted_mean(self.lines(f, lines), size, lines)
        q = np.clip(q, 1e-9, 1 - 1e-9)
        return np.log(q) - np.log1p(-q)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.quality(*line_features(texts)) + self.shift)))


def expected_lines(scores: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, expected transitions) of the hidden lines: the model's, moved as little as the labels of the documents ask for.

    The nearest distribution that meets a bound on the mean adds a term for each line of the document, found by bisection.
    """
    bound = np.where(label == 1, GOOD, BAD)
    wrong = lambda mean: np.where(label == 1, mean < bound, mean > bound)
    low, high = np.where(label == 1, 0.0, -40.0), np.where(label == 1, 40.0, 0.0)
    move = wrong(weighted_mean(forward_backward(scores, lines, trans)[0], size, lines))
    for _ in range(12 if move.any() else 0):
        middle = (low + high) / 2
        mean = weighted_mean(forward_backward(scores + (middle * move).repeat(lines), lines, trans)[0], size, lines)
        low, high = np.where(mean < bound, middle, low), np.where(mean < bound, high, middle)
    good, pairs, _ = forward_backward(scores + ((low + high) / 2 * move).repeat(lines), lines, trans)
    return good, pairs


def fit_crf(f: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on all documents; the lines are hidden after the first fit."""
    if not label.size or label.min() == label.max():  # nothing to tell apart
        p = float(label.mean()) if label.size else 0.5
        p = min(max(p, 1e-3), 1 - 1e-3)
        zero = np.zeros(3 * f.shape[1] + 3)
        return Crf(np.zeros(f.shape[1]), np.ones(f.shape[1]), zero, np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    model = Crf(f.mean(axis=0), f.std(axis=0) + 1e-6, np.zeros(3 * f.shape[1] + 3), np.zeros((2, 2)))
    x = model.observe(f, lines)
    params = np.zeros(x.shape[1] + 4)

    own = np.r_[np.ones(f.shape[1]), np.zeros(2 * f.shape[1] + 2), 1, np.zeros(4)]

    def climb(params: np.ndarray, y: np.ndarray, seen: np.ndarray, steps: int, free: np.ndarray | float = 1.0) -> np.ndarray:
        """Towards the parameters, of those that are ``free``, under which the lines are ``y`` and their transitions ``seen``."""
        m, v = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, steps + 1):
            w, trans = params[:-4], params[-4:].reshape(2, 2)
            good, pairs, _ = forward_backward(np.clip(x @ w, -30, 30), lines, trans)
            grad = free * (np.r_[x.T @ (good - y), (pairs - seen).ravel()] / lines.sum() + PENALTY * params)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return params

    params = climb(params, label.astype(np.float64).repeat(lines), np.zeros((2, 2)), STEPS, own)
    for _ in range(ROUNDS):
        good, pairs = expected_lines(np.clip(x @ params[:-4], -30, 30), size, lines, label, params[-4:].reshape(2, 2))
        params = climb(params, good, pairs, ROUND_STEPS)
    model.weights, model.trans = params[:-4], params[-4:].reshape(2, 2)
    # the logistic curve from log odds to probability, by Newton's method
    q = model.quality(f, size, lines)
    a = np.array([1.0, 0.0])
    z = np.stack([q, np.ones_like(q)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (p - label) + 1e-2 * a
        a = a - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), g)
    model.slope, model.shift = float(max(a[0], 1e-3)), float(a[1])
    return model


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Crf:
    """Fits the model to a sample of the labelled rows; rows with a null id, text or label teach nothing."""
    known = columns(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)")
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < min(1.0, max_docs / max(n, 1))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = columns(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    # the sample's bound makes it safe to broadcast
    begin = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = rows.join(F.broadcast(sample), "doc_id").select(F.struct(F.col("label").cast("int").alias("label"), begin.alias("begin")).alias("known"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, texts in chunks(batches):
            f, size, lines = line_features(texts)
            label, begin = known.field("label"), known.field("begin").to_numpy(zero_copy_only=False)
            n = np.minimum(lines, max_lines)
            at = np.cumsum(lines) - lines + begin % (lines - n + 1)
            cut = lambda x: pa.array([x[a : a + m].tobytes() for a, m in zip(at.tolist(), n.tolist(), strict=True)], pa.binary())  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([label, pa.array(n), cut(f), cut(size)], names=["label", "lines", "f", "size"])

    got = chosen.mapInArrow(features, "label int, lines bigint, f binary, size binary").collect()
    got = sorted(got, key=lambda r: (bytes(r["f"]), r["label"]))  # the fit must not depend on the rows' order
    f = np.frombuffer(b"".join(bytes(r["f"]) for r in got), np.float64).reshape(-1, N_FEATURES)
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in got), np.float64)
    return fit_crf(f, size, np.array([r["lines"] for r in got], dtype=np.int64), np.array([r["label"] for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: (doc_id, score, predicted).

    Null and empty texts are one empty line and get that line's score.  doc_id may be null and may repeat; an empty table
    gives an empty result.
    """
    rows = columns(docs, doc_id=id_col, text=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            s = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
