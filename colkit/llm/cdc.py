"""Content-defined chunking with a gear rolling hash, in numpy."""

from __future__ import annotations

import numpy as np

from .hashing import digests

#: The gear table: one 32-bit value per byte, from a fixed seed.
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, size=256, dtype=np.uint32)
#: A boundary follows a byte whose hash is the least of all within REACH bytes on either side: 33 bytes a chunk on average.
REACH, LEAST, MOST = 16, 12, 256


def gear_hash(b: np.ndarray) -> np.ndarray:
    """h[i] = 4 h[i-1] + gear[b[i]] (mod 2**32), for every i: it depends on the last 16 bytes only.

    Computed by doubling: sums over windows of 1, 2, 4, 8 and 16 bytes.
    """
    h = GEAR[b]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint32(2 * step))
    return h


def boundaries(h: np.ndarray) -> np.ndarray:
    """Where a chunk ends (exclusive): after local minima.

    Unlike a mask, this finds boundaries in text that repeats itself, too, at the same place in each period.
    """
    edge = np.full(REACH, np.iinfo(np.uint32).max, dtype=np.uint32)
    padded = np.concatenate([edge, h, edge])
    least = padded.copy()
    for step in (1, 2, 4, 8, 16):  # the least of 2, 4 ... 32 values from each position on
        least[:-step] = np.minimum(least[:-step], least[step:])
    return np.flatnonzero(h == np.minimum(least[: h.size], padded[2 * REACH :])) + 1


def cut_points(cuts: list[int], size: int) -> list[int]:
    """Ends of chunks of a text of ``size`` bytes; ``cuts`` are its content-defined boundaries, ascending."""
    out, last = [], 0
    for c in [*cuts, size]:
        while c - last > MOST:  # no boundary for long: cut at the greatest length
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == size:
            if c > last:
                out.append(c)
            last = c
    return out


#: What stands before each text, so that a text's boundaries depend on it alone.
_LEAD = b"\0" * 64


def chunk_texts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, end, 64-bit digest) of all chunks of all texts, in order."""
    flat = _LEAD + _LEAD.join(parts) + _LEAD
    b = np.frombuffer(flat, dtype=np.uint8)
    found = boundaries(gear_hash(b))
    sizes = [len(p) for p in parts]
    begins = np.cumsum([len(_LEAD), *(s + len(_LEAD) for s in sizes[:-1])]) if parts else np.zeros(0, dtype=np.int64)
    lows = np.searchsorted(found, begins, side="right")
    highs = np.searchsorted(found, begins + np.array(sizes, dtype=np.int64), side="left")
    which, ends = [], []
    for k, (at, lo, hi, size) in enumerate(zip(begins.tolist(), lows.tolist(), highs.tolist(), sizes, strict=True)):
        cuts = cut_points((found[lo:hi] - at).tolist(), size) if size else []
        which.append(np.full(len(cuts), k))
        ends.append(np.array(cuts, dtype=np.int64))
    of = np.concatenate(which) if which else np.zeros(0, dtype=np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    start = np.r_[0, end[:-1]] if end.size else end
    start = np.where(np.r_[True, of[1:] != of[:-1]] if of.size else of.astype(bool), 0, start)
    return of, start, end, digests(b, begins[of] + start, begins[of] + end)
