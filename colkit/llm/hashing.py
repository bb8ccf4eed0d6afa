"""64-bit hashes in numpy, of integers and of stretches of bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ _U(salt)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: The value of each byte in the polynomial.
BYTES = mix(np.arange(256, dtype=np.uint64))


def digests(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end: from prefix sums of a polynomial (mod 2**64), wherever the bytes lie."""
    if len(_POWERS.get("up", ())) <= b.size:
        size = max(1 << 21, 1 << int(b.size + 1).bit_length())
        _POWERS["up"], _POWERS["down"] = powers(BASE, size), powers(INVERSE, size)
    total = np.r_[_U(0), np.cumsum(BYTES[b] * _POWERS["up"][: b.size], dtype=np.uint64)]
    return mix((total[ends] - total[starts]) * _POWERS["down"][starts] + (ends - starts).astype(np.uint64))
