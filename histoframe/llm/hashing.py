"""Vectorised 63- and 64-bit hashes of words and windows of bytes, over many texts at once."""

from __future__ import annotations

import functools

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
BASE = 0x9E3779B97F4A7C17  # odd, 3 modulo 4
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; kept for the next power of two."""
    up, down = _powers(1 << max(18, (n - 1).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish, so that all bits depend on all bits."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums such that (s[b] - s[a]) * BASE**-a depends on raw[a:b] only."""
    up, _ = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up, out=sums[1:])
    return sums


def joined_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a newline after each, and where each text starts (one more than texts)."""
    return joined([(t or "").encode("utf-8", "surrogatepass") for t in texts])


def joined(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings joined, a newline after each, and where each starts (one more than strings)."""
    starts = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1, out=starts[1:])
    return np.frombuffer(b"\n".join([*encoded, b""]), np.uint8), starts


def row_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the strings raw[starts[k]:starts[k + 1]]."""
    if not len(raw):
        return mix(np.zeros(len(starts) - 1, np.uint64))
    sums = prefix_sums(raw)
    _, down = powers(len(raw))
    first, last = starts[:-1], starts[1:]
    return mix((sums[last] - sums[first]) * down[np.minimum(first, len(raw) - 1)] + (last - first).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, in order, and the words before each text (one more than texts)."""
    raw, starts = joined_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    raw = LOWER[raw]
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    sums = prefix_sums(raw)
    _, down = powers(len(raw))
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, starts)
