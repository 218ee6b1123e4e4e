"""Byte n-grams of many texts at once, as 64-bit integers, and values looked up by them."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(bodies: list[bytes], depth: int, pad: int, most: int = 1 << 18):
    """grams() in order, of up to `most` bytes at a time, however long a body is."""
    gap = bytes([pad]) * depth
    s = np.frombuffer(gap + gap.join(bodies) + gap, dtype=np.uint8)
    ends = depth - 1 + np.cumsum(np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) + depth)
    wanted = np.ones(len(s), dtype=bool)
    wanted[(ends[:, None] - np.arange(depth - 1)).ravel()] = False
    for a in range(depth, len(s), most):
        part = s[a - depth : a + most].astype(np.uint64)
        code = part[depth:].copy()
        for d in range(1, depth + 1):
            code |= part[depth - d : len(part) - d] << np.uint64(8 * (depth - d + 1))
        yield code[wanted[a : a + most]]


def grams(bodies: list[bytes], depth: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every byte of each body and of one `pad` byte that ends it, body by body; and each body's number of them.

    A gram holds the `depth` bytes before, the latest in the highest place, then the byte itself in the lowest. Before
    a body stand `depth` pad bytes.
    """
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) + 1
    return np.concatenate([*slices(bodies, depth, pad), np.empty(0, dtype=np.uint64)]), sizes


def merge(parts: list[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sum the counts of equal keys: parts are (sorted distinct keys, counts). About `most` rows are put together at a time."""
    if len(parts) == 1:
        return parts[0]
    longest = max((k for k, _ in parts), key=len)
    n = 1 + sum(len(k) for k, _ in parts) // most
    bounds = longest[np.arange(1, n) * len(longest) // n]
    cuts = [np.r_[0, np.searchsorted(k, bounds), len(k)] for k, _ in parts]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(n):
        keys, counts = (np.concatenate([p[c][at[i] : at[i + 1]] for p, at in zip(parts, cuts, strict=True)]) for c in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        out.append((keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts))
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


class Lookup:
    """Values by gram, NaN for a gram that is not there.

    Grams are spread by a one-to-one product and sorted; a table of places by their first bits finds one in a step or two.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        spread = keys * _ODD
        order = np.argsort(spread)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.spread = np.append(spread[order], np.iinfo(np.uint64).max)
        self.values = np.append(values[order].astype(np.float32), np.float32(np.nan))
        self.start = np.searchsorted(spread[order], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        want = code * _ODD
        at = self.start[want >> self.shift]
        found = self.spread[at]
        behind = np.flatnonzero(found < want)
        while len(behind):
            at[behind] += 1
            next_ = self.spread[at[behind]]
            found[behind] = next_
            behind = behind[next_ < want[behind]]
        return np.where(found == want, self.values[at], np.float32(np.nan))


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln gamma(z) for z > 0 by Stirling's series at z + 8."""
    low = np.ones_like(z)
    for k in range(8):
        low = low * (z + k)
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)
