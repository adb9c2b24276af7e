"""64-bit hashes of substrings and word shingles for whole byte arrays at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
#: A random odd multiplier and a random word for every byte.
STEP = 0x9E3779B97F4A7C15
LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((STEP, pow(STEP, -1, 2**64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[k] = np.cumprod(run, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def forget() -> None:
    """Drop the powers; they are as many as the longest text had bytes and are made again when needed."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a word over all of it; works in place on a new array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two identifiers in order."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + np.uint64(1))


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * up[: len(data)], out=out[1:])
    return out


def substrings(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``[start, end)``, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(prefix: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all ``q``-grams."""
    n = max(0, len(prefix) - q)
    _, down = powers(len(prefix))
    return mix((prefix[q:] - prefix[:n]) * down[:n])


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of a text; fewer words: one hash of them all; none: empty."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    black = np.ones(len(data) + 2, bool)
    black[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends = np.flatnonzero(black[:-1] & ~black[1:]), np.flatnonzero(~black[:-1] & black[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = substrings(running(data), starts, ends)
    runs = max(1, len(words) - size + 1)
    size = min(size, len(words))
    out = mix(words[:runs] + np.uint64(size))
    for k in range(1, size):
        out = pair(out, words[k : k + runs])
    return np.unique(out)


def fingerprint(ids: np.ndarray) -> int:
    """Signed 64-bit identifier of a set of hashes."""
    with np.errstate(over="ignore"):
        total = mix(ids * np.uint64(0x9FB21C651E98DF25) + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(ids))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
