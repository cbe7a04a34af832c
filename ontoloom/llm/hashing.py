"""64-bit hashes of words, word windows and byte windows, vectorised over a text."""

from __future__ import annotations

import numpy as np

U = np.uint64
WORDS = 1 << 14  # that `block_words` hashes at a time
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_MIX = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_SEPARATOR = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i <= n; the table grows by doubling."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        steps = np.full(1 << max(16, int(n).bit_length()), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def stretches(a: np.ndarray, left: np.ndarray, right: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash (not mixed) of the bytes [left, right) of a uint8 array."""
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * _power(base, len(a))[: len(a)], out=run[1:])
    return (run[right] - run[left]) * _power(_inverse(base), len(a))[left]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def separators(a: np.ndarray) -> np.ndarray:
    """Places of ASCII white space in a uint8 array."""
    return np.flatnonzero(_SEPARATOR[a])


def words(text: bytes) -> np.ndarray:
    """Hash of every word (longest run without ASCII white space), in order."""
    a = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], _SEPARATOR[a], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * _power(BASE, len(a))[: len(a)], out=run[1:])
    return mix((run[end] - run[start]) * _power(_inverse(BASE), len(a))[start] + (end - start).astype(np.uint64))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows; a shorter text is one window; without words none."""
    w = words(text)
    m = max(1, len(w) - n + 1)
    if not len(w):
        return w
    h = np.full(m, len(w) if len(w) < n else n, np.uint64)
    for i in range(min(n, len(w))):
        h += w[i : i + m] * _MIX[i]
    return np.unique(mix(h))


def windows(a: np.ndarray, length: int) -> np.ndarray:
    """Hash (not mixed) of every run of `length` bytes of a uint8 array, by doubling."""
    run, n, power = _BYTES[a], 1, BASE
    out, have = None, 0
    while True:
        if length & n:
            if out is None:
                out, have = run, n
            else:
                m = len(run) - have
                out = out[:m] * U(power) + run[have : have + m]
                have += n
        if 2 * n > length:
            return out
        run = run[:-n] * U(power) + run[n:]
        n, power = 2 * n, power * power % (1 << 64)


def block_words(a: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that lie back to back in `a`, and where each word starts; a text's start ends the word before."""
    inside = ~_SEPARATOR[a]
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    cut = start[(start > 0) & (start < len(a))]
    before[cut] = False
    after[cut - 1] = False
    left, right = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(left), np.uint64)
    for i in range(0, len(left), WORDS):  # a hash does not depend on the place, and short stretches need little memory
        s, e = left[i : i + WORDS], right[i : i + WORDS]
        out[i : i + WORDS] = mix(stretches(a[s[0] : e[-1]], s - s[0], e - s[0]) + (e - s).astype(np.uint64))
    return out, left


def block_shingles(a: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[np.ndarray]:
    """`shingles` of each of the texts, hashed in one go."""
    w, at = block_words(a, start)
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    m = max(0, len(w) - n + 1)
    h = np.full(m, n, np.uint64)
    for i in range(n if m else 0):
        h += w[i : i + m] * _MIX[i]
    h = mix(h)
    out = []
    for f, e in zip(first.tolist(), last.tolist()):
        if e - f >= n:
            out.append(np.unique(h[f : e - n + 1]))
        elif e > f:
            out.append(mix(np.array([e - f], np.uint64) + np.add.reduce(w[f:e] * _MIX[: e - f])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
