"""Words of many texts at once, as arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to about so many bytes.
STEP = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random odd value for each byte, so that equal sums need equal strings but by rare chance.
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up, down = (np.full(size, base, np.uint64) for base in (_BASE, _INVERSE))
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
        _powers[size] = up, down
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def steps(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, starts): runs of texts of about STEP bytes together, each text ended by a zero byte."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < STEP):
            size += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        yield first, np.frombuffer(b"\0".join(part) + b"\0", np.uint8), starts
        first = last


def spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``inside`` marks; the last byte is never inside."""
    m = inside[raw].view(np.int8)
    edge = np.diff(m, prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * up[: len(raw)], dtype=np.uint64)))
        return mix((sums[ends] - sums[starts]) * down[starts])


def slices(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Runs of spans that cover about STEP bytes each, so that one very long text needs no more memory than many short ones."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP)))
        yield slice(first, last)
        first = last


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """:func:`span_hashes`, by slices."""
    out = [np.empty(0, np.uint64)]
    for part in slices(starts, ends):
        low = starts[part][0]
        out.append(span_hashes(raw[low : ends[part][-1]], starts[part] - low, ends[part] - low))
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes."""
    k = max(0, len(words) - n + 1)
    out = np.full(k, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out * np.uint64(0xD6E8FEB86659FD93 | 1)) + words[i : i + k]
    return mix(out)
