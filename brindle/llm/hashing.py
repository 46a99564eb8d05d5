"""Hashed features of texts, vectorised over the bytes of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PRIME = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_POWERS = np.cumprod(np.full(_CHUNK, _PRIME, np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.full(_CHUNK, pow(_PRIME, -1, 1 << 64), np.uint64), dtype=np.uint64)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_buckets(text: str | None, bits: int) -> np.ndarray:
    """The bucket of each word (run of bytes other than white space), in order; A-Z count as a-z.

    A word's hash is the sum of its bytes times powers of an odd number, so all words of a stretch
    come from two vector operations. Stretches end at white space, where there is some.
    """
    raw = (text or "").encode().lower()
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _CHUNK)
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = cut if cut > at else end
        x = np.frombuffer(raw, np.uint8, end - at, at)
        inside = ~_SPACE[x]
        edge = np.diff(np.r_[0, inside.view(np.int8), 0])
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(x)], dtype=np.uint64)])
            out.append(_mix((sums[ends] - sums[starts]) * _INVERSE[starts], bits))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gram_buckets(text: str, bits: int, size: int = 3) -> Iterator[np.ndarray]:
    """The bucket of each run of `size` bytes of a lower-cased text between two spaces, a stretch at a time."""
    raw = (" " + text.lower() + " ").encode()
    for at in range(0, max(1, len(raw) - size + 1), _CHUNK):
        x = np.frombuffer(raw[at : at + _CHUNK + size - 1], np.uint8).astype(np.uint64)
        h = np.zeros(max(0, len(x) - size + 1), np.uint64)
        for k in range(size):
            h = h * np.uint64(_PRIME) + x[k : k + len(h)] + np.uint64(1)
        yield _mix(h, bits)
