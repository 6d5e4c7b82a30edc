"""Vectorised hashes of n-grams of whole texts, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .encode import slices

SLICE = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * SLICE, 1 << (n - 1).bit_length()) if n else 2 * SLICE
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        up, down = np.full(size, _P), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than the space, in order."""
    word = data != 32
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    start, end = edge[::2], edge[1::2]
    return mixed((total[end] - total[start]) * down[start])


def ngrams(h: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of 1 to ``most`` tokens whose hashes are ``h``."""
    now = h
    yield now
    for k in range(1, most):
        if len(h) <= k:
            return
        now = mixed(now[:-1] * _P + h[k:])
        yield now


def text_slices(text: str | None) -> Iterator[bytes]:
    return slices((text or "").encode(), SLICE)
