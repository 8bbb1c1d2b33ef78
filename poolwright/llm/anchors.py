"""Anchors: a sparse choice of places such that equal strings choose alike.

Every string of ``width`` bytes has one anchor in it: the start of its smallest
``gram``-byte piece by a hash, the leftmost one of equals. Neighbouring strings mostly
share theirs, so an anchor stands for a run of string starts. Equal strings have their
anchors at the same place, wherever they occur.
"""

from __future__ import annotations

import numpy as np

from poolwright.llm.shingles import mix

PLACES = 20  # bits of a place inside a block
BLOCK = 1 << 18

_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
_SECOND = mix((np.arange(256, dtype=np.uint64) + _U(999)) * _U(0xC2B2AE3D27D4EB4F))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(n, base, np.uint64)])


_N = BLOCK + (1 << 12)
_UP = _powers(int(_BASE), _N)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), _N)


def prefix_sums(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Sums from which the hash of any piece of ``data`` follows; at most a block and some."""
    return np.r_[_U(0), np.cumsum(table[data] * _UP[: len(data)])]


def hashes(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hashes of pieces that depend on their bytes alone."""
    return mix((sums[starts + lengths] - sums[starts]) * _DOWN[starts])


def anchor_runs(data: np.ndarray, sums: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of each string start in ``data`` (fewer than 2^20 bytes)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    grams = len(data) - gram + 1
    raw = mix((sums[gram:] - sums[:grams]) * _DOWN[:grams])
    low = (raw >> _U(PLACES) << _U(PLACES)) | np.arange(grams, dtype=np.uint64)
    span, need = 1, width - gram + 1
    while 2 * span <= need:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = need - span
    low = np.minimum(low[:n], low[rest : rest + n]) if rest else low[:n]
    return (low & _U((1 << PLACES) - 1)).astype(np.int64)
