"""Word shingles of texts as 64-bit hashes, many documents at a time.

Words are the runs of non-space bytes, A-Z lower-cased. A shingle is ``width``
consecutive words; a text with fewer words is one shingle; a text without words has
none. Hashes are polynomials over mixed bytes, computed for all bytes of a block at
once, so there is no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK = 1 << 18  # bytes of text hashed at once; working arrays take some sixty times as much

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_plain = np.arange(256)
_lower = _plain + 32 * ((_plain >= 65) & (_plain < 91))
#: A number for each byte, with and without A-Z lower-cased.
_BYTE = {fold: mix((t.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)) for fold, t in ((False, _plain), (True, _lower))}
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64."""
    return np.cumprod(np.r_[_U(1), np.full(n, _BASE, np.uint64)])


_SHORT = _powers(256)


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and how many words lie before each place in ``starts``.

    A word never crosses a place in ``starts``.
    """
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[starts < len(data)]
    first[inner] = solid[inner]
    before = np.r_[0, np.cumsum(first)]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, np.uint64), before[starts]
    heads = np.flatnonzero(first[at])
    lengths = np.diff(np.r_[heads, len(at)])
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    longest = int(lengths.max())
    values = _BYTE[fold][data[at]] * (_SHORT if longest <= len(_SHORT) else _powers(longest))[place]
    words = np.add.reduceat(values, heads)
    return mix(words + lengths.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), before[starts]


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of one document, sorted."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mix(np.array([(words * _STEP[:n]).sum() + _U(n)], np.uint64))
    total = words[: n - width + 1] * _STEP[0]
    for j in range(1, width):
        total += words[j : n - width + 1 + j] * _STEP[j]
    return np.unique(mix(total + _U(width)))


def _long_text(data: np.ndarray, fold: bool) -> np.ndarray:
    """Words of a text larger than a block, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            rest = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            end = end + (int(rest[0]) if len(rest) else min(BLOCK, len(data) - end))
        out.append(word_hashes(data[at:end], np.array([0]), fold)[0])
        at = end
    return np.concatenate(out)


def texts_and_words(column: pa.Array, fold: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and the word hashes of each text of a string column; null has none."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1, n)
        if j <= i:  # one text is larger than a block
            text = raw[at[i] : at[i + 1]]
            yield text, _long_text(text, fold)
            i += 1
            continue
        words, before = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i], fold)
        for k in range(j - i):
            yield raw[at[i + k] : at[i + k + 1]], words[before[k] : before[k + 1]]
        i = j


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingle set of each text of a string column; null has none."""
    for _, words in texts_and_words(column):
        yield shingle_set(words, width)
