"""Words [^\\x20\\x09-\\x0D]+ of many texts at once, as 64-bit hashes, after lower-casing A-Z."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash


STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
LONG = 64
#: Masks that keep the first bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    hashes: np.ndarray
    counts: np.ndarray  # of each text
    lengths: np.ndarray  # in bytes
    last: np.ndarray  # byte
    high: np.ndarray  # whether a byte is beyond ASCII


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; data ends with eight bytes of padding."""
    return np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, shapes: bool = True) -> Words:
    """All words of the texts data[start:end], in order. Without shapes, lengths, last and high are empty."""
    none = np.zeros(0, np.int64)
    n = len(raw)
    data = np.zeros(n + 8, np.uint8)
    own = data[:n]
    np.add(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=own)
    solid = ~((own == 32) | ((own - np.uint8(9)) < 5))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = starts < ends  # texts lie side by side: their ends part words
    first[starts[full]] = solid[starts[full]]
    last[ends[full] - 1] = solid[ends[full] - 1]
    at = np.flatnonzero(first)
    if not len(at):
        return Words(np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), none, none, none)
    end = np.flatnonzero(last)
    lengths = end - at + 1
    eights = _eights(data)
    hashes = mix((eights[at] & _FIRST[np.minimum(lengths, 8)]) * _FACTOR + lengths.astype(np.uint64) * STEP)
    more = np.flatnonzero((lengths > 8) & (lengths <= LONG))
    for k in range(8, LONG, 8):
        hashes[more] = mix(hashes[more] + (eights[at[more] + k] & _FIRST[np.minimum(lengths[more] - k, 8)]) * _FACTOR)
        more = more[lengths[more] > k + 8]
        if not len(more):
            break
    for i in np.flatnonzero(lengths > LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[at[i] : end[i] + 1].tobytes())
    counts = np.diff(np.searchsorted(at, np.concatenate([starts, ends[-1:]])))
    if not shapes:
        return Words(hashes, counts, none, none, none)
    high = np.zeros(len(at), bool)
    high[np.searchsorted(at, np.flatnonzero(own >= 128), side="right") - 1] = True
    return Words(hashes, counts, lengths, own[end], high)
