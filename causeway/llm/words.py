"""Words of text buffers as strong hashes, for the operators on word windows and shingles."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from causeway.llm.caches import register
from causeway.llm.tokens import distinct, first_eight

#: Distinct words whose hashes a Python worker keeps.
CACHE_WORDS = 200_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin (n + 1 values)."""
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], full[:-1])) if len(data) else full
    after = np.concatenate((full[1:], [False])) if len(data) else full
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def strong_hash(word: bytes) -> int:
    """64 bits of a keyed cryptographic hash: no text can be made to collide."""
    return int.from_bytes(blake2b(word, digest_size=8, key=b"causeway words").digest(), "little")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_known: dict[bytes, int] = {}
register("shingles", _known.clear)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices of a buffer: of up to seven bytes one to one, of more strong."""
    out = np.zeros(len(starts), dtype=np.uint64)
    length = ends - starts
    short = length < 8
    n = length[short]
    out[short] = mix(first_eight(data, starts[short], n) | n.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(~short)
    at, inverse = distinct(data, starts[long], ends[long])
    if len(_known) > CACHE_WORDS:
        _known.clear()
    whole, hashes = data.tobytes(), []
    for a, b in zip(starts[long[at]].tolist(), ends[long[at]].tolist(), strict=True):
        word = whole[a:b]
        h = _known.get(word)
        if h is None:
            h = strong_hash(word)
            if len(word) <= 64:
                _known[word] = h
        hashes.append(h)
    out[long] = np.array(hashes, dtype=np.uint64)[inverse]
    return out


_STEP = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, also of those that cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h *= _STEP
        h += words[k : k + n]
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one.

    The six highest bits of a hash fall with the letters of its words, so the longest
    shingles, which hardly occur twice by chance, are first in the order.
    """
    data = lower_ascii(data)
    starts, ends, begin = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    letters = np.concatenate(([0], np.cumsum(ends - starts)))

    def placed(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(6)) | ((63 - np.minimum(63, n)).astype(np.uint64) << np.uint64(58))

    windows = window_hashes(words, size)
    windows = placed(windows, letters[size:] - letters[:-size]) if len(windows) else windows
    out = []
    for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(placed(window_hashes(words[a:b], b - a), letters[b : b + 1] - letters[a]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
