"""Words of many texts at once, as numpy arrays: offsets, hashes and shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is still handled whole.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have[:n]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letter or digit or part of a non-ASCII character, 2 sign
_KIND[[0x20, *range(0x09, 0x0E), 0]] = 0
for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[a:b] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts of about CHUNK bytes; null is empty.  offsets has one entry more than the run has texts."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string())
    if not len(texts):
        return
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character of an unspaced script begins: U+0E00 to U+0EFF (Thai, Lao) and U+3000 to U+9FFF (kana, Chinese), three bytes each."""
    high = np.flatnonzero((data >= 0xE0) & (data <= 0xE9))
    if not len(high):
        return high
    second = data[np.minimum(high + 1, len(data) - 1)]
    lead = data[high]
    return high[(lead >= 0xE3) | (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)]


def split(data: np.ndarray, offsets: np.ndarray, signs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (and single signs) of a run of texts: starts, ends, hash of the A-Z lower-cased bytes, index of the text.
    Without ``signs``, each character of a script that is written without spaces is a word."""
    kind = _KIND[data]
    word = kind == 1
    edge = np.zeros(len(data) + 1, bool)  # a text's first byte begins a token
    edge[offsets] = True
    before = np.r_[False, word[:-1]] if len(data) else word
    begins = word & (~before | edge[: len(data)])
    if signs:
        begins |= kind == 2
    elif len(alone := unspaced(data)):
        begins[alone] = True
        behind = alone + 3
        behind = behind[behind < len(data)]
        begins[behind] |= word[behind]
    starts = np.flatnonzero(begins)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), empty
    stop = np.r_[begins, True]
    stop[: len(data)] |= ~word if not signs else kind == 0
    stop[offsets] = True
    bounds = np.flatnonzero(stop)
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOW[data].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
    h = finish((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts])
    return starts, ends, h, np.searchsorted(offsets, starts, "right") - 1
