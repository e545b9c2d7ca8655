"""Word shingles as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PERIOD = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix(np.arange(1000, 1000 + _PERIOD, dtype=np.uint64)) | np.uint64(1)


def _places(offsets: np.ndarray) -> np.ndarray:
    values = _PLACES[offsets & (_PERIOD - 1)]
    far = offsets >= _PERIOD
    if far.any():
        values[far] = mix(values[far] + (offsets[far] // _PERIOD).astype(np.uint64)) | np.uint64(1)
    return values


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words every text has; A-Z are lower-cased, words end at ASCII white space."""
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    offsets = np.arange(raw.size) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [raw.size]))))
    # Multilinear hashing: every byte times the random value of its place in the word, summed by differences of totals.
    totals = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _places(offsets), out=totals[1:])
    hashes = mix((totals[ends] - totals[starts]) ^ ((ends - starts).astype(np.uint64) * _BASE))
    return hashes, np.diff(np.searchsorted(starts, np.append(0, ends_of_texts)))


def shingle_sets(texts: list[str | None], width: int = 5, batch_bytes: int = 1 << 18) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run, an empty or null one has none."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    first = 0
    while first < len(coded):
        last, size = first, 0
        while last < len(coded) and (last == first or size + len(coded[last]) <= batch_bytes):
            size += len(coded[last])
            last += 1
        out += _sets(coded[first:last], width)
        first = last
    return out


def _sets(coded: list[bytes], width: int) -> list[np.ndarray]:
    words, counts = word_hashes(coded)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    runs = {n: np.full(words.size, np.uint64(n)) for n in range(1, width + 1)}
    for n, run in runs.items():
        if n == width or ((counts > 0) & (counts < width)).any():
            for i in range(n):
                run = mix(run * _BASE + padded[i:i + words.size])
            runs[n] = run
    out = []
    start = 0
    for count in counts.tolist():
        n = min(count, width)
        own = np.sort(runs[n][start:start + count - n + 1]) if count else words[:0]
        out.append(own[np.append(True, own[1:] != own[:-1])] if own.size else own)
        start += count
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    place = np.searchsorted(b, a)
    return int((b[np.minimum(place, b.size - 1)] == a).sum())
