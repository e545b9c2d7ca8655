"""Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017)."""

from __future__ import annotations

import numpy as np

from reportloom.llm.shingles import mix

_STEP = np.uint64(0xD1342543DE82EF95)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set of 64-bit hashes; two sets agree in a coordinate with their Jaccard similarity.

    Round i throws every item into one hashed bin with the value (i, hash); a bin keeps its smallest value. Rounds from
    ``size`` on throw everything into bin i - ``size``, so after twice ``size`` rounds no bin is empty. The work stops
    once the last bin is filled, usually after about size * ln(size) throws in all. An empty set leaves all ones.
    """
    bins = np.full(size, _EMPTY)
    if not items.size:
        return bins
    start = 0
    at_once = max(1, int(size * (np.log(size) + 1)) // items.size)
    while start < 2 * size:
        rounds = np.arange(start, min(start + at_once, 2 * size), dtype=np.uint64)[:, None]
        thrown = mix(items + (rounds + np.uint64(1)) * _STEP)
        place = (thrown >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)
        if start + at_once > size:
            place = np.where(rounds < size, place, rounds - np.uint64(size))
        value = (rounds << np.uint64(40)) | (thrown & np.uint64(0xFFFFFFFFFF))
        np.minimum.at(bins, place.ravel().astype(np.intp), value.ravel())
        start += at_once
        at_once = max(1, size // items.size)
        if bins.max() != _EMPTY:  # later rounds only hold larger values
            break
    return bins


def short_sketch(items: np.ndarray, size: int) -> bytes:
    """One hashed byte of each coordinate."""
    return mix(sketch(items, size) * _STEP).astype(np.uint8).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every short sketch of ``a`` with every one of ``b`` (bytes agree by chance in 1 of 256)."""
    same = np.stack([(b == row).sum(axis=1) for row in a]) / a.shape[1]
    return (same - 1 / 256) / (1 - 1 / 256)
