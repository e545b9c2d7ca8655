"""CRC-32 of many byte spans at once, from a table of contributions by byte and distance from the end.

Without its first and last inversion the CRC is linear over bits: the CRC of a span is the XOR of what each byte
contributes at its distance from the end, and of a constant of the span's length, which stands for the inversions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLYNOMIAL = 0xEDB88320
_REACH = 64  # distances in the table, 64 KB, so that it stays in a processor's cache
_AT_ONCE = 1 << 20  # bytes gathered at once
_POWERS = 40  # blocks of _REACH * 2**k bytes, up to 2**45 bytes


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contributions by distance and byte, shifts by ``_REACH * 2**k`` bytes, constants of lengths up to ``_REACH``."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1)
    table = np.empty((_REACH, 256), dtype=np.uint32)
    table[0] = step
    for d in range(1, _REACH):
        table[d] = (table[d - 1] >> 8) ^ step[table[d - 1] & 255]
    shifts = np.empty((_POWERS, 4, 256), dtype=np.uint32)
    shifts[0] = table[[_REACH - 1, _REACH - 2, _REACH - 3, _REACH - 4]]
    for k in range(1, _POWERS):
        shifts[k] = shifted(shifts[k - 1], shifts[k - 1])
    register = np.uint32(0xFFFFFFFF)
    constants = np.zeros(_REACH + 1, dtype=np.uint32)
    for n in range(1, _REACH + 1):
        register = (register >> np.uint32(8)) ^ step[register & np.uint32(255)]
        constants[n] = register ^ np.uint32(0xFFFFFFFF)
    return table, shifts, constants


def shifted(values: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Registers after as many zero bytes as ``shift`` stands for."""
    return (
        shift[0][values & 255] ^ shift[1][(values >> 8) & 255] ^ shift[2][(values >> 16) & 255] ^ shift[3][values >> 24]
    )


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC of as many zero bytes."""
    _, shifts, constants = _tables()
    blocks, rest = np.divmod(lengths, _REACH)
    if not blocks.any():
        return constants[rest]
    # rest first, then whole blocks by the bits of their number; the register is the constant before the last inversion
    register = constants[rest] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(blocks.max()).bit_length()):
        hit = (blocks >> k) & 1 == 1
        register[hit] = shifted(register[hit], shifts[k])
    return register ^ np.uint32(0xFFFFFFFF)


def _contributions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span of 1 to ``_REACH`` bytes."""
    flat = _tables()[0].ravel()
    out = np.empty(len(starts), dtype=np.uint32)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _AT_ONCE, "right")))
        size = lengths[first:last]
        begin = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        away = np.repeat(size - 1, size) - within
        place = np.repeat(starts[first:last], size) + within
        out[first:last] = np.bitwise_xor.reduceat(flat[away * 256 + data[place]], begin)
        first = last
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start : start + length]`` for every span; spans may overlap, an empty one has 0.

    A span longer than the table is cut into blocks from its end. Neighbouring blocks fold in pairs, the earlier one
    shifted by the length of the later, then pairs of pairs, so a span of n bytes takes n steps in log(n) rounds.
    """
    starts, lengths = np.asarray(starts, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
    result = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= _REACH))
    if len(short):
        result[short] = _contributions(data, starts[short], lengths[short])
    long = np.flatnonzero(lengths > _REACH)
    if len(long):
        count = -(-lengths[long] // _REACH)
        owner = np.repeat(np.arange(len(long)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)  # from the end of the span
        stop = (starts[long] + lengths[long])[owner] - number * _REACH
        begin = np.maximum(starts[long][owner], stop - _REACH)
        folded = _contributions(data, begin, stop - begin)
        k = 0
        while len(folded) > len(long):
            pairs = np.flatnonzero(number % 2 == 0)
            odd = number % 2 == 1
            folded[odd] = shifted(folded[odd], _tables()[1][k])
            folded = np.bitwise_xor.reduceat(folded, pairs)
            number = number[pairs] // 2
            k += 1
        result[long] = folded
    return result ^ length_constants(lengths)
