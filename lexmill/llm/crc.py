"""CRC-32 of many byte spans at once, inside one bounded chunk of a Spark task.

A CRC is linear: crc(a + b) is crc(a), shifted by the length of b, xor crc(b). So the CRCs of joined spans come from those of
their parts.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Longer spans are handed to zlib one by one.
SHORT = 64

_U = np.uint32


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=_U)
    for _ in range(8):
        table = np.where(table & _U(1), (table >> _U(1)) ^ _U(0xEDB88320), table >> _U(1))
    return table


_TABLE = _byte_table()


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map that sends bit k to columns[k], applied to each element."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where(x >> _U(k) & _U(1), columns[k], _U(0))
    return out


def _shift_tables(bits: int = 32) -> list[np.ndarray]:
    """For each power of two: four tables by byte of a CRC, whose xor is the CRC after so many zero bytes."""
    ones = _U(1) << np.arange(32, dtype=_U)
    columns, out = _TABLE[ones & _U(255)] ^ (ones >> _U(8)), []
    for _ in range(bits):
        out.append(np.stack([_applied(columns, np.arange(256, dtype=_U) << _U(8 * q)) for q in range(4)]))
        columns = _applied(columns, columns)
    return out


_SHIFTS = _shift_tables()


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRCs as they count in front of `sizes` more bytes."""
    out = crc.astype(_U)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        at = np.flatnonzero(sizes >> bit & 1)
        x, table = out[at], _SHIFTS[bit]
        out[at] = table[0][x & _U(255)] ^ table[1][x >> _U(8) & _U(255)] ^ table[2][x >> _U(16) & _U(255)] ^ table[3][x >> _U(24)]
    return out


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span data[start:end]."""
    sizes = end - start
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    long = int((sizes > SHORT).sum())
    at, lengths = start[order[long:]], sizes[order[long:]]
    crc = np.full(len(at), 0xFFFFFFFF, _U)
    n_longer = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")
    for j, n in enumerate(n_longer):
        head = crc[:n]
        crc[:n] = _TABLE[(head ^ data[at[:n] + j]) & _U(255)] ^ (head >> _U(8))
    out = np.empty(len(sizes), _U)
    out[order[long:]] = ~crc
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def with_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """The CRCs of the same spans with one more byte."""
    state = ~crc
    return ~(_TABLE[(state ^ _U(byte)) & _U(255)] ^ (state >> _U(8)))


def found(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes, none of which crosses one of the texts' `offsets`, and how many
    of them lie before each offset."""
    begins, ends = np.append(inside, False), np.append(False, inside)
    change = begins != ends
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    joined = edge[inside[edge] & inside[edge - 1]]
    starts = np.flatnonzero(change & begins)
    stops = np.flatnonzero(change & ends)
    if len(joined):
        joined = np.unique(joined)
        starts, stops = np.sort(np.append(starts, joined)), np.sort(np.append(stops, joined))
    return starts, stops, np.searchsorted(starts, offsets)
