"""What Arrow passes share: batches in small pieces, CRC-32 values of all windows of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa


def pieces(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, at most `most` bytes at a time or one row: Spark's batches are bounded by rows alone, and what a
    pass makes of a row in Python takes many times its bytes."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


@cache
def _crc_tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 table of bytes, and [n, k, b]: what byte k of a register, being b, becomes when n zero bytes follow."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    after = np.empty((most + 1, 4, 256), np.uint32)
    after[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(most):
        after[n + 1] = byte[after[n] & 0xFF] ^ (after[n] >> 8)
    return byte, after


def window_crcs(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For UTF-8 bytes: where each run of `size` code points begins and ends, and its CRC-32.

    CRC-32 is linear but for its first and last steps: the register of two strings is that of the first, moved on by the bytes of the
    second, xor that of the second. Windows are put together from windows of 1, 2, 4, ... code points, all places at once."""
    byte, after = _crc_tables(4 * size)
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    count = len(begins) - size + 1
    if count < 1:
        return begins[:0], begins[:0], np.zeros(0, np.uint32)
    n = np.diff(begins, append=len(data))
    plain = len(begins) == len(data)  # a byte each

    def moved(register: np.ndarray, by: np.ndarray | int) -> np.ndarray:
        parts = [(register >> np.uint32(8 * k)) & np.uint32(0xFF) for k in range(4)]
        found = [after[by, k][p] if isinstance(by, int) else after[by, k, p] for k, p in enumerate(parts)]
        return found[0] ^ found[1] ^ found[2] ^ found[3]

    one = byte[data[begins]]
    for k in range(1, 1 if plain else 4):
        at = np.flatnonzero(n > k)
        one[at] = byte[(one[at] ^ data[begins[at] + k]) & 0xFF] ^ (one[at] >> 8)
    # (register, bytes, code points) of the windows whose lengths are powers of two, and of those put together so far
    power, power_n, width = one, n, 1
    whole: np.ndarray | None = None
    whole_n, done = n[:0], 0
    while True:
        if size & width:
            if whole is None:
                whole, whole_n = power, power_n
            else:
                m = len(power) - done
                whole, whole_n = moved(whole[:m], width if plain else power_n[done:]) ^ power[done:], whole_n[:m] + power_n[done:]
            done += width
        if width * 2 > size:
            break
        m = len(power) - width
        power, power_n = moved(power[:m], width if plain else power_n[width:]) ^ power[width:], power_n[:m] + power_n[width:]
        width *= 2
    ends = moved(np.full(1, 0xFFFFFFFF, np.uint32), size) if plain else moved(np.full(count, 0xFFFFFFFF, np.uint32), whole_n[:count])
    return begins[:count], np.append(begins[size:], len(data)), whole[:count] ^ ends ^ np.uint32(0xFFFFFFFF)
