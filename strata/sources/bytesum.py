"""Checksums and hashes of byte strings in NumPy: of one long string by lanes, of many short ones side by side."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

# Fixed values of the formats.
MASK32 = 0xFFFFFFFF
CRC_POLYNOMIAL, CRC_MASK_DELTA = 0x82F63B78, 0xA282EAD8
HASH_MULTIPLIER, HASH_SEED = 0xC6A4A793, 0xBC9F1D34
#: Strings of at least so many bytes are cut into lanes of about LANE bytes.
LONG, LANE = 2048, 128


def crc_table() -> list[int]:
    table = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (CRC_POLYNOMIAL if x & 1 else 0)
        table.append(x)
    return table


_TABLE = crc_table()
_STEPS = np.array(_TABLE, np.uint32)


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it makes of each byte at each place."""
    return op[0][x & 255] ^ op[1][x >> 8 & 255] ^ op[2][x >> 16 & 255] ^ op[3][x >> 24]


@lru_cache(maxsize=64)
def _zeros(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a checksum's state, by doubling."""
    places = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    if n == 1:
        return _STEPS[places & 255] ^ places >> 8
    half = _zeros(n // 2)
    whole = _apply(half, half)
    return _apply(_zeros(1), whole) if n % 2 else whole


def crc32c(data: bytes, start: int = 0) -> int:
    """CRC-32C (Castagnoli); ``start`` is the checksum of what comes before. Long strings are cut into lanes whose
    states are computed side by side and then joined, as the state is linear in the bytes."""
    crc, lanes = start ^ MASK32, 0
    if len(data) >= LONG:
        lanes = min(4096, len(data) // LANE)
        step = len(data) // lanes
    rest = len(data) - (lanes * step if lanes else 0)
    for b in data[:rest]:
        crc = _TABLE[(crc ^ b) & 255] ^ (crc >> 8)
    if lanes:
        bytes_ = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=rest).reshape(lanes, step).T)
        state = np.zeros(lanes, np.uint32)
        for row in bytes_:
            state = _STEPS[(state ^ row) & 255] ^ state >> 8
        a, b, c, d = (x.tolist() for x in _zeros(step))
        for x in state.tolist():
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24] ^ x
    return crc ^ MASK32


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + CRC_MASK_DELTA) & MASK32


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, where each string starts and how long it is, longest first, and that order."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)) if len(column) else np.zeros(0, np.int64)
    order = np.argsort(-lengths, kind="stable")
    return data, offsets[:-1][order], lengths[order], order


def _longer(lengths: np.ndarray, most: int) -> list[int]:
    """For each j below ``most``, how many of the lengths, longest first, are above j."""
    return (len(lengths) - np.searchsorted(lengths[::-1], np.arange(most), "right")).tolist()


def crc32c_of(column: pa.Array, start: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32C of each string of a column."""
    data, at, lengths, order = _strings(column)
    crc = np.full(len(order), MASK32, np.uint32) if start is None else (start.astype(np.uint32) ^ np.uint32(MASK32))[order]
    long = int((lengths >= LONG).sum())
    for i in range(long):
        crc[i] = crc32c(data[at[i] : at[i] + lengths[i]].tobytes(), int(crc[i]) ^ MASK32) ^ MASK32
    crc, at, lengths = [crc[:long], crc[long:]], at[long:], lengths[long:]
    for j, k in enumerate(_longer(lengths, int(lengths.max(initial=0)))):
        state = crc[1][:k]
        crc[1][:k] = _STEPS[(state ^ data[at[:k] + j]) & 255] ^ state >> 8
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(crc) ^ np.uint32(MASK32)
    return out


def hash32_of(column: pa.Array, seed: int = HASH_SEED) -> np.ndarray:
    """The 32-bit hash of each string of a column: words of four bytes are mixed in by multiplication and shifts."""
    data, at, lengths, order = _strings(column)
    m = np.uint32(HASH_MULTIPLIER)
    h = np.uint32(seed) ^ lengths.astype(np.uint32) * m
    byte = lambda k, j: data[at[:k] + j].astype(np.uint32)
    words = lengths // 4
    for j, k in enumerate(_longer(words, int(words.max(initial=0)))):
        x = (h[:k] + (byte(k, 4 * j) | byte(k, 4 * j + 1) << 8 | byte(k, 4 * j + 2) << 16 | byte(k, 4 * j + 3) << 24)) * m
        h[:k] = x ^ x >> 16
    rest, tail = lengths % 4, np.zeros(len(h), np.uint32)
    for j in range(3):
        i = np.flatnonzero(rest > j)
        tail[i] |= data[at[i] + 4 * words[i] + j].astype(np.uint32) << np.uint32(8 * j)
    x = (h + tail) * m
    h = np.where(rest > 0, x ^ x >> 24, h)
    out = np.empty(len(order), np.int64)
    out[order] = h
    return out


def fixed_of(column: pa.Array, width: int) -> pa.Array:
    """The little-endian number in the first ``width`` bytes of each string of a column; null if there are fewer."""
    data, at, lengths, order = _strings(column)
    k = int((lengths >= width).sum())
    found, kept = np.zeros(len(order), np.uint64), np.zeros(len(order), bool)
    for i in range(width):
        found[order[:k]] |= data[at[:k] + i].astype(np.uint64) << np.uint64(8 * i)
    kept[order[:k]] = True
    return pa.array(found.view(np.int64), pa.int64(), mask=~kept)


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def take_varint(data: bytes, at: int, most: int = 10) -> tuple[int, int]:
    """The number and the place after it; ValueError if it is cut short or too long."""
    n = 0
    for i in range(most):
        if at + i >= len(data):
            break
        n |= (data[at + i] & 127) << (7 * i)
        if data[at + i] < 128:
            return n, at + i + 1
    raise ValueError("bad varint")
