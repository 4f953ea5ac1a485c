"""Filter blocks: one Bloom filter for each 2 KiB of data-block offsets."""

from __future__ import annotations

import struct

from strata.functions.bloom import MIN_BITS, MOST_PROBES, WINDOW_BITS, probes
from strata.sources.bytesum import HASH_MULTIPLIER, HASH_SEED, MASK32


def hash32(data: bytes, seed: int = HASH_SEED) -> int:
    h = seed ^ (len(data) * HASH_MULTIPLIER & MASK32)
    whole = len(data) - len(data) % 4
    for (w,) in struct.iter_unpack("<I", data[:whole]):
        h = (h + w) * HASH_MULTIPLIER & MASK32
        h ^= h >> 16
    if tail := data[whole:]:
        h = (h + int.from_bytes(tail, "little")) * HASH_MULTIPLIER & MASK32
        h ^= h >> 24
    return h


def _bits(key: bytes, k: int, bits: int):
    h = hash32(key)
    delta = (h >> 17 | h << 15) & MASK32
    return [((h + j * delta) & MASK32) % bits for j in range(k)]


def make_filter(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    k, size = probes(bits_per_key), -(-max(len(keys) * bits_per_key, MIN_BITS) // 8)
    out = bytearray(size)
    for key in keys:
        for p in _bits(key, k, 8 * size):
            out[p // 8] |= 1 << p % 8
    return bytes(out) + bytes([k])


def may_match(key: bytes, encoded: bytes) -> bool:
    if len(encoded) < 2:
        return False
    if encoded[-1] > MOST_PROBES:
        return True
    return all(encoded[p // 8] >> p % 8 & 1 for p in _bits(key, encoded[-1], 8 * (len(encoded) - 1)))


def encode(blocks: list[tuple[int, list[bytes]]], bits_per_key: int = 10) -> bytes:
    """``(offset, keys)`` of data blocks in order -> the filter block. A window without keys has an empty filter."""
    windows: dict[int, list[bytes]] = {}
    for offset, keys in blocks:
        windows.setdefault(offset >> WINDOW_BITS, []).extend(keys)
    out, offsets = bytearray(), []
    for i in range(max((w for w, keys in windows.items() if keys), default=-1) + 1):
        offsets.append(len(out))
        if windows.get(i):
            out += make_filter(windows[i], bits_per_key)
    return bytes(out) + struct.pack(f"<{len(offsets) + 1}I", *offsets, len(out)) + bytes([WINDOW_BITS])


def block_may_match(encoded: bytes, offset: int, key: bytes) -> bool:
    """Whether the data block at ``offset`` may hold ``key``; damaged filter blocks may hold anything."""
    if len(encoded) < 5:
        return True
    array = struct.unpack_from("<I", encoded, len(encoded) - 5)[0]
    if array > len(encoded) - 5:
        return True
    index, n = offset >> encoded[-1], (len(encoded) - 5 - array) // 4
    if index >= n:
        return True
    start, limit = struct.unpack_from("<2I", encoded, array + 4 * index)
    if start == limit:
        return False
    return may_match(key, encoded[start:limit]) if start < limit <= array else True
