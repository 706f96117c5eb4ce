"""Minimal perfect hash of distinct 64 bit keys: levels of collision-free bits.

Every level hashes the keys that are left into two bits per key; keys alone on
their bit set it and are done, the others go to the next level. A key's slot is
the number of bits set before its own, over all levels: n keys fill the slots
0 .. n-1. Lookups of foreign keys end on no bit or on a slot whose fingerprint
differs (wrongly equal once in 2**32).
"""

from __future__ import annotations

import struct

import numpy as np

BITS_PER_KEY = 2.0
_LEVEL_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 bit finaliser over keys and a seed; a bijection for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed) * _LEVEL_STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def build(keys: np.ndarray) -> list[np.ndarray]:
    """One array of bits (as booleans) per level. Keys must be distinct."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        size = max(64, int(BITS_PER_KEY * len(left)))
        at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        counts = np.bincount(at, minlength=size)
        levels.append(counts == 1)
        left = left[counts[at] != 1]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 for keys that end on no bit."""
    out = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(left):
            break
        before = np.cumsum(bits) - bits
        at = (mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = base + before[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


def pack(levels: list[np.ndarray], columns: dict[str, np.ndarray]) -> bytes:
    """Levels and slot-ordered columns as one blob."""
    parts = [struct.pack("<II", len(levels), len(columns))]
    for bits in levels:
        parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
    for name, values in columns.items():
        head = f"{name}:{values.dtype.str}".encode()
        parts += [struct.pack("<IQ", len(head), values.nbytes), head, values.tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    n_levels, n_columns = struct.unpack_from("<II", blob)
    at, levels, columns = 8, [], {}
    for _ in range(n_levels):
        (size,) = struct.unpack_from("<Q", blob, at)
        n = -(-size // 8)
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, n, at + 8), count=size)
        levels.append(bits.astype(bool))
        at += 8 + n
    for _ in range(n_columns):
        n_head, n = struct.unpack_from("<IQ", blob, at)
        name, kind = blob[at + 12 : at + 12 + n_head].decode().split(":", 1)
        columns[name] = np.frombuffer(blob[at + 12 + n_head : at + 12 + n_head + n], kind)
        at += 12 + n_head + n
    return levels, columns
