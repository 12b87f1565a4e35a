"""A minimal perfect hash over keys of two 64-bit hashes, with a stored fingerprint and a record for each key.

Level by level, every key left picks a slot of a bit array of GAMMA slots a key; slots picked once are taken, the other keys go on to the
next level. A key's number is the rank of its slot's bit among all. Keys that are left after LEVELS levels are kept in a list. Equal keys
are refused. Where a caller has one hash only, the second is made of it.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA, LEVELS = 2, 40
MAGIC = b"MPHINDX2"
RECORD = np.dtype([("check", "<u8"), ("shard", "<u4"), ("n", "<u8"), ("offset", "<u8")])


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of x and a salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def both(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.uint64)
    return keys, mix(keys, 1000) if second is None else second.astype(np.uint64)


def slots(keys: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix(keys, level) ^ mix(second, level + 2 * LEVELS)) % np.uint64(size)).astype(np.int64)


def check_of(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The fingerprint that is stored of a key."""
    return mix(keys, 1001) ^ second


def build(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray, second: np.ndarray | None = None) -> bytes:
    """The index of keys with their records, as bytes. Raises if two are equal in both hashes."""
    keys, second = both(keys, second)
    order = np.lexsort((second, keys))
    if ((keys[order[1:]] == keys[order[:-1]]) & (second[order[1:]] == second[order[:-1]])).any():
        raise ValueError("two keys are equal")
    levels, left, number = [], np.arange(len(keys)), np.zeros(len(keys), np.int64)
    done = 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = GAMMA * len(left)
        slot = slots(keys[left], second[left], level, size)
        once = np.bincount(slot, minlength=size) == 1
        taken = once[slot]
        rank = np.cumsum(once) - 1
        number[left[taken]] = done + rank[slot[taken]]
        done += int(once.sum())
        levels.append(once)
        left = left[~taken]
    number[left] = done + np.arange(len(left))
    records = np.zeros(len(keys), RECORD)
    records["check"][number], records["shard"][number], records["offset"][number], records["n"][number] = check_of(keys, second), shard, offset, n
    parts = [MAGIC, struct.pack("<QII", len(keys), len(levels), len(left)), np.stack([keys[left], second[left]], axis=1).astype("<u8").tobytes()]
    for once in levels:
        parts += [struct.pack("<Q", len(once)), np.packbits(once, bitorder="little").tobytes()]
    return b"".join([*parts, records.tobytes()])


class Index:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index")
        n, n_levels, n_left = struct.unpack_from("<QII", data, 8)
        at = 24
        self.left = {tuple(k): i for i, k in enumerate(np.frombuffer(data, "<u8", 2 * n_left, at).reshape(-1, 2).tolist())}
        at += 16 * n_left
        self.levels, done = [], 0
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", data, at)
            length = -(-size // 8)
            bits = np.unpackbits(np.frombuffer(data, np.uint8, length, at + 8), count=size, bitorder="little").astype(bool)
            self.levels.append((bits, np.cumsum(bits) - 1 + done))
            done += int(bits.sum())
            at += 8 + length
        self.done = done
        self.records = np.frombuffer(data, RECORD, n, at)

    def find(self, keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The records of keys, and whether each is in the index as far as its fingerprint tells."""
        keys, second = both(keys, second)
        number = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            slot = slots(keys[left], second[left], level, len(bits))
            hit = bits[slot]
            number[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        if self.left:
            for i in left:
                if (same := self.left.get((int(keys[i]), int(second[i])))) is not None:
                    number[i] = self.done + same
        if not len(self.records):
            return np.zeros(len(keys), RECORD), np.zeros(len(keys), bool)
        found = self.records[np.maximum(number, 0)]
        return found, (number >= 0) & (found["check"] == check_of(keys, second))
