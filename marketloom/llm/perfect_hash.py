"""Minimal perfect hashing of 64-bit keys, in numpy.

Keys are hashed into a level of two bits a key; those alone in their bit stay there, the others go on to the next level
with another hash. A key's index is the number of bits set before its own. Keys of a large set are dealt into shards by
their hash first; :class:`Table` holds many shards as one.
"""

from __future__ import annotations

import numpy as np

#: Levels after which building gives up; a set of n keys needs about log(n) of them.
LEVELS = 64
WORD = 64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (shifts, xors and odd factors)."""
    x = x.astype(np.uint64) + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % 2**64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(32)) * np.uint64(factor)
    return x ^ x >> np.uint64(32)


def shard_hash(keys: np.ndarray) -> np.ndarray:
    """What keys are dealt into shards by: a non-negative 64-bit number."""
    return (mix(keys, LEVELS) >> np.uint64(1)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits in words of 64, keys by their index) of distinct keys."""
    sizes, words, todo = [], [], keys
    while len(todo):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = -(-2 * len(todo) // WORD) * WORD
        at = (mix(todo, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        todo = todo[~alone[at]]
    sizes, words = np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)
    by_index = np.zeros(len(keys), keys.dtype)
    if len(keys):
        by_index[Table([(sizes, words, keys)])._index(keys)] = keys
    return sizes, words, by_index


class Table:
    """Perfect hash functions of shards 0, 1, ... as one, with the keys by their index for verification."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        depth = max([1, *(len(x[0]) for x in shards)])
        self.sizes, self.begins, at = np.zeros((len(shards), depth), np.int64), np.zeros((len(shards), depth), np.int64), 0
        for i, (sizes, _, _) in enumerate(shards):
            self.sizes[i, : len(sizes)] = sizes
            self.begins[i, : len(sizes)] = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
        self.words = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in shards)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in shards)])

    def _index(self, keys: np.ndarray) -> np.ndarray:
        """Each member's index; for other keys any index, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        shard = shard_hash(keys) % max(len(self.sizes), 1) if len(self.sizes) > 1 else np.zeros(len(keys), np.int64)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[todo], level] if len(self.sizes) else np.zeros(len(todo), np.int64)
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = self.begins[shard[todo], level] + (mix(keys[todo], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at // WORD], (at % WORD).astype(np.uint64)
            found = (word >> bit & np.uint64(1)).astype(bool)
            inside = np.bitwise_count(word[found] & (np.uint64(1) << bit[found]) - np.uint64(1))
            out[todo[found]] = self.before[at[found] // WORD] + inside
            todo = todo[~found]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for what is not in the set."""
        out = self._index(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out
