"""A cuckoo filter over 16-byte keys: insertions, deletions, and vectorised lookups."""

from __future__ import annotations

import numpy as np

BUCKET = 4
KICKS = 500


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; the bucket count is a power of two.

    Lookups never miss a key that was inserted and not deleted; about 1 in 8,000 other keys is
    taken for present. Only keys that were inserted may be deleted.
    """

    def __init__(self, capacity: int = 16, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (BUCKET * 0.85)))))
            table = np.zeros((buckets, BUCKET), np.uint16)
        self.table = table
        self._state = 0x9E3779B9

    @staticmethod
    def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket hash and non-zero fingerprint of keys given as (n, 16) bytes."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        return words[:, 0], (words[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)

    def _other(self, bucket, mark):
        return (bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & np.uint64(len(self.table) - 1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys, (n, 16) bytes; False when the table is too full, then it must be rebuilt larger."""
        home, marks = self._parts(keys)
        first = home & np.uint64(len(self.table) - 1)
        for bucket, mark in zip(first, marks):
            if not self._insert(bucket, mark):
                return False
        return True

    def _insert(self, bucket: np.uint64, mark: np.uint16) -> bool:
        for _ in range(KICKS):
            for b in (bucket, self._other(bucket, mark)):
                row = self.table[int(b)]
                free = np.flatnonzero(row == 0)
                if free.size:
                    row[free[0]] = mark
                    return True
            self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
            at = self._state >> 8 & BUCKET - 1
            row = self.table[int(bucket)]
            mark, row[at] = row[at].copy(), mark
            bucket = self._other(bucket, mark)
        return False

    def delete(self, keys: np.ndarray) -> None:
        home, marks = self._parts(keys)
        for h, mark in zip(home, marks):
            bucket = h & np.uint64(len(self.table) - 1)
            for b in (bucket, self._other(bucket, mark)):
                row = self.table[int(b)]
                at = np.flatnonzero(row == mark)
                if at.size:
                    row[at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        home, marks = self._parts(keys)
        first = home & np.uint64(len(self.table) - 1)
        second = self._other(first, marks)
        wanted = marks[:, None]
        return (self.table[first.astype(np.int64)] == wanted).any(1) | (self.table[second.astype(np.int64)] == wanted).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, BUCKET).copy())

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds the keys, grown until they fit."""
        capacity = len(keys)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity = max(64, capacity * 2)
