"""A cuckoo filter over 128-bit keys, with whole arrays inserted, probed and deleted at once."""

from __future__ import annotations

import numpy as np

#: Slots in a bucket, the load a new table is sized for, and rounds of moves before giving up.
SLOTS, LOAD, ROUNDS = 4, 0.85, 400


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key may lie in two buckets.

    A probe never misses a key that was inserted and not deleted; it reports another key with a
    chance of about 8 / 65535.  A full table gets a further one beside it, so inserts do not fail.
    """

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD)))))
        return cls([np.zeros((buckets, SLOTS), np.uint16)])

    @classmethod
    def loads(cls, blobs: list[bytes]) -> CuckooFilter:
        return cls([np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy() for b in blobs])

    def dumps(self) -> list[bytes]:
        return [t.tobytes() for t in self.tables]

    @staticmethod
    def _print(second: np.ndarray) -> np.ndarray:
        return (second.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    @staticmethod
    def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 5) & (buckets - 1))

    def _places(self, first: np.ndarray, mark: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = (first.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (len(table) - 1)
        return one, self._other(one, mark, len(table))

    def insert(self, first: np.ndarray, second: np.ndarray) -> None:
        """Adds keys given as two int64 halves; equal keys are added as often as given."""
        mark = self._print(second)
        rest = self._fill(self.tables[-1], self._places(first, mark, self.tables[-1])[0], mark)
        if len(rest[0]):  # what found no room: fingerprints and buckets of the full table
            bits = int(np.log2(len(self.tables[-1])))
            spare = np.zeros((max(1, 1 << bits), SLOTS), np.uint16)
            while len(rest[0]):
                rest = self._fill(spare, *rest)
                self.tables.append(spare)
                spare = np.zeros_like(spare)

    def _fill(self, table: np.ndarray, bucket: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds in which every bucket takes what it has room for and passes the rest on."""
        rng = np.random.default_rng(len(table))
        for turn in range(ROUNDS):
            if not len(bucket):
                break
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            place = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = table[bucket] == 0
            fits = place < free.sum(1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), place[fits]]
            table[bucket[fits], slot] = mark[fits]
            first = ~fits & (place == free.sum(1))  # one for each full bucket may push another out
            if turn > 1 and first.any():
                out = rng.integers(0, SLOTS, first.sum())
                pushed = table[bucket[first], out].copy()
                table[bucket[first], out] = mark[first]
                mark = mark.copy()
                mark[first] = pushed
            bucket, mark = self._other(bucket[~fits], mark[~fits], len(table)), mark[~fits]
        return bucket, mark

    def contains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mark = self._print(second)
        found = np.zeros(len(first), bool)
        for table in self.tables:
            for bucket in self._places(first, mark, table):
                found |= (table[bucket] == mark[:, None]).any(1)
        return found

    def delete(self, first: np.ndarray, second: np.ndarray) -> int:
        """Takes one copy of each key out; keys must have been inserted. Returns how many were.

        In a round every key points at a slot with its fingerprint; of keys that point at the
        same slot one takes it, and the others look again.
        """
        mark, gone = self._print(second), 0
        for table in self.tables:
            for which in (0, 1):
                while len(first):
                    bucket = self._places(first, mark, table)[which]
                    match = table[bucket] == mark[:, None]
                    slot = bucket * SLOTS + match.argmax(1)
                    hit = np.flatnonzero(match.any(1))
                    if not len(hit):
                        break
                    _, one = np.unique(slot[hit], return_index=True)
                    taken = hit[one]
                    table.reshape(-1)[slot[taken]] = 0
                    gone += len(taken)
                    left = np.ones(len(first), bool)
                    left[taken] = False
                    first, mark = first[left], mark[left]
        return gone
