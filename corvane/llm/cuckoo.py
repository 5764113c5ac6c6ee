"""A cuckoo filter that grows by stages: approximate membership with insertion and deletion, many keys at a time."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 200


class Stage:
    """Buckets of four 16-bit fingerprints; 0 marks an empty slot."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> Stage:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        tags = np.maximum(keys >> np.uint64(48), np.uint64(1))
        first = keys & self.mask
        return tags, first, self.other(first, tags)

    def other(self, at, tag):
        return (at ^ (tag * np.uint64(0x5BD1E995))) & self.mask

    def _settle(self, at: np.ndarray, tags: np.ndarray, free: bool) -> np.ndarray:
        """Fill a free slot of each bucket with its fingerprint, or free a slot that holds it; whether there was one.

        Keys that want slots of one bucket get different ones.
        """
        order = np.lexsort((tags, at))
        a, t = at[order].astype(np.int64), tags[order].astype(np.uint16)
        fits = self.table[a] == (np.uint16(0) if free else t[:, None])
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (not free) & (t[1:] != t[:-1]))) if len(a) else np.zeros(0, bool)
        nth = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        ok = nth < fits.sum(axis=1)
        slot = np.argsort(~fits, axis=1, kind="stable")[np.arange(len(a)), np.minimum(nth, SLOTS - 1)]
        self.table[a[ok], slot[ok]] = t[ok] if free else 0
        done = np.zeros(len(a), bool)
        done[order] = ok
        return done

    def _either(self, keys: np.ndarray, free: bool) -> np.ndarray:
        tags, first, second = self.places(keys)
        done = self._settle(first, tags, free)
        left = np.flatnonzero(~done)
        done[left] = self._settle(second[left], tags[left], free)
        return done

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key has found a slot; the last ones move others to their second buckets."""
        done = self._either(keys, free=True)
        for i in np.flatnonzero(~done).tolist():
            if not (done_now := self._kick(keys[i : i + 1])):
                break
            done[i] = done_now
        return done

    def _kick(self, key: np.ndarray) -> bool:
        tags, first, _ = self.places(key)
        tag, at, moves = tags[0], first[0], []
        for n in range(KICKS):
            k = (int(tag) + n) % SLOTS
            moves.append((at, k, self.table[at, k]))
            tag, self.table[at, k] = np.uint64(self.table[at, k]), tag
            at = self.other(at, tag)
            empty = np.flatnonzero(self.table[at] == 0)
            if len(empty):
                self.table[at, empty[0]] = tag
                return True
        for at, k, old in reversed(moves):  # full: leave it as it was
            self.table[at, k] = old
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        tags, first, second = self.places(keys)
        t = tags.astype(np.uint16)[:, None]
        return (self.table[first.astype(np.int64)] == t).any(axis=1) | (self.table[second.astype(np.int64)] == t).any(axis=1)

    def drop(self, keys: np.ndarray) -> np.ndarray:
        return self._either(keys, free=False)


class CuckooFilter:
    """Stages, each twice as large as the last. Keys are arrays of distinct unsigned 64-bit hashes.

    As long as only keys that were added are dropped, no added key is ever denied.
    """

    def __init__(self, stages: list[Stage] | None = None):
        self.stages = stages or []

    def add(self, keys: np.ndarray) -> None:
        if not self.stages:
            self.reserve(64)
        keys = keys[~self.stages[-1].add(keys)]
        while len(keys):
            self.stages.append(Stage(np.zeros((max(2 * len(self.stages[-1].table), 1), SLOTS), np.uint16)))
            keys = keys[~self.stages[-1].add(keys)]

    def reserve(self, n: int) -> None:
        """Room for ``n`` keys in one stage, if nothing is there yet."""
        if not self.stages:
            self.stages.append(Stage.sized(n))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for s in self.stages:
            found |= s.has(keys)
        return found

    def drop(self, keys: np.ndarray) -> None:
        """Take keys out. One that more than one stage seems to hold stays, as the other may be another key's."""
        held = np.array([s.has(keys) for s in self.stages]).reshape(len(self.stages), len(keys))
        sure = held.sum(axis=0) == 1
        for s, here in zip(self.stages, held):
            s.drop(keys[here & sure])

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.stages), *[len(s.table) for s in self.stages]], "<u4").tobytes()
        return sizes + b"".join(s.table.astype("<u2").tobytes() for s in self.stages)

    @classmethod
    def from_bytes(cls, data: bytes | None) -> CuckooFilter:
        if not data:
            return cls()
        n = int(np.frombuffer(data[:4], "<u4")[0])
        sizes = np.frombuffer(data[4 : 4 + 4 * n], "<u4")
        at, stages = 4 + 4 * n, []
        for size in sizes.tolist():
            end = at + 2 * SLOTS * size
            stages.append(Stage(np.frombuffer(data[at:end], "<u2").reshape(size, SLOTS).copy()))
            at = end
        return cls(stages)
