"""Vectorised rolling hashes over the words of one text."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _inverse(b: int) -> int:
    x = 1
    for _ in range(6):
        x = x * (2 - b * x) % (1 << 64)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a text: their bounds in its UTF-8 bytes and their hashes."""

    def __init__(self, text: str):
        self.data = text.encode()
        raw = np.frombuffer(self.data, np.uint8)
        edges = np.diff(np.concatenate(([0], (~_SPACE[raw]).view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def list(self) -> list[bytes]:
        return self.data.split()


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    n = len(words) - k + 1
    return _mixed((sums[k:] - sums[:-k]) * down[:n])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w``."""
    k = 1
    while 2 * k <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (w - k)], a[w - k :]) if k < w else a


def anchors(text: Words, window: int) -> np.ndarray:
    """For every window of ``window`` words the smallest hash of a run of a quarter as many words.

    Equal windows have equal anchors, and neighbouring windows mostly share theirs.
    """
    k = max(1, window // 4)
    return sliding_min(gram_hashes(text.hashes(), k), window - k + 1)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))
