"""Hashes of word shingles and min-hash sketches of many texts at once.

Words are what ASCII white space separates, with A-Z in lower case.  Everything is computed on
the bytes of a batch of texts as arrays, so there is no work in Python for each word.
"""

from __future__ import annotations

import numpy as np

#: Words in a shingle, coordinates of a sketch, and bytes of text treated together.
WORDS, COORDINATES, CHUNK = 5, 16, 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(cache.get("up", ())) < n:
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            cache[name] = np.cumprod(steps, dtype=np.uint64)
    return cache["up"], cache["down"]


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts one after the other, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    blank = _SPACE[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    first = np.searchsorted(starts, edges)
    n_words = np.diff(first)
    counts = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    if not len(words):
        return np.zeros(0, np.uint64), counts
    # the place of a shingle's first word; words beyond the end of a short text count as nothing
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[text]
    total = n_words[text].clip(max=WORDS).astype(np.uint64)
    for k in range(WORDS):
        there = at + k < first[text + 1]
        total = total + np.where(there, words[np.minimum(at + k, len(words) - 1)] * _PLACE[k], np.uint64(0))
    return mixed(total), counts


def _chunks(texts: list[str | None]):
    rows, size = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace").lower()
        if rows and size + len(raw) > CHUNK:
            yield rows
            rows, size = [], 0
        rows.append(raw)
        size += len(raw)
    if rows:
        yield rows


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    out = []
    for rows in _chunks(texts):
        values, counts = _hashed(rows)
        out += [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
    return out


def sketches(texts: list[str | None], count: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (texts, ``count`` coordinates), and whether each text has a word (else its sketch is 0).

    Coordinate k is the least of a text's shingle hashes times the k-th odd number, so two texts
    agree in it with a probability of their Jaccard similarity.  Of the hashes the high 32 bits
    are used: equal minima stay equal, and different ones hardly ever agree.
    """
    odd = (mixed(np.arange(count, dtype=np.uint64) + np.uint64(20240229)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    parts, some = [], []
    for rows in _chunks(texts):
        values, counts = _hashed(rows)
        values, full = (values >> np.uint64(32)).astype(np.uint32), counts > 0
        sketch = np.zeros((len(rows), count), np.uint32)
        if full.any():
            starts = (np.cumsum(counts) - counts)[full]
            for k in range(count):
                sketch[full, k] = np.minimum.reduceat(values * odd[k], starts)
        parts.append(sketch)
        some.append(full)
    return np.concatenate(parts) if parts else np.zeros((0, count), np.uint32), np.concatenate(some) if some else np.zeros(0, bool)
