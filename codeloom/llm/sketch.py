"""Word shingles of texts and their one-permutation MinHash sketches, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE_WORDS = 5
BINS = 128
BANDS = 32
ROWS = BINS // BANDS

#: Distinct words whose hashes a worker keeps (some 30 MB); the cache starts anew when full.
CACHE_WORDS = 200_000

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_PLACES = mix(np.array([(_STEP * (i + 1)) & (2**64 - 1) for i in range(SHINGLE_WORDS)], np.uint64)) | np.uint64(1)
#: Where an empty bin looks for a value: a fixed order of all bins for each, the full bin of least rank counts.
_RANKS = mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(_STEP)).reshape(BINS, BINS)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hasher:
    """Hashes words, remembering those it has seen."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, own: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in own], np.uint64)
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in own:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            return np.array([known[w] for w in own], np.uint64)

    def shingles(self, own: list[bytes]) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle."""
        if not own:
            return np.empty(0, np.uint64)
        h = self.hashes(own)
        if len(h) < SHINGLE_WORDS:
            # the length takes part, so that it differs from any full shingle
            return mix(np.array([int((h * _PLACES[: len(h)]).sum()) ^ len(h)], np.uint64))
        n = len(h) - SHINGLE_WORDS + 1
        total = np.zeros(n, np.uint64)
        for i, place in enumerate(_PLACES):
            total += mix(h[i : i + n] * place)
        return np.unique(mix(total))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of the densified one-permutation sketch of a non-empty set.

    A shingle falls into the bin that its top bits name; the least of each bin counts. An empty
    bin takes the value of the first non-empty bin on its fixed detour, the same for all sets.
    """
    place = (shingles >> np.uint64(57)).astype(np.int64)
    # sorted input: the first of each bin is its least
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    values = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    values[place[first]] = shingles[first]
    full[place[first]] = True
    if not full.all():
        known, empty = np.flatnonzero(full), np.flatnonzero(~full)
        origin = np.arange(BINS)
        origin[empty] = known[_RANKS[np.ix_(empty, known)].argmin(axis=1)]
        values = values[origin]
    rows = values.reshape(BANDS, ROWS)
    total = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP))
    for i in range(ROWS):
        total = mix(total ^ rows[:, i])
    return total


#: The second sketch: many bands of many values, for nodes in crowded buckets.
FINE_BANDS = 128
FINE_ROWS = 12
_FINE_BINS = 2048
#: A detour visits every bin: the odd step of each start, modulo a power of two.
_FINE_STEPS = (mix(np.arange(1, _FINE_BINS + 1, dtype=np.uint64) * _MIX_1) | np.uint64(1)).astype(np.int64) % _FINE_BINS


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """One hash for each fine band of a non-empty set, from the first bins of a densified sketch of 2048."""
    again = np.sort(mix(shingles ^ np.uint64(_STEP)))
    place = (again >> np.uint64(53)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    full = np.zeros(_FINE_BINS, bool)
    values = np.zeros(_FINE_BINS, np.uint64)
    full[place[first]] = True
    values[place[first]] = again[first]
    used = FINE_BANDS * FINE_ROWS
    origin = np.where(full[:used], np.arange(used), -1)
    open_ = np.flatnonzero(~full[:used])
    at = open_.copy()
    while len(open_):
        at = (at + _FINE_STEPS[open_]) % _FINE_BINS
        hit = full[at]
        origin[open_[hit]] = at[hit]
        open_, at = open_[~hit], at[~hit]
    rows = values[origin].reshape(FINE_BANDS, FINE_ROWS)
    total = mix(np.arange(1, FINE_BANDS + 1, dtype=np.uint64) * _MIX_2)
    for i in range(FINE_ROWS):
        total = mix(total ^ rows[:, i])
    return total
