"""Numpy kernels for sets of shingles: word hashes, 64-bit shingle sets and circulant MinHash signatures.

Circulant MinHash needs two permutations: the first places a set's elements, the second is read at circularly shifted places, one
shift per coordinate: ``h_k(S) = min over i in S of pi[(sigma[i] - k) mod D]``.  The K values of one element are K neighbours of
``pi``, so a signature is a gather of short runs and a minimum.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SEED = 20_240_601
#: Places of the permutations.
PLACES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def odd(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


@lru_cache(maxsize=2)
def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """``sigma``, and all runs of ``k`` neighbours of ``pi`` (a view, one run ending at each place)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    sigma, pi = rng.permutation(PLACES).astype(np.int32), rng.permutation(PLACES).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[PLACES - k + 1 :], pi]), k)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every run of bytes that aren't ASCII white space, in order."""
    b = np.frombuffer(data, np.uint8)
    gap = SPACE[b]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = inside.copy()
    ends[:-1] &= gap[1:]
    stops = np.flatnonzero(ends) + 1
    # a multilinear hash: byte values through a table, times a multiplier for the place in the word
    lengths = stops - starts
    offsets = np.cumsum(lengths) - lengths
    terms = odd(256, 1)[b[inside]] * _place_keys(np.arange(int(lengths.sum())) - np.repeat(offsets, lengths))
    return mix(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64))


def _place_keys(place: np.ndarray) -> np.ndarray:
    keys = odd(64, 2)
    if len(place) and int(place.max()) < 64:
        return keys[place]
    far = mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)  # very long words
    return np.where(place < 64, keys[np.minimum(place, 63)], far)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of ``size`` words; fewer words are one shingle, none an empty set."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    if not len(w):
        return w
    n = min(size, len(w))
    keys = odd(size, 3)
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h += w[j : len(w) - n + 1 + j] * keys[j]
    return np.unique(mix(h))


def signature(elements: np.ndarray, k: int) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set."""
    sigma, runs = permutations(k)
    places = sigma[(elements & np.uint64(PLACES - 1)).astype(np.int64)]
    out = np.full(k, PLACES, np.int32)
    for a in range(0, len(places), 2_048):
        np.minimum(out, runs[places[a : a + 2_048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    bands = sig.astype(np.uint64).reshape(-1, rows)
    h = (bands * odd(rows, 4)).sum(axis=1, dtype=np.uint64) + np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h).view(np.int64)


def set_hash(elements: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set."""
    a = elements.sum(dtype=np.uint64)
    b = mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
