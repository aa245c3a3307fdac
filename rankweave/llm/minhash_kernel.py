"""One-permutation hashing with optimal densification: numpy kernels for one piece of texts.

A text's set is its distinct ``width``-word shingles. One hash of a shingle gives both its bin (top
bits) and its value, so a sorted set yields every bin's minimum in one pass. An empty bin copies the
first occupied bin along a pseudo-random order of its own (the same for all texts), which keeps the
collision probability of each slot at the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from rankweave.llm.textcore import LOWER, Piece, find_words, gram_hashes, mix, word_hashes


def probe_order(slots: int, seed: int = 7) -> np.ndarray:
    """Row j: the order in which empty bin j looks for an occupied one (a permutation of all bins)."""
    return np.argsort(np.random.default_rng(seed).random((slots, slots)), axis=1)


def shingle_sets(piece: Piece, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts have one shingle, empty ones none."""
    low = Piece(piece.first, LOWER[piece.data], piece.bounds)
    words = find_words(low)
    h = word_hashes(low.data, words.starts, words.ends)
    grams = gram_hashes(h, width)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n:
            out.append(gram_hashes(h[a:b], int(n), odd=0xD6E8FEB86659FD93))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int, probes: np.ndarray) -> np.ndarray:
    """One row of ``slots`` values per set; rows of empty sets are zero and must not be banded."""
    sig = np.zeros(len(sets) * slots, dtype=np.uint64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if not size.sum():
        return sig.reshape(len(sets), slots)
    flat = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)) * slots, size) + (flat >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)
    # sets are sorted, so the first value of a cell is its minimum
    low = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    filled = np.zeros(len(sig), dtype=bool)
    filled[cell[low]] = True
    sig[cell[low]] = flat[low]
    empty = np.flatnonzero(~filled & np.repeat(size > 0, slots))
    own, base = empty % slots, empty // slots * slots
    for turn in range(slots):  # all empty bins of all sets look at their next choice together
        if not len(empty):
            break
        source = base + probes[own, turn]
        hit = filled[source]
        sig[empty[hit]] = sig[source[hit]]
        left = ~hit
        empty, own, base = empty[left], own[left], base[left]
    return sig.reshape(len(sets), slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per text and band; the band's number is part of the key. Slots beyond the last band are not used."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (len(sig), bands))
    for r in range(rows):
        key = mix((key ^ parts[:, :, r]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(r + 1))
    return key


def set_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal pairs."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    b = np.array([mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return a, b
