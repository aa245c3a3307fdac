"""Flat numpy views of the words of many texts.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Those bytes never occur
inside a multi-byte UTF-8 character, so words can be found on bytes and equal words are equal byte
strings. Everything works on whole texts; a batch is only cut between texts, so memory is bounded by
``PIECE_BYTES`` or the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in pieces of about this many bytes, so that temporary arrays stay in cache.
PIECE_BYTES = 1 << 20
#: Words longer than this are hashed one by one with blake2b instead of in 8-byte steps.
LONG_WORD = 256

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S32, _S31 = np.uint64(29), np.uint64(32), np.uint64(31)
_TAIL_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Invertible scrambling of 64-bit words (two multiply-shift steps)."""
    h = (h ^ (h >> _S32)) * _K2
    h = (h ^ (h >> _S29)) * _K3
    return h ^ (h >> _S32)


@dataclass
class Piece:
    """Some consecutive texts of a batch: their bytes, and where each text and word lies in them."""

    first: int  # index of the first text within the batch
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, text k is data[bounds[k]:bounds[k + 1]]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()


def pieces(column: pa.Array | pa.ChunkedArray, piece_bytes: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a string column, in order; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + piece_bytes, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield Piece(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Word positions of a piece; the words of text k are ``first[k]:first[k + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(piece: Piece) -> Words:
    inside = ~IS_SPACE[piece.data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = piece.bounds[:-1]
    edge = edge[edge < len(inside)]
    starts_at = inside & ~before
    starts_at[edge] |= inside[edge]  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(starts_at)
    ends_at = np.zeros(len(inside) + 1, dtype=bool)
    ends_at[1:-1] = inside[:-1] & (~inside[1:] | starts_at[1:])
    if len(inside):
        ends_at[-1] = inside[-1]
    return Words(starts, np.flatnonzero(ends_at), np.searchsorted(starts, piece.bounds))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal spans."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * _K1 + _K3)
    if not len(n):
        return h
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(n > LONG_WORD)
    at, left, live = starts, n, None
    if len(long):
        live = np.flatnonzero(n <= LONG_WORD)
        at, left = starts[live], n[live]
    while len(at):
        chunk = eight[at] & _TAIL_MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ chunk) * _K1)
        else:
            h[live] = mix((h[live] ^ chunk) * _K1)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in long:
        h[k] = np.frombuffer(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def gram_hashes(h: np.ndarray, k: int, odd: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """A hash of every k consecutive entries of h, by doubling; entry i covers ``h[i:i + k]``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, base = None, 0, h, 1
    mult = odd | 1
    bits = k
    while bits:  # out covers `done` entries, power covers `base` entries
        if bits & 1:
            if out is None:
                out, done = power, base
            else:
                m = min(len(out), len(power) - done) if len(power) > done else 0
                out = out[:m] * np.uint64(pow(mult, base, 2**64)) + power[done : done + m]
                done += base
        bits >>= 1
        if bits:
            m = len(power) - base
            power = power[:m] * np.uint64(pow(mult, base, 2**64)) + power[base : base + m]
            base *= 2
    return mix(out[:n])
