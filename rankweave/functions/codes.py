"""Prefix codes and the recursive integer-sequence codec: plain functions on small lists, and their UDFs.

Both work on one short list at a time (an alphabet, one sequence), where relational operators have
nothing to split; sequences themselves are rows and spread over tasks.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType


def code_lengths(weights: list[int]) -> list[int]:
    """Huffman code lengths, ascending, for weights in descending order.

    On ties a leaf is taken before a merged node, and older merged nodes before newer ones, so lengths
    are determined. No weights: no lengths; a single weight: length 0.
    """
    n = len(weights)
    if n < 2:
        return [0] * n
    queue = [(w, 0, n - 1 - k, k) for k, w in enumerate(weights)]  # among equal leaves the last comes first
    heapq.heapify(queue)
    parent: dict[int, int] = {}
    node = n
    while len(queue) > 1:
        a, b = heapq.heappop(queue), heapq.heappop(queue)
        parent[a[3]] = parent[b[3]] = node
        heapq.heappush(queue, (a[0] + b[0], 1, node, node))
        node += 1
    depth = {node - 1: 0}
    for k in range(node - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return sorted(depth[k] for k in range(n))


def grouped_code_lengths(groups: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``code_lengths`` for weights given as ``(weight, how many)``: ``(length, how many)``, ascending.

    Equal nodes are paired all at once, so the work follows the number of distinct weights, not of symbols.
    """
    leaves = sorted(groups)[::-1]  # the lightest at the end
    if sum(m for _, m in leaves) < 2:
        return [(0, m) for _, m in leaves]
    merged: deque[tuple[int, int, int]] = deque()  # (weight, how many, node), in order of weight and age
    parts: list[list[tuple[int, int]]] = []  # node -> (child node or -1 for a leaf, how many of it each such node has)

    def lightest() -> tuple[int, int, int]:
        if leaves and (not merged or leaves[-1][0] <= merged[0][0]):
            return (*leaves.pop(), -1)
        return merged.popleft()

    def join(weight: int, many: int, children: list[tuple[int, int]]) -> None:
        parts.append(children)
        merged.append((weight, many, len(parts) - 1))

    while leaves or len(merged) > 1 or merged[0][1] > 1:
        w, m, node = lightest()
        if m > 1:
            if m % 2:  # the odd one waits for the next lightest
                leaves.append((w, 1)) if node < 0 else merged.appendleft((w, 1, node))
            # all pairs weigh the same; they are younger than anything that waits, and no lighter
            join(2 * w, m // 2, [(node, 2)])
        else:
            v, k, other = lightest()
            if k > 1:
                leaves.append((v, k - 1)) if other < 0 else merged.appendleft((v, k - 1, other))
            join(w + v, 1, [(node, 1), (other, 1)])
        if len(merged) > 1 and merged[-1][0] < merged[-2][0]:  # keep the order of weights
            late = merged.pop()
            at = next(i for i, x in enumerate(merged) if x[0] > late[0])
            merged.insert(at, late)
    out: dict[int, int] = {}
    level = {merged[0][2]: 1}
    depth = 0
    while level:
        below: dict[int, int] = {}
        for node, many in level.items():
            for child, each in parts[node]:
                if child < 0:
                    out[depth + 1] = out.get(depth + 1, 0) + many * each
                else:
                    below[child] = below.get(child, 0) + many * each
        level, depth = below, depth + 1
    return sorted(out.items())


def canonical_codes(lengths: list[int]) -> list[int]:
    """Right-aligned canonical codes for ascending lengths."""
    out, code, last = [], 0, lengths[0] if lengths else 0
    for k, n in enumerate(lengths):
        if k:
            code = (code + 1) << (n - last)
        out.append(code)
        last = n
    return out


def level_codes(lengths: list[int]) -> list[int]:
    """Prefix codes for ascending lengths such that, at every level, ended codes sort last among their
    peers in bit-reversed order - so the active part of each level is a prefix.

    Level by level the free codes are kept in bit-reversed order; codes that end at a level take the last
    of them, and each of the others continues with a 0 and, in the second half, with a 1.
    """
    if not lengths:
        return []
    out: list[int] = [0] * len(lengths)
    free, at = [0], 0
    if lengths[-1] == 0:
        return out
    for n in range(1, lengths[-1] + 1):
        free = [c << 1 for c in free] + [(c << 1) | 1 for c in free]
        ended = 0
        while at + ended < len(lengths) and lengths[at + ended] == n:
            ended += 1
        if ended:
            out[at : at + ended] = free[-ended:]
            del free[-ended:]
        at += ended
    return out


# The codec: the number of values, then a binary tree of partial sums (heap order). The root is written
# as an Elias gamma code (length in unary, then the lower bits); below it, each node tells how it splits
# between its children, ranked from the most even split, in a minimal binary code whose short words come
# first. A parent is the sum of its children less 1. This bit layout is fixed by the format.


class _Writer:
    """Bits in order of writing, lowest bit of each byte first; full bytes leave the accumulator."""

    def __init__(self):
        self.done, self.value, self.size = bytearray(), 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= (value & ((1 << n) - 1)) << self.size
        self.size += n
        if self.size >= 64:
            self.done += (self.value & (1 << 64) - 1).to_bytes(8, "little")
            self.value >>= 64
            self.size -= 64

    def bytes(self) -> bytes:
        while self.size >= 64:
            self.write(0, 0)
        return bytes(self.done) + self.value.to_bytes((self.size + 7) // 8, "little")


class _Reader:
    """Reads what a _Writer wrote; touches only the bytes it is asked for."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        out = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


def _write_gamma(bits: _Writer, x: int) -> None:
    k = x.bit_length() - 1
    bits.write((1 << k) - 1, k + 1)
    bits.write(x, k)


def _read_gamma(bits: _Reader) -> int:
    k = 0
    while bits.read(1):
        k += 1
    return bits.read(k) | (1 << k)


def _write_bounded(bits: _Writer, x: int, r: int) -> None:
    """x in 1..r; the values that can be told apart with one bit less take one bit less."""
    k = (r).bit_length() - 1
    short = (1 << (k + 1)) - r
    v = x - 1
    if v < short:
        bits.write(v, k)
    else:
        v += short
        bits.write(v >> 1, k)
        bits.write(v & 1, 1)


def _read_bounded(bits: _Reader, r: int) -> int:
    k = (r).bit_length() - 1
    short = (1 << (k + 1)) - r
    v = bits.read(k)
    if v >= short:
        v = (v << 1 | bits.read(1)) - short
    return v + 1


def mapped(left: int, right: int) -> int:
    """The rank of a split by how even it is: the most even one is 1."""
    d = right - left
    return d + 1 if d >= 0 else -d


def unmapped(rank: int, parent: int) -> int:
    """The left part of the split of a parent (left + right - 1) that has this rank."""
    d = rank - 1 if (rank + parent) % 2 == 0 else -rank
    return (parent + 1 - d) // 2


def sequence_encode(values: list[int]) -> bytes:
    """Bytes of a list of positive integers; an empty list has none, a zero or less is an error."""
    n = len(values)
    if not n:
        return b""
    for k, v in enumerate(values):
        if v <= 0:
            raise ValueError(f"values[{k}] is {'zero' if v == 0 else 'negative'}")
    tree = [0] * (n - 1) + list(values)
    for p in range(n - 2, -1, -1):
        tree[p] = tree[2 * p + 1] + tree[2 * p + 2] - 1
    bits = _Writer()
    _write_gamma(bits, n)
    _write_gamma(bits, tree[0])
    for p in range(n - 1):
        _write_bounded(bits, mapped(tree[2 * p + 1], tree[2 * p + 2]), tree[p])
    return bits.bytes()


def sequence_decode(data: bytes) -> list[int]:
    """The list that sequence_encode wrote."""
    if not data:
        return []
    bits = _Reader(data)
    n = _read_gamma(bits)
    tree = [0] * (2 * n - 1)
    tree[0] = _read_gamma(bits)
    for p in range(n - 1):
        tree[2 * p + 1] = unmapped(_read_bounded(bits, tree[p]), tree[p])
        tree[2 * p + 2] = tree[p] + 1 - tree[2 * p + 1]
    return tree[n - 1 :]


def encode_column(values: Column) -> Column:
    """The bytes of an array column (null: null)."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda v: sequence_encode([int(x) for x in v]), na_action="ignore")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, BinaryType())(values)


def decode_column(data: Column) -> Column:
    """The array that encode_column wrote."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: sequence_decode(bytes(b)), na_action="ignore")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, ArrayType(LongType()))(data)
