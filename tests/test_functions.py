"""Codes, Morton codes, bit arithmetic and histogram bins."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankweave.functions import bitmath, h2, ranges, zorder
from rankweave.functions.codes import canonical_codes, code_lengths, decode_column, encode_column, grouped_code_lengths, level_codes, mapped, sequence_decode, sequence_encode, unmapped


def test_huffman_codes():
    assert code_lengths([8, 4, 2, 1]) == [1, 2, 3, 3]
    assert canonical_codes([1, 2, 3, 3]) == [0, 2, 6, 7]
    assert level_codes([1, 2, 3, 3]) == [1, 1, 0, 1]
    weights = [20, 17, 6, 3, 2, 2, 2, 1, 1, 1]
    assert code_lengths(weights) == [1, 2, 4, 5, 5, 5, 5, 5, 6, 6]
    assert level_codes(code_lengths(weights)) == [1, 1, 3, 4, 2, 1, 5, 3, 0, 1]
    assert level_codes([2, 2, 2, 3]) == [0b10, 0b01, 0b11, 0b001]
    assert code_lengths([]) == [] and code_lengths([42]) == [0]


def test_huffman_lengths_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        weights = sorted((rng.randrange(1, 50) for _ in range(rng.randrange(2, 12))), reverse=True)
        heap, cost = sorted(weights), 0
        while len(heap) > 1:
            a, b = heap[0], heap[1]
            heap = sorted([*heap[2:], a + b])
            cost += a + b
        lengths = code_lengths(weights)
        assert sum(w * n for w, n in zip(weights, lengths, strict=True)) == cost
        for codes in (canonical_codes(lengths), level_codes(lengths)):
            words = [format(c, f"0{n}b") for c, n in zip(codes, lengths, strict=True)]
            assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(words, 2))


def test_lengths_of_grouped_weights():
    rng = random.Random(3)
    for _ in range(500):
        weights = sorted((rng.choice([1, 1, 2, 3, 5, 8, rng.randrange(1, 100)]) for _ in range(rng.randrange(40))), reverse=True)
        assert dict(grouped_code_lengths(list(Counter(weights).items()))) == Counter(code_lengths(weights))
    assert grouped_code_lengths([(1, 1 << 40)]) == [(40, 1 << 40)]


def test_split_ranks_go_back():
    for x, y in itertools.product(range(1, 30), repeat=2):
        assert unmapped(mapped(x, y), x + y - 1) == x


def test_long_lists_and_large_values():
    rng = random.Random(6)
    for n in (1, 2, 63, 64, 65, 3000):
        values = [rng.randrange(1, 10 ** rng.randrange(1, 10)) for _ in range(n)]
        assert sequence_decode(sequence_encode(values)) == values


def test_sequence_codec():
    for values in ([], [1], [2], [100], [1000000], [1] * 8, [1, 2, 3, 4], [4, 3, 2, 1], [5, 10, 15, 20]):
        assert sequence_decode(sequence_encode(values)) == values
    for n in range(1, 5):
        for values in itertools.product(range(1, 5), repeat=n):
            assert sequence_decode(sequence_encode(list(values))) == list(values)
    with pytest.raises(ValueError, match=r"values\[2\] is zero"):
        sequence_encode([1, 2, 0, 3])


def test_sequence_codec_columns(spark):
    rng = random.Random(4)
    lists = [[rng.randrange(1, 1000) for _ in range(rng.randrange(64))] for _ in range(40)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*lists, None])], "id long, v array<long>")
    rows = {r.id: r.b for r in df.select("id", decode_column(encode_column(F.col("v"))).alias("b")).collect()}
    assert [rows[k] for k in range(40)] == lists and rows[40] is None


def test_morton_round_trips(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    code = zorder.encode2(F.col("x"), F.col("y"))
    x, y = zorder.decode2(code)
    assert df.where((x != F.col("x")) | (y != F.col("y"))).count() == 0
    df = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    x, y, z = zorder.decode3(zorder.encode3(F.col("x"), F.col("y"), F.col("z")))
    assert df.where((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z"))).count() == 0
    big = spark.createDataFrame([(65535, 65535)], "x long, y long").select(zorder.encode2(F.col("x"), F.col("y")).alias("c")).first()
    assert big.c == 2**32 - 1
    assert zorder.dim_mask(0, 4) == 0x11111111


def test_box_splits(spark):
    one = zorder.split_boxes(spark.createDataFrame([(0, 3, 48)], "box long, low long, high long")).orderBy("lo")
    assert [(r.lo, r.hi) for r in one.collect()] == [(3, 3), (6, 7), (9, 9), (11, 15), (18, 18), (24, 24), (26, 26), (33, 33), (36, 37), (48, 48)]
    whole = zorder.split_boxes(spark.createDataFrame([(0, 0, 2**32 - 1)], "box long, low long, high long")).collect()
    assert [(r.lo, r.hi) for r in whole] == [(0, 2**32 - 1)]
    df = spark.createDataFrame([(123, 456), (7, 7)], "a long, b long")
    lo, hi = zorder.split_at(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(221, 298), (7, 7)]
    pairs = spark.createDataFrame([(3, 4), (2, 3), (0, 2**32 - 1)], "a long, b long")
    assert [r[0] for r in pairs.select(zorder.range_is_box(F.col("a"), F.col("b"))).collect()] == [None, True, True]
    boxes = spark.createDataFrame([(0, 3, 48), (1, 3, 4)], "box long, low long, high long")
    assert zorder.split_boxes(boxes).count() == 10
    with pytest.raises(Exception, match="out of order"):
        zorder.split_boxes(boxes, strict=True).collect()


def test_box_splits_by_definition(spark):
    rng = random.Random(8)
    code = lambda x, y: sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(16))
    rows, want = [], {}
    for k in range(40):
        x0, y0 = rng.randrange(60), rng.randrange(60)
        x1, y1 = x0 + rng.randrange(20), y0 + rng.randrange(20)
        rows.append((k, code(x0, y0), code(x1, y1)))
        inside = sorted(code(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
        want[k] = [(a[0], a[-1]) for a in ([c for _, c in g] for _, g in itertools.groupby(enumerate(inside), lambda p: p[1] - p[0]))]
    got = zorder.split_boxes(spark.createDataFrame(rows, "box long, low long, high long")).collect()
    assert {k: sorted((r.lo, r.hi) for r in got if r.box == k) for k in want} == want


def test_next_codes_of_boxes(spark):
    def code(x, y):
        return sum(((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1) for i in range(4))

    rng = random.Random(9)
    rows, want = [], []
    for _ in range(300):
        x0, y0 = rng.randrange(8), rng.randrange(8)
        x1, y1 = rng.randrange(x0, 8), rng.randrange(y0, 8)
        inside = sorted(code(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
        div = rng.randrange(64)
        rows.append((len(rows), code(x0, y0), code(x1, y1), div))
        want.append((max((c for c in inside if c < div), default=None), min((c for c in inside if c > div), default=None)))
    df = spark.createDataFrame(rows, "id long, lo long, hi long, div long")
    got = df.select("id", zorder.litmax(F.col("lo"), F.col("hi"), F.col("div")).alias("a"), zorder.bigmin(F.col("lo"), F.col("hi"), F.col("div")).alias("b")).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == want


def test_bits(spark):
    df = spark.createDataFrame([(0b0111000110010,)], "w long")
    row = df.select(*[bitmath.select_in_word(F.col("w"), F.lit(k)).alias(f"k{k}") for k in range(7)]).first()
    assert list(row) == [1, 4, 5, 9, 10, 11, None]
    top = spark.createDataFrame([(-(2**63),)], "w long").select(bitmath.select_in_word(F.col("w"), F.lit(0)), bitmath.popcount(F.col("w"))).first()
    assert list(top) == [63, 1]
    assert spark.range(1).select(bitmath.bit_floor(F.lit(0).cast("long")), bitmath.trailing_zeros(F.lit(0).cast("long"))).first()[0] == 0


def test_reversed_bits_and_code_lengths(spark):
    values = [0, 1, 2, 5, 2**20 - 1, 2**31, 2**62 + 5]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for n in (1, 3, 20, 32, 63):
        got = [r[0] for r in df.select(bitmath.reverse_low_bits(F.col("x"), n)).collect()]
        assert got == [int(format(v % (1 << n), f"0{n}b")[::-1], 2) for v in values]
    bits = [r[0] for r in df.where("x > 0").select(bitmath.gamma_bits(F.col("x"))).collect()]
    assert bits == [2 * (v.bit_length() - 1) + 1 for v in values if v]


def test_ranges_by_points(spark):
    rows = [(a, b, c, d) for a in range(4) for b in range(a + 1, 5) for c in range(4) for d in range(c + 1, 5)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    one, two = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    got = df.select(*[f(one, two) for f in (ranges.overlaps, ranges.contains, ranges.extents_overlap, ranges.extent_contains, ranges.extent_overlaps_range, ranges.extent_contains_range)]).collect()
    for (a, b, c, d), r in zip(rows, got, strict=True):
        half, extent, other, wide = set(range(a, b)), set(range(a, b + 1)), set(range(c, d)), set(range(c, d + 1))
        assert tuple(r) == (bool(half & other), other <= half, bool(extent & wide), wide <= extent, bool(extent & other), other <= extent)


def test_histogram_parameters():
    assert h2.from_mr(1, 6) == (1, 4)
    with pytest.raises(ValueError, match="larger"):
        h2.from_mr(3, 3)


@pytest.mark.parametrize(("a", "b"), [(0, 0), (0, 3), (2, 1)])
def test_histogram_bins(spark, a, b):
    rows = spark.range(2000).select(F.col("id").alias("v"), h2.bin_index(F.col("id"), a, b).alias("bin")).collect()
    bins = [r.bin for r in sorted(rows, key=lambda r: r.v)]
    assert bins[0] == 0 and all(y - x in (0, 1) for x, y in zip(bins, bins[1:], strict=False))
    edges = spark.range(bins[-1]).select("id", h2.lowest(F.col("id"), a, b).alias("lo"), h2.highest(F.col("id"), a, b).alias("hi")).collect()
    for r in edges:
        assert bins.index(r.id) == r.lo and bins[r.hi] == r.id and bins[r.hi + 1] == r.id + 1
    assert h2.num_bins(a, b, 10) == bins[1023] + 1
