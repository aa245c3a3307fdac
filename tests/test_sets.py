"""Bit sets and multisets: literal results, boundary sweep, invariants against naive definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators.bits import BitSet, MultiSet
from rankweave.operators.dense import DenseSet
from rankweave.operators.sizes import byte_sizes, multi_byte_size, padded_byte_size
from rankweave.plans import ranking
from rankweave.sources.packed import from_words, pack_integers, to_words, unpack_integers


def ones_of(spark, positions):
    return spark.createDataFrame([(int(p),) for p in positions], "pos long")


def at_of(spark, values):
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "qid long, at long")


def k_of(spark, values):
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "qid long, k long")


def by_qid(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r.qid)]


def test_literal_ranks_and_selects(spark):
    s = BitSet.build(ones_of(spark, [0, 31, 32, 68]), 70)
    asks = at_of(spark, [5, 31, 32, 33, 60, 69, 70, 1000])
    assert by_qid(s.rank1(asks), "rank1") == [1, 1, 2, 3, 3, 4, 4, 4]
    assert by_qid(s.rank0(asks), "rank0") == [4, 30, 30, 30, 57, 65, 66, 66]
    assert by_qid(s.select1(k_of(spark, [0, 1, 2, 3, 4])), "pos") == [0, 31, 32, 68, None]
    assert by_qid(s.select0(k_of(spark, [0, 1, 2, 3, 31, 65, 66])), "pos") == [1, 2, 3, 4, 34, 69, None]
    assert by_qid(s.get(at_of(spark, [0, 1, 68, 70])), "bit") == [1, 0, 1, None]


def test_empty_sets_and_far_positions(spark):
    empty = BitSet(ones_of(spark, []), 0)
    assert by_qid(empty.rank1(at_of(spark, [0, 9])), "rank1") == [0, 0]
    assert by_qid(empty.select1(k_of(spark, [0])), "pos") == [None]
    assert by_qid(empty.select0(k_of(spark, [0])), "pos") == [None]
    zeros = BitSet(ones_of(spark, []), 100)
    assert by_qid(zeros.rank0(at_of(spark, [1, 2**32])), "rank0") == [1, 100]
    far = BitSet.build(ones_of(spark, [2**32 - 2]), 2**32 - 1)
    assert by_qid(far.rank1(at_of(spark, [2**32 - 2, 2**32 - 1])), "rank1") == [0, 1]


def test_building_twice_and_out_of_bounds(spark):
    s = BitSet.build(ones_of(spark, [5, 5]), 10)
    assert s.stats().first().asDict() == {"universe": 10, "num_ones": 1, "num_zeros": 9}
    with pytest.raises(Exception, match="outside the universe"):
        BitSet.build(ones_of(spark, [10]), 10).ones.collect()
    assert BitSet.build(ones_of(spark, [10, 3]), 10, strict=False).ones.count() == 1


PATTERNS = {"none": lambda n: [], "first": lambda n: [0], "last": lambda n: [n - 1], "all": range, "second": lambda n: range(0, n, 2), "seventh": lambda n: range(0, n, 7)}


@pytest.mark.parametrize(("size", "pattern"), [(1, "all"), (33, "second"), (64, "last"), (129, "none"), (1025, "seventh")])
def test_every_form_agrees_at_boundaries(spark, size, pattern):
    ones = sorted(PATTERNS[pattern](size))
    s = BitSet(ones_of(spark, ones).cache(), size)
    at = sorted({0, 1, size // 2, size - 1, size, size + 3})
    ks = sorted({0, len(ones) // 2, max(len(ones) - 1, 0), len(ones), size})
    want = [sum(p < i for p in ones) for i in at]
    zeros = [p for p in range(size) if p not in set(ones)]
    pick = lambda rows, k: rows[k] if k < len(rows) else None
    asks, k_asks = at_of(spark, at), k_of(spark, ks)
    assert by_qid(s.rank1(asks), "rank1") == want
    assert by_qid(s.runs_rank1(asks), "rank1") == want
    assert by_qid(s.select1(k_asks), "pos") == [pick(ones, k) for k in ks]
    assert by_qid(s.runs_select(k_asks), "pos") == [pick(ones, k) for k in ks]
    assert by_qid(s.select0(k_asks), "pos") == [pick(zeros, k) for k in ks]
    assert by_qid(s.runs_select(k_asks, ones=False), "pos") == [pick(zeros, k) for k in ks]
    dense = DenseSet.build(s, 6)
    assert by_qid(dense.rank1(asks), "rank1") == want
    assert by_qid(dense.select1(k_asks), "pos") == [pick(ones, k) for k in ks]
    assert by_qid(s.elias_fano_select1(k_asks), "pos") == [pick(ones, k) for k in ks]
    assert by_qid(s.elias_fano_rank1(asks), "rank1") == want
    assert s.all_ones_from().first().all_ones_from == max(zeros, default=-1) + 1
    assert by_qid(BitSet.from_runs(runs_of(spark, ones, size)).rank1(asks), "rank1") == want


def runs_of(spark, ones, size):
    """Zeros and ones in turn, in pieces, with empty pieces between."""
    bits = [int(p in set(ones)) for p in range(size)]
    return spark.createDataFrame([(2 * p + e, 1 - b if not e else 0, b if not e else 0) for p, b in enumerate(bits) for e in (0, 1)], "part long, zeros long, ones long")


@pytest.mark.parametrize("small", [10_000, 0])
def test_blocks_of_blocks(spark, monkeypatch, small):
    """Tiny blocks, so that running sums take several levels; query tables as small or as large ones."""
    monkeypatch.setattr(ranking, "MAX_BLOCKS", 4)
    monkeypatch.setattr(ranking, "LEAST_BITS", 1)
    monkeypatch.setattr(ranking, "MOST_BITS", 2)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", small)
    rng = random.Random(1)
    ones = sorted(rng.sample(range(300), 90))
    s = BitSet(ones_of(spark, ones), 300)
    zeros = sorted(set(range(300)) - set(ones))
    at, ks = list(range(0, 305, 7)), list(range(0, 215, 9))
    pick = lambda rows, k: rows[k] if k < len(rows) else None
    assert by_qid(s.rank1(at_of(spark, at)), "rank1") == [sum(p < i for p in ones) for i in at]
    assert by_qid(s.select1(k_of(spark, ks)), "pos") == [pick(ones, k) for k in ks]
    assert by_qid(s.select0(k_of(spark, ks)), "pos") == [pick(zeros, k) for k in ks]
    counts = {p: rng.randrange(1, 9) for p in ones}
    copies = [p for p in ones for _ in range(counts[p])]
    m = MultiSet(spark.createDataFrame(list(counts.items()), "pos long, cnt long"), 300)
    assert by_qid(m.select1(k_of(spark, ks)), "pos") == [pick(copies, k) for k in ks]
    assert by_qid(m.rank1(at_of(spark, at)), "rank1") == [sum(p < i for p in copies) for i in at]


def test_ranks_shuffle_only_rows_of_asked_blocks(spark, tmp_path):
    """Two questions on a large table: the rows that meet them are filtered at the scan by a broadcast of two blocks."""
    spark.range(200_000).select(F.col("id").alias("pos")).write.parquet(str(tmp_path / "ones"))
    s = BitSet(spark.read.parquet(str(tmp_path / "ones")), 1_000_000)
    plan = s.rank1(at_of(spark, [5, 150_000]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert by_qid(s.rank1(at_of(spark, [5, 150_000])), "rank1") == [5, 150_000]


def naive_trim(bits, threshold):
    blocks = [bits[k : k + 32] for k in range(0, len(bits), 32)]
    best = None
    for value in (0, 1):
        pads = [all(b == value for b in block) for block in blocks]
        left = next((k for k, p in enumerate(pads) if not p), len(blocks))
        right = next((k + 1 for k in range(len(blocks) - 1, 0, -1) if not pads[k]), min(1, len(blocks)))
        if best is None or max(right - left, 0) < max(best[2] - best[1], 0):
            best = (value, left, right)
    return (*best, len(blocks)) if max(best[2] - best[1], 0) <= threshold * len(blocks) else (None, 0, len(blocks), len(blocks))


@pytest.mark.parametrize("bits", [[0] * 100, [1] * 100, [0] * 70 + [1] + [0] * 60, [1] * 70 + [0] + [1] * 60, [0, 1] * 40, [1] * 64 + [0] * 64, [0] * 31 + [1], []])
def test_trimmed_blocks(spark, bits):
    s = BitSet(ones_of(spark, [p for p, b in enumerate(bits) if b]), len(bits))
    for threshold in (1.0, 0.5, 0.0):
        assert tuple(s.trimmed(threshold).first()) == naive_trim(bits, threshold)


def test_sizes_by_layout(spark):
    s = BitSet(ones_of(spark, [0, 31, 32, 68]), 2000)
    # offset 0, width ilog2(2000 / 4) = 8: 4 low parts of 8 bits, and 4 + (2000 >> 8) + 1 high bits; 3 runs
    assert byte_sizes(s, 5).first().asDict() == {"bit_buffer": 256, "dense": 264, "array": 16, "sparse": 8 + 8, "run_length": 24, "int_buffer": 8 * 157}
    assert byte_sizes(BitSet(ones_of(spark, []), 64)).first().array == 0
    assert multi_byte_size(MultiSet(spark.createDataFrame([(3, 2), (9, 1)], "pos long, cnt long"), 65)).first().asDict() == {"occupied": 16, "sums": 8}
    assert padded_byte_size(BitSet(ones_of(spark, [70]), 1000)).first().padded == 4


def test_low_bits_of_choice(spark):
    s = BitSet(ones_of(spark, [3, 40, 41, 900]), 1000)
    for low_bits in (0, 3, 20):
        for r in s.elias_fano(low_bits).collect():
            assert r.low_bits == low_bits and r.offset + (r.high << low_bits) + r.low in (3, 40, 41, 900) and r.high_pos == r.idx + r.high


def test_sets_in_sets_of_counts(spark):
    once = MultiSet.build(spark.createDataFrame([(3, 1), (5, 1)], "pos long, cnt long"), 9)
    assert sorted(r.pos for r in once.as_set().ones.collect()) == [3, 5]


def test_stored_dense_set(spark, tmp_path):
    s = DenseSet.build(BitSet(ones_of(spark, range(0, 5000, 3)), 5000)).written(str(tmp_path / "dense"))
    assert by_qid(s.rank1(at_of(spark, [0, 1, 2999, 5000, 9999])), "rank1") == [0, 1, 1000, 1667, 1667]
    with pytest.raises(ValueError, match="pow2"):
        DenseSet.build(BitSet(ones_of(spark, []), 1), 5)


def test_dense_words_and_sparse_layout(spark):
    words = to_words(ones_of(spark, [0, 31, 32, 68]))
    assert sorted(tuple(r) for r in words.collect()) == [(0, 6442450945), (1, 16)]
    assert sorted(r.pos for r in from_words(words).collect()) == [0, 31, 32, 68]
    top = to_words(ones_of(spark, [63]))
    assert [r.pos for r in from_words(top).collect()] == [63]
    late = BitSet(ones_of(spark, range(999990, 1000000)), 1_000_000)
    assert {r.offset for r in late.elias_fano().collect()} == {999990}
    assert by_qid(late.select1(k_of(spark, [0, 9, 10])), "pos") == [999990, 999999, None]


def test_padding(spark):
    core = BitSet(ones_of(spark, [0, 5, 9]), 10)
    padded = core.padded(10, 5)
    assert padded.universe == 25
    assert by_qid(padded.rank1(at_of(spark, [10, 11, 16, 25])), "rank1") == [0, 1, 2, 3]
    inner = BitSet(ones_of(spark, [0, 45, 89]), 90)
    assert by_qid(inner.rank1_with_tail(at_of(spark, [1, 90, 95, 100, 500]), 100), "rank1") == [1, 3, 8, 13, 13]
    assert by_qid(inner.select1_with_tail(k_of(spark, [0, 2, 3, 12, 13]), 100), "pos") == [0, 89, 90, 99, None]


def test_multiset_against_naive(spark):
    rng = random.Random(5)
    counts = {p: rng.randrange(1, 100) for p in rng.sample(range(500), 60)}
    m = MultiSet.build(spark.createDataFrame([(p, 1) for p, c in counts.items() for _ in range(c)], "pos long, cnt long"), 500)
    copies = [p for p in sorted(counts) for _ in range(counts[p])]
    at, ks = [0, 1, 100, 250, 499, 500, 900], [0, 1, 7, len(copies) // 2, len(copies) - 1, len(copies)]
    assert by_qid(m.rank1(at_of(spark, at)), "rank1") == [sum(p < i for p in copies) for i in at]
    assert by_qid(m.select1(k_of(spark, ks)), "pos") == [copies[k] if k < len(copies) else None for k in ks]
    assert m.stats().first().asDict() == {"universe": 500, "num_ones": len(copies), "num_unique_ones": len(counts), "num_zeros": 500 - len(counts)}
    with pytest.raises(Exception, match="more than once"):
        m.as_set().ones.collect()


@pytest.mark.parametrize(("width", "data"), [(0, [0, 0, 0, 0]), (1, [1, 0, 1, 0]), (5, [1, 0, 1, 0]), (32, [10, 0, 31, 4294967295]), (56, [2**56 - 1, 0, 5] * 50), (13, list(range(200))), (20, [2**20 - 1] * 130)])
def test_packed_integers(spark, width, data):
    rows = spark.createDataFrame(list(enumerate(data)), "pos long, value long")
    assert [r.value for r in unpack_integers(pack_integers(rows, width), width).orderBy("pos").collect()] == data


def test_packed_integers_take_their_bits(spark):
    rows = spark.createDataFrame([(0, 5), (70, 7)], "pos long, value long")
    packed = {r.block: r for r in pack_integers(rows, 3).collect()}
    assert packed[0].words == [5, 0, 0] and packed[1].words == [7 << 18, 0, 0] and (packed[0].n, packed[1].n) == (1, 7)
    assert [r.value for r in unpack_integers(pack_integers(rows, 3), 3).orderBy("pos").collect()] == [5, 0, 0, 0, 0, 0, 0, 7]


def test_packed_integers_that_do_not_fit(spark):
    with pytest.raises(Exception, match="does not fit"):
        pack_integers(spark.createDataFrame([(0, 2)], "pos long, value long"), 1).collect()
