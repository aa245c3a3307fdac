"""Sequence queries: literal results and random sequences against naive definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rankweave import sql
from rankweave.functions.codes import canonical_codes, code_lengths, level_codes
from rankweave.operators.bits import BitSet, MultiSet
from rankweave.operators.contract import SymbolSequence
from rankweave.operators.huffman import HuffmanSequence, code_table
from rankweave.operators.sequence import Sequence, morton_sequence
from rankweave.operators.sizes import coded_byte_size, sequence_byte_size
from rankweave.plans import planes, ranking
from rankweave.plans.boxes import in_boxes
from rankweave.plans.index import SequenceIndex
from rankweave.sources.scratch import scratch_folder
from rankweave.sources.tables import from_array


def asks(spark, rows, names):
    return spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(rows)], "qid long, " + ", ".join(f"{n} long" for n in names))


def column(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r.qid)]


def test_select_with_ignored_bits(spark):
    s = Sequence.of(from_array(spark, [1, 3, 3, 2, 7]))
    names = ("lo", "hi", "symbol", "k", "ignore_bits")
    plain = [(0, 5, y, k, 0) for y, k in ((0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (7, 0), (5, 0))]
    two = [(0, 5, y, k, 2) for y, k in ((0, 0), (3, 1), (7, 0), (5, 0), (100, 0))]
    three = [(0, 5, y, k, 3) for y, k in ((3, 1), (7, 0), (100, 0))]
    q = asks(spark, plain + two + three, names)
    assert column(s.select(q), "pos") == [None, 0, 3, 1, 2, 4, None, 0, 1, 4, 4, None, 1, 0, None]
    assert column(s.select(q, last=True), "pos") == [None, 0, 3, 2, 1, 4, None, 3, 2, 4, 4, None, 3, 4, None]


def test_quantile_majority_and_counts_below(spark):
    s = Sequence.of(from_array(spark, [1, 3, 3, 2, 7]))
    q = asks(spark, [(0, 5, 0), (0, 5, 1), (0, 5, 2), (0, 5, 3), (0, 5, 4), (1, 2, 0), (1, 4, 0), (1, 4, 3)], ("lo", "hi", "k"))
    got = {r.qid: (r.symbol, r.cnt) for r in s.quantile(q).collect()}
    assert got == {0: (1, 1), 1: (2, 1), 2: (3, 2), 3: (3, 2), 4: (7, 1), 5: (3, 1), 6: (2, 1)}
    assert column(s.simple_majority(asks(spark, [(0, 5), (0, 3), (0, 1), (1, 4), (1, 5), (2, 2)], ("lo", "hi"))), "symbol") == [None, 3, 1, 3, None, None]
    assert column(s.preceding_count(asks(spark, [(0, 5, y) for y in (0, 1, 2, 3, 4, 5, 7)], ("lo", "hi", "symbol"))), "cnt") == [0, 0, 1, 2, 4, 4, 4]
    buckets = spark.createDataFrame([(0, 0, 2), (1, 3, 3), (2, 4, 10)], "bucket long, s_lo long, s_hi long")
    assert [r.cnt for r in s.count_batch(asks(spark, [(0, 5)], ("lo", "hi")), buckets).orderBy("bucket").collect()] == [2, 2, 1]


COUNTS = [
    ((0, 8, 0), [(0, 0, 2), (4, 2, 3), (2, 3, 4), (1, 4, 8)]), ((1, 7, 0), [(0, 1, 2), (4, 2, 3), (2, 3, 4), (1, 4, 7)]),
    ((0, 8, 2), [(0, 0, 7), (4, 7, 8)]), ((0, 8, 1), [(0, 0, 6), (4, 6, 7), (2, 7, 8)]), ((1, 7, 1), [(0, 1, 5), (4, 6, 7), (2, 7, 8)]),
]


def test_counts_on_the_lowest_level(spark):
    s = Sequence.of(from_array(spark, [0, 1, 2, 1, 0, 1, 4, 1]))
    q = asks(spark, [(lo, hi, b, 0, 7) for (lo, hi, b), _ in COUNTS], ("lo", "hi", "ignore_bits", "s_lo", "s_hi"))
    rows = s.counts(q).collect()
    for k, (_, want) in enumerate(COUNTS):
        assert sorted((r.symbol, r.start, r.end) for r in rows if r.qid == k) == sorted(want)
    first = asks(spark, [(2, 8, 1), (5, 8, 0)], ("lo", "hi", "symbol"))
    assert column(s.first_at_most(first), "pos") == [3, None]


def test_level_planes(spark):
    s = Sequence.of(from_array(spark, [1, 3, 3, 2, 7]))
    planes = ["", "", ""]
    for r in sorted(s.level_bits().collect(), key=lambda r: (r.level, r.idx)):
        planes[r.level] += str(r.bit)
    assert planes == ["00001", "01111", "11101"]


def reverse(x, n):
    return int(bin(x)[2:].zfill(n)[::-1], 2)


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_random_sequences(spark, broadcast, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", broadcast)
    rng = random.Random(11)
    data = [rng.randrange(9) for _ in range(57)]
    s, n = Sequence.of(from_array(spark, data)), len(data)
    rows = []
    for _ in range(25):
        lo = rng.randrange(n)
        rows.append((lo, rng.randrange(lo, n + 1), rng.randrange(9), rng.randrange(4), rng.randrange(3)))
    q = asks(spark, rows, ("lo", "hi", "symbol", "k", "ignore_bits"))
    part = [data[lo:hi] for lo, hi, *_ in rows]
    assert column(s.count(q), "cnt") == [p.count(r[2]) for p, r in zip(part, rows, strict=True)]
    assert column(s.preceding_count(q), "cnt") == [sum(x < r[2] for x in p) for p, r in zip(part, rows, strict=True)]
    hits = [[i for i in range(lo, hi) if data[i] >> b == y >> b] for lo, hi, y, _, b in rows]
    assert column(s.select(q), "pos") == [h[r[3]] if r[3] < len(h) else None for h, r in zip(hits, rows, strict=True)]
    assert column(s.select(q, last=True), "pos") == [h[-1 - r[3]] if r[3] < len(h) else None for h, r in zip(hits, rows, strict=True)]
    quant = {r.qid: (r.symbol, r.cnt) for r in s.quantile(q).collect()}
    assert quant == {k: (sorted(p)[r[3]], p.count(sorted(p)[r[3]])) for k, (p, r) in enumerate(zip(part, rows, strict=True)) if r[3] < len(p)}
    order = {b: sorted(range(n), key=lambda i, b=b: (reverse(data[i] >> b << b, s.levels), i)) for b in range(3)}
    place = {b: {i: k for k, i in enumerate(o)} for b, o in order.items()}
    located = {r.qid: r for r in s.locate(q).collect()}
    for k, (lo, hi, y, _, b) in enumerate(rows):
        inside = [place[b][i] for i in hits[k]]
        assert located[k].preceding_count == sum(data[i] >> b < y >> b for i in range(lo, hi))
        assert located[k].end - located[k].start == len(inside)
        if inside:
            assert located[k].start == min(inside)
    up = asks(spark, [(i, b) for i in (0, 7, 56, 57) for b in range(3)], ("at", "ignore_bits"))
    assert column(s.select_upwards(up), "pos") == [order[b][i] if i < n else None for i in (0, 7, 56, 57) for b in range(3)]


def test_index_descent(spark, tmp_path):
    rng = random.Random(12)
    for n, top in ((70, 9), (64, 0), (33, 31)):
        data = [rng.randrange(top + 1) for _ in range(n)]
        s = Sequence.of(from_array(spark, data))
        index = SequenceIndex.build(s, str(tmp_path / f"i{n}"))
        rows = [(a, b, rng.randrange(b - a + 1), rng.randrange(top + 3)) for a, b in ((min(p), max(p)) for p in ((rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(15)))]
        q = asks(spark, rows, ("lo", "hi", "k", "symbol"))
        want = {i: (sorted(data[a:b])[k], data[a:b].count(sorted(data[a:b])[k])) for i, (a, b, k, _) in enumerate(rows) if k < b - a}
        assert {r.qid: (r.symbol, r.cnt) for r in index.quantile(q).collect()} == want
        got = {r.qid: (r.preceding, r.cnt) for r in index.count(q).collect()}
        assert got == {i: (sum(x < y for x in data[a:b]), data[a:b].count(y)) for i, (a, b, _, y) in enumerate(rows)}


def shuffled_rows(spark, run):
    """Rows that all shuffles of a job write."""
    sc, jvm = spark.sparkContext, spark._jvm

    def stages():
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    known = stages()
    run()
    return sum(n for k, n in stages().items() if k not in known)


def test_planes_in_chunks_and_passes(spark, monkeypatch):
    """Chunks of 16 places and passes of three levels, one symbol in most rows, codes that end early."""
    monkeypatch.setattr(planes, "CHUNK_BITS", 4)
    monkeypatch.setattr(planes, "DIGIT_BITS", 3)
    rng = random.Random(8)
    data = [rng.choice([5, 5, 5, rng.randrange(200)]) for _ in range(333)]
    s = Sequence.of(from_array(spark, data))
    want = naive_planes(data, 8)
    bits = {(r.level, r.idx): r.bit for r in s.level_bits().collect()}
    assert bits == {(k, i): b for k, plane in enumerate(want) for i, b in enumerate(plane)}
    words = {(r.level, r.block): (r.word, r.rank1) for r in s.level_words().collect()}
    assert words == {(k, b): (sum(x << i for i, x in enumerate(plane[32 * b : 32 * b + 32])), sum(plane[: 32 * b])) for k, plane in enumerate(want) for b in range(11)}
    h = HuffmanSequence.build(s.seq, scratch_folder(spark, "chunked"))
    assert column(h.get(asks(spark, [(i,) for i in range(333)], ("at",))), "sym") == data


def test_planes_shuffle_a_symbol_once_a_pass(spark):
    rows = spark.range(20_000).selectExpr("id AS pos", "pmod(xxhash64(id), 1000) AS sym")
    s = Sequence.of(rows)
    # 10 levels: a row per symbol, its digits, the words and their parts; not a row per symbol and level
    assert shuffled_rows(spark, lambda: s.level_words().write.format("noop").mode("overwrite").save()) < 4 * 20_000


def test_tasks_of_planes_follow_the_length(spark, monkeypatch, tmp_path):
    """One partition in the session, and more in the plan: a task deals a few chunks and merges a few words only."""
    monkeypatch.setattr(planes, "CHUNK_BITS", 4)
    monkeypatch.setattr(planes, "WORD_BITS", 3, raising=False)
    monkeypatch.setattr(planes, "scratch_folder", lambda *_: str(tmp_path))
    data = [k * k % 200 for k in range(640)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        bits = Sequence.of(from_array(spark, data)).level_bits()
        assert len(list(tmp_path.glob("0/*.parquet"))) > 10  # files of tasks that have some of the 40 chunks
        merged = bits.select("level", "idx", "bit", F.spark_partition_id().alias("task")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert merged.groupby("task").size().max() < len(merged) / 4
    planned = {(r.level, r.idx): r.bit for r in merged.itertuples()}
    assert planned == {(k, i): b for k, plane in enumerate(naive_planes(data, 8)) for i, b in enumerate(plane)}


def test_tasks_of_an_index_follow_the_length(spark, monkeypatch, tmp_path):
    """One partition in the session, and more in the plan: a task ranks and writes a few words only."""
    monkeypatch.setattr(planes, "WORD_BITS", 3, raising=False)
    monkeypatch.setattr(ranking, "MAX_BLOCKS", 4)
    data = [k * k % 200 for k in range(640)]
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # tables this small would be broadcast
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        s = Sequence.of(from_array(spark, data))
        ranked = s.level_words().withColumn("task", F.spark_partition_id()).toPandas()
        index = SequenceIndex.build(s, str(tmp_path / "dealt"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(ranked) == 160 and ranked.groupby("task").size().max() < 160 / 4
    assert len(list(tmp_path.glob("dealt/level=*/*.parquet"))) > 12  # one task would write a file per level, 8
    q = asks(spark, [(0, 640, 300), (32, 64, 0), (7, 631, 20)], ("lo", "hi", "k"))
    assert column(index.quantile(q), "symbol") == [sorted(data)[300], min(data[32:64]), sorted(data[7:631])[20]]


def test_few_questions_travel_to_the_words(spark, tmp_path):
    """Words of the index are neither shuffled nor gathered for a few questions, whatever their size."""
    data = [k * k % 11 for k in range(64)]
    index = SequenceIndex.build(Sequence.of(from_array(spark, data)), str(tmp_path / "few"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = asks(spark, [(0, 64, 3, 5), (32, 64, 0, 0), (7, 31, 20, 9), (64, 64, 0, 3)], ("lo", "hi", "k", "symbol"))
        for got in (index.quantile(q), index.count(q)):
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.qid: r.symbol for r in index.quantile(q).collect()} == {0: sorted(data)[3], 1: 0, 2: sorted(data[7:31])[20]}
        assert column(index.count(q), "cnt") == [data.count(5), data[32:].count(0), data[7:31].count(9), 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_index_from_planes_and_back(spark, tmp_path):
    data = [1, 3, 3, 2, 7, 0, 5] * 10
    planes = [BitSet(spark.createDataFrame([(k,) for k, r in enumerate(rows) if r], "pos long"), len(data)) for rows in naive_planes(data, 3)]
    index = SequenceIndex.from_planes(planes, str(tmp_path / "planes"))
    assert column(index.get(asks(spark, [(i,) for i in range(-1, len(data) + 1)], ("at",))), "sym") == [None, *data, None]


def naive_planes(data, levels):
    out, rows = [], list(data)
    for level in range(levels):
        bits = [x >> (levels - 1 - level) & 1 for x in rows]
        out.append(bits)
        rows = [x for x, b in zip(rows, bits, strict=True) if not b] + [x for x, b in zip(rows, bits, strict=True) if b]
    return out


def test_huffman_sequences(spark, tmp_path):
    data = [{0: 1, 1: 2, 2: 1, 3: 1, 4: 100}[i % 5] for i in range(20)]
    h = HuffmanSequence.build(from_array(spark, data), str(tmp_path / "a"))
    assert h.stats().first().asDict() == {"len": 20, "max_symbol": 100, "num_levels": 2, "num_symbols": 3}
    q = asks(spark, [(0, 20, y) for y in (1, 2, 100, 99)], ("lo", "hi", "symbol"))
    assert column(h.count(q), "cnt") == [12, 4, 4, 0]
    assert column(h.get(asks(spark, [(i,) for i in range(20)], ("at",))), "sym") == data
    assert {r.level: r.len for r in h.level_lens().collect()} == {0: 20, 1: 8}
    same = HuffmanSequence.build(from_array(spark, [7] * 10), str(tmp_path / "b"))
    assert same.stats().first().num_levels == 0
    picks = asks(spark, [(0, 10, 7, 0), (0, 10, 7, 9), (0, 10, 7, 10)], ("lo", "hi", "symbol", "k"))
    assert column(same.select(picks), "pos") == [0, 9, None]
    assert column(same.simple_majority(asks(spark, [(0, 10), (3, 3)], ("lo", "hi"))), "symbol") == [7, None]
    none = HuffmanSequence.build(from_array(spark, []), str(tmp_path / "c"))
    assert none.stats().first().len == 0 and column(none.count(q), "cnt") == [0] * 4 and column(none.select(picks), "pos") == [None] * 3


def test_code_table_by_definition(spark):
    rng = random.Random(4)
    for weights in ([8, 4, 2, 1], [20, 17, 6, 3, 2, 2, 2, 1, 1, 1], [rng.randrange(1, 12) for _ in range(40)], [3], [1] * 9):
        data = [y for y, w in enumerate(weights) for _ in range(w)]
        rows = sorted(code_table(from_array(spark, rng.sample(data, len(data)))).collect(), key=lambda r: r.rn)
        order = sorted(range(len(weights)), key=lambda y: (-weights[y], y))
        lengths = code_lengths([weights[y] for y in order])
        longest = max(lengths)
        assert [r.symbol for r in rows] == order and [r.len for r in rows] == lengths
        assert [r.canonical for r in rows] == canonical_codes(lengths) and [r.code for r in rows] == level_codes(lengths)
        assert [r.padded for r in rows] == [(c << longest - n) | (1 << longest - n) - 1 for c, n in zip(level_codes(lengths), lengths, strict=True)]


def test_both_encodings_keep_the_contract(spark, tmp_path):
    """Plain sequence, its index and its prefix-coded form answer alike, and as the definition says."""
    rng = random.Random(21)
    data = [rng.choices([0, 1, 2, 5, 9, 12], [30, 10, 5, 3, 1, 1])[0] for _ in range(120)]
    plain = Sequence.of(from_array(spark, data))
    forms: list[SymbolSequence] = [plain, HuffmanSequence.build(plain.seq, str(tmp_path / "h"))]
    rows = []
    for _ in range(20):
        lo = rng.randrange(120)
        rows.append((lo, rng.randrange(lo, 121), rng.choice([0, 1, 2, 5, 9, 12, 3, 40]), rng.randrange(5), 0))
    q = asks(spark, rows, ("lo", "hi", "symbol", "k", "ignore_bits"))
    part = [data[lo:hi] for lo, hi, *_ in rows]
    hits = [[i for i in range(lo, hi) if data[i] == y] for lo, hi, y, *_ in rows]
    major = [next((y for y in set(p) if 2 * p.count(y) > len(p)), None) for p in part]
    for form in forms:
        assert isinstance(form, SymbolSequence)
        assert column(form.get(asks(spark, [(i,) for i in (0, 50, 119, 120)], ("at",))), "sym") == [data[0], data[50], data[119], None]
        assert column(form.count(q), "cnt") == [len(h) for h in hits]
        assert column(form.select(q), "pos") == [h[r[3]] if r[3] < len(h) else None for h, r in zip(hits, rows, strict=True)]
        assert column(form.select(q, last=True), "pos") == [h[-1 - r[3]] if r[3] < len(h) else None for h, r in zip(hits, rows, strict=True)]
        assert column(form.simple_majority(q), "symbol") == major


def test_points_in_boxes(spark):
    rng = random.Random(2)
    points = [(k, *(rng.randrange(200) for _ in range(3))) for k in range(300)]
    boxes = [(k, *(v for _ in range(3) for v in sorted((rng.randrange(220), rng.randrange(220))))) for k in range(30)]
    boxes += [(30, 0, 0, 0, 0, 0, 0), (31, 5, 4, 0, 9, 0, 9), (32, 0, 65535, 0, 65535, 0, 65535)]
    got = in_boxes(spark.createDataFrame(points, "id long, x long, y long, z long"), spark.createDataFrame(boxes, "box long, x0 long, x1 long, y0 long, y1 long, z0 long, z1 long"), "xyz")
    want = {(i, b) for i, *p in points for b, *c in boxes if all(c[2 * d] <= p[d] <= c[2 * d + 1] for d in range(3))}
    assert [(r.id, r.box) for r in got.orderBy("id", "box").collect()] == sorted(want)


def test_points_beyond_16_bits_lie_in_no_box(spark):
    wide = 1 << 16
    points = [(3, 5), (wide + 3, 5), (3, 5), (3, wide + 5), (65535, 65535), (wide, wide), (3, 5), (1, 0)]
    s = Sequence.of(morton_sequence(spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "pos long, x long, y long")))
    boxes = {0: (0, 0, 65535, 65535), 1: (2, 2, 4, 6), 2: (0, 0, 1, 1)}
    code = lambda x, y: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))
    corners = spark.createDataFrame([(b, code(x0, y0), code(x1, y1)) for b, (x0, y0, x1, y1) in boxes.items()], "box long, low long, high long")
    ranges = [(0, 8), (1, 6), (2, 7), (3, 4)]
    inside = {(q, b): [k for k in range(lo, hi) if x0 <= points[k][0] <= x1 and y0 <= points[k][1] <= y1] for q, (lo, hi) in enumerate(ranges) for b, (x0, y0, x1, y1) in boxes.items()}
    q = asks(spark, ranges, ("lo", "hi"))
    assert {(r.qid, r.box): r.cnt for r in s.box_counts(q, corners, 2).collect()} == {key: len(held) for key, held in inside.items()}
    # cut codes keep their places among equal ones
    order = sorted(range(8), key=lambda k: (reverse(code(*points[k]), 32), k))
    got = s.box_intervals(q.join(corners.where("box = 1").select("low", "high"))).collect()
    want = {(k, code(3, 5)): [order.index(p) for p in inside[k, 1]] for k in range(4) if inside[k, 1]}
    assert {(r.qid, r.symbol): (r.start, r.end) for r in got} == {key: (min(at), max(at) + 1) for key, at in want.items()}


def test_functions_of_the_session(spark):
    data = [1, 3, 3, 2, 7]
    sql.register_sequence(spark, "demo", Sequence.of(from_array(spark, data)))
    row = spark.sql("SELECT demo_get(2), demo_try_get(9), demo_count(0, 5, 3), demo_preceding_count(0, 5, 3), demo_select(0, 5, 3, 1, 0), demo_try_select(0, 5, 3, 2, 0), demo_select_last(0, 5, 3, 0, 2), demo_simple_majority(0, 3), demo_try_simple_majority(0, 5), demo_max_symbol()").first()
    assert list(row) == [3, None, 2, 2, 2, None, 3, 3, None, 7]
    assert [tuple(r) for r in spark.sql("SELECT * FROM demo_quantile(0, 5, 2)").collect()] == [(3, 2)]
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM demo_majority(0, 5, 3)").collect()) == [(3, 2)]
    with pytest.raises(Exception, match="no answer"):
        spark.sql("SELECT demo_select(0, 5, 3, 2, 0)").collect()
    sql.register_set(spark, "bits", BitSet(spark.createDataFrame([(p,) for p in (0, 31, 32, 68)], "pos long"), 70))
    row = spark.sql("SELECT bits_rank1(32), bits_rank0(1000), bits_get(31), bits_select1(3), bits_select0(31), bits_try_select1(4), bits_universe_size(), bits_num_ones(), bits_num_zeros()").first()
    assert list(row) == [2, 66, 1, 68, 34, None, 70, 4, 66]
    with pytest.raises(Exception, match="no such position"):
        spark.sql("SELECT bits_select1(4)").collect()
    sql.register_multiset(spark, "many", MultiSet(spark.createDataFrame([(3, 2), (9, 1), (40, 5)], "pos long, cnt long"), 50))
    row = spark.sql("SELECT many_rank1(10), many_unique_rank1(10), many_unique_rank0(10), many_get(40), many_get(4), many_select1(2), many_try_select1(8), many_num_ones(), many_num_unique_ones(), many_num_zeros(), many_universe_size()").first()
    assert list(row) == [3, 2, 8, 5, 0, 9, None, 8, 3, 47, 50]


def test_sizes_of_planes(spark, tmp_path):
    data = [1] * 40 + [2] * 20 + [3] * 5
    seq = from_array(spark, data)
    assert sequence_byte_size(Sequence.of(seq)) == 2 * 3 * 8  # 65 positions: three words a level
    h = HuffmanSequence.build(seq, str(tmp_path / "h"))  # codes of 1, 2 and 2 bits: planes of 65 and 25
    assert coded_byte_size(h.level_lens(), h.codes).first().asDict() == {"planes": (3 + 1) * 8, "tables": 3 * 16}
