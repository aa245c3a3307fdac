"""Queries on bit sets and multisets: error events, and lines per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators.bits import BitSet, MultiSet
from rankweave.operators.dense import DenseSet
from rankweave.operators.sizes import byte_sizes
from rankweave.queries.base import query, values
from rankweave.sources.packed import from_words, pack_integers, to_words, unpack_integers
from rankweave.sources.tables import error_events, event_users, order_customers, part_lines

B = "b AS (SELECT event_id AS pos FROM events WHERE event_type = 'error'), u AS (SELECT count(*) AS n FROM events)"
M = "m AS (SELECT l_partkey AS pos, count(*) AS cnt FROM lineitem GROUP BY l_partkey), u AS (SELECT count(*) AS n FROM part)"

AT_ROWS = [(0, 0), (1, 1), (2, 7), (3, 16), (4, 31), (5, 32), (6, 50), (7, 63), (8, 64), (9, 65), (10, 128)]
AT = f"q AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(floor(n * a / 64.0) AS BIGINT) AS i FROM u CROSS JOIN {values(AT_ROWS, 'qid', 'a')})"
K = f"q AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(floor(n * a / 200.0) AS BIGINT) AS k FROM u CROSS JOIN {values(AT_ROWS, 'qid', 'a')})"


def _set(spark, d) -> BitSet:
    return BitSet(*error_events(spark, d))


def _multi(spark, d) -> MultiSet:
    return MultiSet(*part_lines(spark, d))


def _asks(spark, n: int, text: str):
    return spark.sql(f"WITH u AS (SELECT CAST({n} AS BIGINT) AS n), {text} SELECT * FROM q").withColumnRenamed("i", "at")


RANK = "(SELECT count(*) FROM b WHERE pos < q.i)"
ZEROS = f"least(q.i, (SELECT n FROM u)) - {RANK}"


@query("bv_rank1", f"WITH {B}, {AT} SELECT qid, i, {RANK} AS rank1 FROM q")
def bv_rank1(spark, d):
    s = _set(spark, d)
    return s.rank1(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "rank1")


@query("bv_rank0", f"WITH {B}, {AT} SELECT qid, i, {ZEROS} AS rank0 FROM q")
def bv_rank0(spark, d):
    s = _set(spark, d)
    return s.rank0(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "rank0")


@query("bv_ranks", f"WITH {B}, {AT} SELECT qid, {ZEROS} AS rank0, {RANK} AS rank1 FROM q")
def bv_ranks(spark, d):
    s = _set(spark, d)
    return s.ranks(_asks(spark, s.universe, AT)).select("qid", "rank0", "rank1")


ONES = "o AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM b)"
ZERO_ROWS = "z AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM (SELECT event_id AS pos FROM events WHERE event_type <> 'error'))"


@query("bv_select1", f"WITH {B}, {K}, {ONES} SELECT q.qid, q.k, o.pos FROM q LEFT JOIN o USING (k)")
def bv_select1(spark, d):
    s = _set(spark, d)
    return s.select1(_asks(spark, s.universe, K)).select("qid", "k", "pos")


SELECT0 = f"WITH {B}, {K.replace('200.0', '70.0')}, {ZERO_ROWS} SELECT q.qid, q.k, z.pos FROM q LEFT JOIN z USING (k)"


@query("bv_select0", SELECT0)
def bv_select0(spark, d):
    s = _set(spark, d)
    return s.select0(_asks(spark, s.universe, K.replace("200.0", "70.0"))).select("qid", "k", "pos")


@query("bv_get", f"WITH {B}, {AT} SELECT qid, i, CASE WHEN i < (SELECT n FROM u) THEN CAST((SELECT count(*) FROM b WHERE pos = q.i) AS BIGINT) END AS bit FROM q")
def bv_get(spark, d):
    s = _set(spark, d)
    return s.get(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "bit")


@query("bv_stats", f"WITH {B} SELECT n AS universe, (SELECT count(*) FROM b) AS num_ones, n - (SELECT count(*) FROM b) AS num_zeros FROM u")
def bv_stats(spark, d):
    return _set(spark, d).stats()


EVERY = "SELECT event_id AS i, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM events"


@query("bv_rank1_batch", EVERY)
def bv_rank1_batch(spark, d):
    asks = event_users(spark, d).select(F.col("pos").alias("qid"), F.col("pos").alias("at"))
    return _set(spark, d).rank1(asks).select(F.col("at").alias("i"), "rank1")


@query("bv_all_ones_from", f"WITH {B} SELECT coalesce((SELECT max(event_id) + 1 FROM events WHERE event_type <> 'error'), 0) AS all_ones_from")
def bv_all_ones_from(spark, d):
    return _set(spark, d).all_ones_from()


# -- physical forms -------------------------------------------------------------------------------


@query("bitbuf_words", f"WITH {B} SELECT pos // 32 AS block, CAST(sum(CAST(1 AS BIGINT) << CAST(pos % 32 AS INT)) AS BIGINT) AS word FROM b GROUP BY 1")
def bitbuf_words(spark, d):
    words = to_words(_set(spark, d).ones)
    halves = F.explode(F.array(*[F.struct((F.col("block") * 2 + h).alias("block"), F.shiftright("word", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("word")) for h in (0, 1)]))
    return words.select(halves.alias("h")).select("h.block", "h.word").where("word <> 0")


@query("bitbuf_roundtrip", f"WITH {B} SELECT pos FROM b")
def bitbuf_roundtrip(spark, d):
    return from_words(to_words(_set(spark, d).ones))


@query("intbuf_roundtrip", "SELECT event_id AS pos, user_id AS value FROM events")
def intbuf_roundtrip(spark, d):
    rows = event_users(spark, d).select("pos", F.col("sym").alias("value"))
    return unpack_integers(pack_integers(rows, 20), 20)


DIRECTORY = f"WITH {B}, c AS (SELECT pos // 1024 AS block, count(*) AS ones FROM b GROUP BY 1) SELECT block, ones, CAST(coalesce(sum(ones) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM c"


@query("dense_rank_directory", DIRECTORY)
def dense_rank_directory(spark, d):
    return _set(spark, d).directory(10)


@query("dense_select1_batch", f"WITH {B}, {K}, {ONES} SELECT q.qid, coalesce(o.pos, 4294967295) AS pos FROM q LEFT JOIN o USING (k)")
def dense_select1_batch(spark, d):
    s = _set(spark, d)
    return s.select1(_asks(spark, s.universe, K)).select("qid", F.coalesce("pos", F.lit(4294967295)).alias("pos"))


@query("dense_ones", f"WITH {B} SELECT pos FROM b ORDER BY pos")
def dense_ones(spark, d):
    return _set(spark, d).ones.orderBy("pos")


@query("dense_select1_range", f"WITH {B} SELECT pos FROM b, u WHERE pos >= n // 4 AND pos < n - n // 3 ORDER BY pos")
def dense_select1_range(spark, d):
    s = _set(spark, d)
    return s.in_range(s.universe // 4, s.universe - s.universe // 3).orderBy("pos")


@query("dense_rank1", f"WITH {B}, {AT} SELECT qid, i, {RANK} AS rank1 FROM q")
def dense_rank1(spark, d):
    s = _set(spark, d)
    return DenseSet.build(s).rank1(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "rank1")


@query("dense_select1", f"WITH {B}, {K}, {ONES} SELECT q.qid, q.k, o.pos FROM q LEFT JOIN o USING (k)")
def dense_select1(spark, d):
    s = _set(spark, d)
    return DenseSet.build(s, 8).select1(_asks(spark, s.universe, K)).select("qid", "k", "pos")


EF = f"""WITH {B}, t AS (SELECT min(pos) AS off, count(*) AS c, (SELECT n FROM u) AS n FROM b),
w AS (SELECT off, CASE WHEN (n - off) // c >= 1 THEN CAST(floor(log2((n - off) // c)) AS BIGINT) ELSE 0 END AS l FROM t),
o AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, off, l, pos - off AS rel FROM b, w),
e AS (SELECT idx, off AS "offset", l AS low_bits, rel >> CAST(l AS INT) AS high, rel - ((rel >> CAST(l AS INT)) << CAST(l AS INT)) AS low, idx + (rel >> CAST(l AS INT)) AS high_pos FROM o)"""


@query("elias_fano_encode", f"{EF} SELECT * FROM e")
def elias_fano_encode(spark, d):
    return _set(spark, d).elias_fano()


@query("elias_fano_low_bits", f"{EF.replace('CASE WHEN (n - off) // c >= 1 THEN CAST(floor(log2((n - off) // c)) AS BIGINT) ELSE 0 END', 'CAST(5 AS BIGINT)')} SELECT * FROM e")
def elias_fano_low_bits(spark, d):
    return _set(spark, d).elias_fano(5)


@query("elias_fano_select1", f"WITH {B}, {K}, {ONES} SELECT q.qid, o.pos FROM q LEFT JOIN o USING (k)")
def elias_fano_select1(spark, d):
    s = _set(spark, d)
    return s.elias_fano_select1(_asks(spark, s.universe, K)).select("qid", "pos")


@query("elias_fano_rank1", f"WITH {B}, {AT} SELECT qid, {RANK} AS rank1 FROM q")
def elias_fano_rank1(spark, d):
    s = _set(spark, d)
    return s.elias_fano_rank1(_asks(spark, s.universe, AT)).select("qid", "rank1")


RUNS = f"""WITH {B}, g AS (SELECT pos, pos - (row_number() OVER (ORDER BY pos) - 1) AS z FROM b),
r AS (SELECT z, min(pos) AS start, count(*) AS length FROM g GROUP BY z)
SELECT row_number() OVER (ORDER BY start) - 1 AS run, start, length, z, start + length AS zo FROM r"""


@query("rle_runs", RUNS)
def rle_runs(spark, d):
    return _set(spark, d).runs()


@query("rle_from_runs", "WITH r AS (SELECT o_orderkey AS part, o_custkey % 7 AS zeros, o_custkey % 5 AS ones, CAST(sum(o_custkey % 7 + o_custkey % 5) OVER (ORDER BY o_orderkey) AS BIGINT) AS upto FROM orders) SELECT unnest(range(upto - ones, upto)) AS pos FROM r")
def rle_from_runs(spark, d):
    runs = order_customers(spark, d).select(F.col("pos").alias("part"), (F.col("sym") % 7).alias("zeros"), (F.col("sym") % 5).alias("ones"))
    return BitSet.from_runs(runs).ones


@query("rle_rank1", f"WITH {B}, {AT} SELECT qid, i, {RANK} AS rank1 FROM q")
def rle_rank1(spark, d):
    s = _set(spark, d)
    return s.runs_rank1(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "rank1")


@query("rle_select1", f"WITH {B}, {K}, {ONES} SELECT q.qid, q.k, o.pos FROM q LEFT JOIN o USING (k)")
def rle_select1(spark, d):
    s = _set(spark, d)
    return s.runs_select(_asks(spark, s.universe, K)).select("qid", "k", "pos")


@query("rle_select0", SELECT0)
def rle_select0(spark, d):
    s = _set(spark, d)
    return s.runs_select(_asks(spark, s.universe, K.replace("200.0", "70.0")), ones=False).select("qid", "k", "pos")


@query(
    "rle_aligned_ranks",
    f"""WITH {B}, g AS (SELECT pos, pos - (row_number() OVER (ORDER BY pos) - 1) AS z FROM b), r AS (SELECT max(pos) + 1 AS i FROM g GROUP BY z)
SELECT i, i - (SELECT count(*) FROM b WHERE pos < r.i) AS rank0, (SELECT count(*) FROM b WHERE pos < r.i) AS rank1 FROM r""",
)
def rle_aligned_ranks(spark, d):
    """At the ends of runs both ranks stand in the run table."""
    return _set(spark, d).runs().select(F.col("zo").alias("i"), F.col("z").alias("rank0"), (F.col("zo") - F.col("z")).alias("rank1"))


PAD = (10, 5)


@query("zeropad_rank", f"WITH {B}, {AT} SELECT qid, i, (SELECT count(*) FROM b WHERE pos + {PAD[0]} < q.i) AS rank1, least(q.i, (SELECT n + {sum(PAD)} FROM u)) - (SELECT count(*) FROM b WHERE pos + {PAD[0]} < q.i) AS rank0 FROM q")
def zeropad_rank(spark, d):
    s = _set(spark, d)
    return s.padded(*PAD).ranks(_asks(spark, s.universe, AT)).select("qid", F.col("at").alias("i"), "rank1", "rank0")


TAIL = "(SELECT pos FROM b WHERE pos < (SELECT n // 2 FROM u) UNION ALL SELECT event_id FROM events WHERE event_id >= (SELECT n // 2 FROM u))"


@query("onepad_rank", f"WITH {B}, {AT} SELECT qid, i, (SELECT count(*) FROM {TAIL} AS t WHERE t.pos < q.i) AS rank1 FROM q")
def onepad_rank(spark, d):
    s = _set(spark, d)
    half = s.universe // 2
    return BitSet(s.in_range(0, half), half).rank1_with_tail(_asks(spark, s.universe, AT), s.universe).select("qid", F.col("at").alias("i"), "rank1")


@query("onepad_select1", f"WITH {B}, {K.replace('200.0', '70.0')}, o AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k FROM {TAIL} AS t) SELECT q.qid, q.k, o.pos FROM q LEFT JOIN o USING (k)")
def onepad_select1(spark, d):
    s = _set(spark, d)
    half = s.universe // 2
    return BitSet(s.in_range(0, half), half).select1_with_tail(_asks(spark, s.universe, K.replace("200.0", "70.0")), s.universe).select("qid", "k", "pos")


# -- multisets ------------------------------------------------------------------------------------

COPIES = "c AS (SELECT pos, cnt, CAST(sum(cnt) OVER (ORDER BY pos) AS BIGINT) AS upto FROM m)"
MK = K.replace("n * a / 200.0", "n * a / 2.0")


@query("mbv_get", f"WITH {M}, {AT} SELECT qid, i, coalesce(m.cnt, 0) AS cnt FROM q LEFT JOIN m ON m.pos = q.i")
def mbv_get(spark, d):
    m = _multi(spark, d)
    return m.get(_asks(spark, m.universe, AT)).select("qid", F.col("at").alias("i"), "cnt")


MRANK = "CAST(coalesce((SELECT sum(cnt) FROM m WHERE pos < q.i), 0) AS BIGINT)"


@query("mbv_rank1", f"WITH {M}, {AT} SELECT qid, i, {MRANK} AS rank1 FROM q")
def mbv_rank1(spark, d):
    m = _multi(spark, d)
    return m.rank1(_asks(spark, m.universe, AT)).select("qid", F.col("at").alias("i"), "rank1")


@query("mbv_rank1_batch", f"WITH {M} SELECT p_partkey AS i, CAST(coalesce(sum(m.cnt) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM part LEFT JOIN m ON m.pos = p_partkey")
def mbv_rank1_batch(spark, d):
    asks = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("qid"), F.col("p_partkey").alias("at"))
    return _multi(spark, d).rank1(asks).select(F.col("at").alias("i"), "rank1")


@query("mbv_select1", f"WITH {M}, {MK}, {COPIES} SELECT q.qid, q.k, c.pos FROM q LEFT JOIN c ON c.upto - c.cnt <= q.k AND q.k < c.upto")
def mbv_select1(spark, d):
    m = _multi(spark, d)
    return m.select1(_asks(spark, m.universe, MK)).select("qid", "k", "pos")


@query("mbv_stats", f"WITH {M} SELECT n AS universe, CAST((SELECT sum(cnt) FROM m) AS BIGINT) AS num_ones, (SELECT count(*) FROM m) AS num_unique_ones, n - (SELECT count(*) FROM m) AS num_zeros FROM u")
def mbv_stats(spark, d):
    return _multi(spark, d).stats()


@query("mbv_as_set", f"WITH {B} SELECT pos FROM b")
def mbv_as_set(spark, d):
    """Error events, each of which occurs once: the conversion checks it."""
    ones, universe = error_events(spark, d)
    return MultiSet.build(ones.withColumn("cnt", F.lit(1)), universe).as_set().ones


@query("multi_unique_rank", f"WITH {M}, {AT} SELECT qid, i, (SELECT count(*) FROM m WHERE pos < q.i) AS unique_rank1, least(i, (SELECT n FROM u)) - (SELECT count(*) FROM m WHERE pos < q.i) AS unique_rank0 FROM q")
def multi_unique_rank(spark, d):
    m = _multi(spark, d)
    return m.unique_ranks(_asks(spark, m.universe, AT)).select("qid", F.col("at").alias("i"), "unique_rank1", "unique_rank0")


TRIM = """WITH e AS (SELECT event_id AS pos, event_type = 'error' AS one FROM events), u AS (SELECT count(*) AS n, (count(*) + 31) // 32 AS nb FROM e),
x AS (SELECT pos // 32 AS b, bool_and({0}) AS z, bool_and(NOT ({0})) AS o FROM e GROUP BY 1),
zz AS (SELECT coalesce(min(b) FILTER (WHERE NOT z), max(nb)) AS l, greatest(coalesce(max(b) FILTER (WHERE NOT z) + 1, 1), 1) AS r FROM x, u),
oo AS (SELECT coalesce(min(b) FILTER (WHERE NOT o), max(nb)) AS l, greatest(coalesce(max(b) FILTER (WHERE NOT o) + 1, 1), 1) AS r FROM x, u),
p AS (SELECT CASE WHEN greatest(zz.r - zz.l, 0) <= greatest(oo.r - oo.l, 0) THEN 0 ELSE 1 END AS padding, zz.l AS zl, zz.r AS zr, oo.l AS ol, oo.r AS orr, nb FROM zz, oo, u)
SELECT CAST(padding AS BIGINT) AS padding, CASE WHEN padding = 0 THEN zl ELSE ol END AS "left", CASE WHEN padding = 0 THEN zr ELSE orr END AS "right", nb AS blocks FROM p"""


@query("padded_blocks_of_zeros", TRIM.format("pos < 100 OR pos >= (SELECT n // 2 FROM u) OR NOT one"))
def padded_blocks_of_zeros(spark, d):
    s = _set(spark, d)
    return BitSet(s.in_range(100, s.universe // 2), s.universe).trimmed()


@query("padded_blocks_of_ones", TRIM.format("pos >= 100 AND pos < (SELECT n // 2 FROM u) AND NOT one"))
def padded_blocks_of_ones(spark, d):
    s = _set(spark, d)
    around = spark.range(s.universe).where((F.col("id") < 100) | (F.col("id") >= s.universe // 2)).select(F.col("id").alias("pos"))
    return BitSet(s.in_range(100, s.universe // 2).unionAll(around), s.universe).trimmed()


@query(
    "byte_size",
    f"""WITH {B}, c AS (SELECT n, (SELECT count(*) FROM b) AS ones, (SELECT min(pos) FROM b) AS off FROM u),
w AS (SELECT *, CASE WHEN (n - off) // ones >= 1 THEN CAST(floor(log2((n - off) // ones)) AS BIGINT) ELSE 0 END AS l FROM c),
g AS (SELECT count(DISTINCT z) AS runs FROM (SELECT pos - row_number() OVER (ORDER BY pos) AS z FROM b))
SELECT 8 * ((n + 63) // 64) AS bit_buffer, 8 * ((n + 63) // 64) + 4 * ((n + 1023) // 1024) AS dense, 4 * ones AS "array", 8 * ((ones * l + 63) // 64) + 8 * ((ones + ((n - off) >> CAST(l AS INT)) + 1 + 63) // 64) AS sparse,
  8 * (SELECT runs FROM g) AS run_length, 8 * ((n * 20 + 63) // 64) AS int_buffer FROM w""",
)
def byte_size(spark, d):
    return byte_sizes(_set(spark, d), 20)
