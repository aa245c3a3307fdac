"""Queries on symbol sequences: users of events, customers of orders, sizes of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions.zorder import encode2, encode3, morton_masks
from rankweave.operators.huffman import HuffmanSequence, canonical, code_table
from rankweave.operators.sequence import Sequence, counts_arrays, morton_sequence
from rankweave.plans.index import SequenceIndex
from rankweave.queries.base import EVENTS, ORDERS, PARTS, RANGE_ROWS, ask, query, range_params, values
from rankweave.sources.scratch import scratch_folder
from rankweave.sources.tables import event_users, order_customers, order_points, part_sizes

Q = range_params()
HEAD = f"WITH {EVENTS}, {Q}"
IN = "s.pos >= q.lo AND s.pos < q.hi"


def _events(spark, d):
    seq = event_users(spark, d)
    return Sequence.of(seq), ask(spark, seq, Q)


@query("wm_get", f"{HEAD} SELECT q.qid, q.lo AS at, s.sym FROM q LEFT JOIN s ON s.pos = q.lo")
def wm_get(spark, d):
    s, q = _events(spark, d)
    return s.get(q.select("qid", F.col("lo").alias("at"))).select("qid", "at", "sym")


@query("wm_get_indexed", f"{HEAD} SELECT q.qid, q.lo AS at, s.sym FROM q LEFT JOIN s ON s.pos = q.lo")
def wm_get_indexed(spark, d):
    s, q = _events(spark, d)
    return _index(spark, s).get(q.select("qid", F.col("lo").alias("at"))).select("qid", "at", "sym")


@query("wm_stats", f"WITH {EVENTS} SELECT count(*) AS len, max(sym) AS max_symbol, length(bin(max(sym))) AS num_levels FROM s")
def wm_stats(spark, d):
    return Sequence.of(event_users(spark, d)).stats()


@query("wm_count", f"{HEAD} SELECT q.qid, count(s.pos) AS cnt FROM q LEFT JOIN s ON {IN} AND s.sym = q.symbol GROUP BY q.qid")
def wm_count(spark, d):
    s, q = _events(spark, d)
    return s.count(q).select("qid", "cnt")


@query("wm_count_large_alphabet", f"WITH {ORDERS}, {Q} SELECT q.qid, count(s.pos) AS cnt FROM q LEFT JOIN s ON {IN} AND s.sym = q.symbol GROUP BY q.qid")
def wm_count_large_alphabet(spark, d):
    seq = order_customers(spark, d)
    return Sequence.of(seq).count(ask(spark, seq, Q)).select("qid", "cnt")


@query("wm_preceding_count", f"{HEAD} SELECT q.qid, count(s.pos) AS cnt FROM q LEFT JOIN s ON {IN} AND s.sym < q.symbol GROUP BY q.qid")
def wm_preceding_count(spark, d):
    s, q = _events(spark, d)
    return s.preceding_count(q).select("qid", "cnt")


QUANTILE = f"r AS (SELECT q.qid, q.k, s.sym AS symbol, row_number() OVER (PARTITION BY q.qid ORDER BY s.sym) - 1 AS rn, count(*) OVER (PARTITION BY q.qid, s.sym) AS cnt FROM q JOIN s ON {IN})"


@query("wm_quantile", f"{HEAD}, {QUANTILE} SELECT qid, symbol, cnt FROM r WHERE rn = k")
def wm_quantile(spark, d):
    s, q = _events(spark, d)
    return s.quantile(q).select("qid", "symbol", "cnt")


def _index(spark, s):
    return SequenceIndex.build(s, scratch_folder(spark, "sequence-index"))


@query("wm_quantile_indexed", f"{HEAD}, {QUANTILE} SELECT qid, symbol, cnt FROM r WHERE rn = k")
def wm_quantile_indexed(spark, d):
    s, q = _events(spark, d)
    return _index(spark, s).quantile(q).select("qid", "symbol", "cnt")


@query("wm_count_indexed", f"{HEAD} SELECT q.qid, count(s.pos) FILTER (WHERE s.sym < q.symbol) AS preceding, count(s.pos) FILTER (WHERE s.sym = q.symbol) AS cnt FROM q LEFT JOIN s ON {IN} GROUP BY q.qid")
def wm_count_indexed(spark, d):
    s, q = _events(spark, d)
    return _index(spark, s).count(q)


KS = [(0,), (1,), (9,), (32,), (60,)]
QUANTILES = f"""{HEAD}, w AS (SELECT q.qid, q.lo, q.hi, CAST(floor((q.hi - q.lo) * a / 64.0) AS BIGINT) AS k FROM q CROSS JOIN {values(KS, "a")} WHERE q.qid < 4)"""


@query("wm_quantile_batch", f"{QUANTILES}, r AS (SELECT q.qid, s.sym AS symbol, row_number() OVER (PARTITION BY q.qid ORDER BY s.sym) - 1 AS rn, count(*) OVER (PARTITION BY q.qid, s.sym) AS cnt FROM q JOIN s ON {IN}) SELECT w.qid, w.k, r.symbol, r.cnt FROM w JOIN r ON r.qid = w.qid AND r.rn = w.k")
def wm_quantile_batch(spark, d):
    seq = event_users(spark, d)
    text = QUANTILES[len("WITH ") + len(EVENTS) + 2 :]
    return Sequence.of(seq).quantile(ask(spark, seq, text, "SELECT * FROM w")).select("qid", "k", "symbol", "cnt")


MATCH = f"{IN} AND (s.sym >> CAST(q.ignore_bits AS INT)) = (q.symbol >> CAST(q.ignore_bits AS INT))"


def _kth(order: str) -> str:
    return f"{HEAD}, r AS (SELECT q.qid, s.pos, row_number() OVER (PARTITION BY q.qid ORDER BY s.pos {order}) - 1 AS rn, q.j FROM q JOIN s ON {MATCH}) SELECT q.qid, r.pos FROM q LEFT JOIN r ON r.qid = q.qid AND r.rn = q.j"


def _small_k(q):
    return q.drop("k").withColumnRenamed("j", "k")


@query("wm_select", _kth("ASC"))
def wm_select(spark, d):
    s, q = _events(spark, d)
    return s.select(_small_k(q))


@query("wm_select_last", _kth("DESC"))
def wm_select_last(spark, d):
    s, q = _events(spark, d)
    return s.select(_small_k(q), last=True)


@query("wm_select_first_leq", f"{HEAD} SELECT q.qid, min(s.pos) AS pos FROM q LEFT JOIN s ON {IN} AND s.sym <= q.symbol // 8 GROUP BY q.qid")
def wm_select_first_leq(spark, d):
    s, q = _events(spark, d)
    return s.first_at_most(q.withColumn("symbol", F.floor(F.col("symbol") / 8)))


@query("wm_simple_majority", f"WITH {PARTS.replace('CAST(p_size AS BIGINT)', 'CAST(p_size // 40 AS BIGINT)')}, {Q}, r AS (SELECT q.qid, s.sym FROM q JOIN s ON {IN} GROUP BY q.qid, s.sym, q.lo, q.hi HAVING 2 * count(*) > q.hi - q.lo) SELECT q.qid, r.sym AS symbol FROM q LEFT JOIN r USING (qid)")
def wm_simple_majority(spark, d):
    seq = part_sizes(spark, d).withColumn("sym", F.floor(F.col("sym") / 40))
    return Sequence.of(seq).simple_majority(ask(spark, seq, Q))


@query("wm_majority_k", f"WITH {PARTS}, {Q} SELECT q.qid, s.sym AS symbol, count(*) AS cnt FROM q JOIN s ON {IN} GROUP BY q.qid, s.sym, q.lo, q.hi HAVING count(*) * 45 > q.hi - q.lo")
def wm_majority_k(spark, d):
    seq = part_sizes(spark, d)
    return Sequence.of(seq).majority(ask(spark, seq, Q).withColumn("parts", F.lit(45)))


# -- the lowest level -----------------------------------------------------------------------------

LEVELS = "lv AS (SELECT length(bin(m)) AS l FROM nn)"


def rev(x: str) -> str:
    """x with its 32 bits reversed: sorts like the reversal within any number of levels."""
    return f"CAST(list_sum(list_transform(range(0, 32), lambda i: (({x} >> CAST(i AS INT)) & 1) << CAST(31 - i AS INT))) AS BIGINT)"


NODE = "((s.sym >> CAST(g.ignore_bits AS INT)) << CAST(g.ignore_bits AS INT))"
#: every row's index on the lowest level, for each number of ignored bits asked for
BOTTOM = f"""{LEVELS}, codes AS (SELECT sym, {rev("sym")} AS r FROM (SELECT DISTINCT ((s.sym >> CAST(ignore_bits AS INT)) << CAST(ignore_bits AS INT)) AS sym FROM s, (SELECT DISTINCT ignore_bits FROM q))),
bot AS (SELECT g.ignore_bits, s.pos, {NODE} AS node, row_number() OVER (PARTITION BY g.ignore_bits ORDER BY c.r, s.pos) - 1 AS bot
  FROM s CROSS JOIN (SELECT DISTINCT ignore_bits FROM q) AS g JOIN codes AS c ON c.sym = {NODE})"""

COUNTS = f"""{BOTTOM}, iv AS (SELECT q.qid, bot.node AS symbol, min(bot.bot) AS start, max(bot.bot) + 1 AS "end" FROM q JOIN bot ON bot.ignore_bits = q.ignore_bits AND bot.pos >= q.lo AND bot.pos < q.hi
  WHERE bot.node <= {{hi}} AND bot.node + (CAST(1 AS BIGINT) << CAST(q.ignore_bits AS INT)) > {{lo}} GROUP BY q.qid, bot.node)"""


@query("wm_counts", f"WITH {EVENTS}, {range_params([(*r[:5], 0) for r in RANGE_ROWS])}, {COUNTS.format(lo=0, hi='(SELECT m FROM nn)')} SELECT * FROM iv")
def wm_counts(spark, d):
    s, q = _events(spark, d)
    return s.counts(q.withColumns({"ignore_bits": F.lit(0), "s_lo": F.lit(0), "s_hi": F.lit(s.max_symbol)}))


@query("wm_counts_ignore_bits", f"{HEAD}, {COUNTS.format(lo='q.symbol', hi='q.symbol + 40')} SELECT * FROM iv")
def wm_counts_ignore_bits(spark, d):
    s, q = _events(spark, d)
    return s.counts(q.withColumns({"s_lo": F.col("symbol"), "s_hi": F.col("symbol") + 40}))


@query("wm_counts_arrays", f"""WITH {EVENTS}, {range_params([(*r[:5], 0) for r in RANGE_ROWS])}, {COUNTS.format(lo=0, hi='(SELECT m FROM nn)')} SELECT qid, string_agg(symbol, ',' ORDER BY start) AS symbols, string_agg(start, ',' ORDER BY start) AS starts, string_agg("end", ',' ORDER BY start) AS ends FROM iv GROUP BY qid""")
def wm_counts_arrays(spark, d):
    s, q = _events(spark, d)
    arrays = counts_arrays(s.counts(q.withColumns({"ignore_bits": F.lit(0), "s_lo": F.lit(0), "s_hi": F.lit(s.max_symbol)})))
    return arrays.select("qid", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("symbols", "starts", "ends")])


UNION_ROWS = [(0, 0, 8, 0, 0, 1), (1, 8, 20, 0, 0, 1), (2, 24, 40, 0, 0, 1), (3, 40, 41, 0, 0, 1), (4, 60, 64, 0, 0, 1)]
UNION = f"""{BOTTOM}, hit AS (SELECT bot.node AS symbol, bot.bot, bot.bot - row_number() OVER (PARTITION BY bot.node ORDER BY bot.bot) AS g FROM q JOIN bot ON bot.pos >= q.lo AND bot.pos < q.hi)"""


@query("wm_counts_union", f'WITH {EVENTS}, {range_params(UNION_ROWS)}, {UNION} SELECT symbol, min(bot) AS start, max(bot) + 1 AS "end" FROM hit GROUP BY symbol, g')
def wm_counts_union(spark, d):
    seq = event_users(spark, d)
    return Sequence.of(seq).counts_union(ask(spark, seq, range_params(UNION_ROWS)))


CUT = "(s.sym >> CAST(q.ignore_bits AS INT))"
ASKED = "(q.symbol >> CAST(q.ignore_bits AS INT))"
LOCATE = f"""{LEVELS}, rs AS (SELECT sym, {rev("sym")} AS r FROM (SELECT DISTINCT sym FROM s UNION SELECT DISTINCT (sym >> 1) << 1 FROM s UNION SELECT DISTINCT (sym >> 2) << 2 FROM s UNION SELECT DISTINCT (sym >> 3) << 3 FROM s)),
qr AS (SELECT q.*, {rev("(q.symbol >> CAST(q.ignore_bits AS INT)) << CAST(q.ignore_bits AS INT)")} AS qrev FROM q),
loc AS (SELECT q.qid, count(*) FILTER (WHERE {IN} AND {CUT} < {ASKED}) AS preceding_count,
  count(*) FILTER (WHERE rs.r < q.qrev) + count(*) FILTER (WHERE {CUT} = {ASKED} AND s.pos < q.lo) AS start,
  count(*) FILTER (WHERE {CUT} = {ASKED} AND {IN}) AS c
  FROM qr AS q CROSS JOIN s JOIN rs ON rs.sym = ({CUT} << CAST(q.ignore_bits AS INT)) GROUP BY q.qid)"""


@query("wm_locate", f'{HEAD}, {LOCATE} SELECT qid, preceding_count, start, start + c AS "end" FROM loc')
def wm_locate(spark, d):
    s, q = _events(spark, d)
    return s.locate(q)


BATCH_ROWS = [(3 * i + j, a, b, c, 0, 0) for i, c in enumerate((5, 30, 63)) for j, (a, b) in enumerate(((0, 64), (10, 20), (50, 63)))]


@query("wm_locate_batch", f'WITH {EVENTS}, {range_params(BATCH_ROWS)}, {LOCATE} SELECT loc.qid AS key, q.symbol, preceding_count, start, start + c AS "end" FROM loc JOIN q USING (qid)')
def wm_locate_batch(spark, d):
    seq = event_users(spark, d)
    q = ask(spark, seq, range_params(BATCH_ROWS))
    ranges = q.where("qid < 3").select(F.col("qid").alias("range_idx"), "lo", "hi")
    symbols = q.where("qid % 3 = 0").select(F.floor(F.col("qid") / 3).alias("sym_idx"), "symbol", "ignore_bits")
    return Sequence.of(seq).locate_batch(ranges, symbols)


@query("wm_select_upwards", f"{HEAD}, {BOTTOM} SELECT q.qid, bot.pos FROM q LEFT JOIN bot ON bot.ignore_bits = q.ignore_bits AND bot.bot = q.lo")
def wm_select_upwards(spark, d):
    s, q = _events(spark, d)
    return s.select_upwards(q.select("qid", F.col("lo").alias("at"), "ignore_bits"))


LEVEL_BITS = f"""WITH {EVENTS}, nn AS (SELECT count(*) AS n, max(sym) AS m FROM s), {LEVELS},
x AS (SELECT lev AS level, pos, sym >> CAST(l - lev AS INT) AS prefix, (sym >> CAST(l - 1 - lev AS INT)) & 1 AS bit, l FROM s, lv, range(0, 64) AS t(lev) WHERE lev < l),
xr AS (SELECT DISTINCT prefix, {rev("prefix")} AS r FROM (SELECT DISTINCT prefix FROM x)),
p AS (SELECT level, bit, row_number() OVER (PARTITION BY level ORDER BY xr.r, pos) - 1 AS idx FROM x JOIN xr USING (prefix))"""


@query("wm_levels", f"{LEVEL_BITS} SELECT level, CAST(sum(1 - bit) AS BIGINT) AS nz, CAST(sum(bit) AS BIGINT) AS ones, CAST(1 AS BIGINT) << CAST((SELECT l FROM lv) - 1 - level AS INT) AS place, CAST(sum(bit * (idx % 1009)) AS BIGINT) AS checksum FROM p GROUP BY level")
def wm_levels(spark, d):
    s = Sequence.of(event_users(spark, d))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(s.levels - 1) - F.col("level")).cast("int"))
    grouped = s.level_bits().groupBy("level").agg(F.sum(1 - F.col("bit")).alias("nz"), F.sum("bit").alias("ones"), F.sum(F.col("bit") * (F.col("idx") % 1009)).alias("checksum"))
    return grouped.select("level", "nz", "ones", place.alias("place"), "checksum")


@query("wm_level_words", f"{LEVEL_BITS}, w AS (SELECT level, idx // 32 AS block, CAST(sum(bit << CAST(idx % 32 AS INT)) AS BIGINT) AS word, CAST(sum(bit) AS BIGINT) AS c FROM p GROUP BY 1, 2) SELECT level, block, word, CAST(coalesce(sum(c) OVER (PARTITION BY level ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1 FROM w")
def wm_level_words(spark, d):
    return Sequence.of(event_users(spark, d)).level_words()


# -- symbol ranges and boxes ------------------------------------------------------------------------

BUCKETS = [(0, 0, 10), (1, 11, 40), (2, 30, 33), (3, 41, 100000), (4, 7, 7)]
BUCKET_TABLE = f"bk AS (SELECT CAST(bucket AS BIGINT) AS bucket, CAST(s_lo AS BIGINT) AS s_lo, CAST(s_hi AS BIGINT) AS s_hi FROM {values(BUCKETS, 'bucket', 's_lo', 's_hi')})"


@query("wm_count_batch", f"{HEAD}, {BUCKET_TABLE} SELECT q.qid, bk.bucket, count(s.pos) AS cnt FROM q CROSS JOIN bk LEFT JOIN s ON {IN} AND s.sym BETWEEN bk.s_lo AND bk.s_hi GROUP BY q.qid, bk.bucket")
def wm_count_batch(spark, d):
    s, q = _events(spark, d)
    return s.count_batch(q, spark.sql(f"WITH {BUCKET_TABLE} SELECT * FROM bk"))


POINTS = "pt AS (SELECT o_orderkey AS pos, o_custkey AS x, CAST(floor(o_totalprice / 1000) AS BIGINT) AS y FROM orders), s AS (SELECT pos, x AS sym, x, y FROM pt)"
BOXES2 = [(0, 0, 100000, 0, 100), (1, 10, 60, 20, 300), (2, 100, 101, 0, 1000), (3, 0, 65535, 0, 65535)]
BOX2 = f"bx AS (SELECT CAST(box AS BIGINT) AS box, least(CAST(x0 AS BIGINT), 65535) AS x0, least(CAST(x1 AS BIGINT), 65535) AS x1, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1 FROM {values(BOXES2, 'box', 'x0', 'x1', 'y0', 'y1')})"


def _points(spark, d):
    points = order_points(spark, d)
    seq = morton_sequence(points)
    q = ask(spark, points.select("pos", F.col("x").alias("sym")), Q)
    boxes = spark.sql(f"WITH {BOX2} SELECT * FROM bx").select("box", encode2(F.col("x0"), F.col("y0")).alias("low"), encode2(F.col("x1"), F.col("y1")).alias("high"))
    return Sequence.of(seq), q, boxes


@query("wm_morton_count_batch_2d", f"WITH {POINTS}, {Q}, {BOX2} SELECT q.qid, bx.box, count(s.pos) AS cnt FROM q CROSS JOIN bx LEFT JOIN s ON {IN} AND s.x BETWEEN bx.x0 AND bx.x1 AND s.y BETWEEN bx.y0 AND bx.y1 GROUP BY q.qid, bx.box")
def wm_morton_count_batch_2d(spark, d):
    s, q, boxes = _points(spark, d)
    return s.box_counts(q, boxes, 2)


BOXES3 = [(0, 0, 30, 0, 200, 0, 6), (1, 5, 20, 50, 400, 2, 4), (2, 0, 1023, 0, 1023, 0, 1023)]
BOX3 = f"bx AS (SELECT * FROM {values(BOXES3, 'box', 'x0', 'x1', 'y0', 'y1', 'z0', 'z1')})"
POINTS3 = "s AS (SELECT o_orderkey AS pos, o_custkey AS sym, o_custkey % 1024 AS x, CAST(floor(o_totalprice / 1000) AS BIGINT) % 1024 AS y, o_orderkey % 7 AS z FROM orders)"


@query("wm_morton_count_batch_3d", f"WITH {POINTS3}, {Q}, {BOX3} SELECT q.qid, CAST(bx.box AS BIGINT) AS box, count(s.pos) AS cnt FROM q CROSS JOIN bx LEFT JOIN s ON {IN} AND s.x BETWEEN bx.x0 AND bx.x1 AND s.y BETWEEN bx.y0 AND bx.y1 AND s.z BETWEEN bx.z0 AND bx.z1 GROUP BY q.qid, bx.box")
def wm_morton_count_batch_3d(spark, d):
    points = order_points(spark, d)
    seq = points.select("pos", encode3(F.col("x") % 1024, F.col("y") % 1024, F.col("pos") % 7).alias("sym"))
    boxes = spark.sql(f"WITH {BOX3} SELECT * FROM bx").select(F.col("box").cast("long").alias("box"), encode3(F.col("x0"), F.col("y0"), F.col("z0")).alias("low"), encode3(F.col("x1"), F.col("y1"), F.col("z1")).alias("high"))
    return Sequence.of(seq).box_counts(ask(spark, points.select("pos", F.col("x").alias("sym")), Q), boxes, 3)


@query(
    "wm_morton_counts",
    f"""WITH {POINTS}, {Q}, e AS (SELECT s.*, CAST(list_sum(list_transform(range(0, 16), lambda i: ((((s.x >> CAST(i AS INT)) & 1) << CAST(2 * i AS INT)) | (((s.y >> CAST(i AS INT)) & 1) << CAST(2 * i + 1 AS INT))))) AS BIGINT) AS code FROM s),
lv AS (SELECT length(bin(max(code))) AS l FROM e), cr AS (SELECT code, {rev("code")} AS r FROM (SELECT DISTINCT code FROM e)), bot AS (SELECT e.pos, e.x, e.y, e.code, row_number() OVER (ORDER BY cr.r, e.pos) - 1 AS bot FROM e JOIN cr USING (code))
SELECT q.qid, bot.code AS symbol, min(bot.bot) AS start, max(bot.bot) + 1 AS "end" FROM q JOIN bot ON bot.pos >= q.lo AND bot.pos < q.hi AND bot.x BETWEEN 10 AND 60 AND bot.y BETWEEN 20 AND 300 GROUP BY q.qid, bot.code""",
)
def wm_morton_counts(spark, d):
    s, q, boxes = _points(spark, d)
    corners = boxes.where("box = 1").select("low", "high")
    return s.box_intervals(q.join(F.broadcast(corners)))


@query("morton_masks", "SELECT CAST(dims AS BIGINT) AS dims, CAST(level AS BIGINT) AS level, CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN i % dims = (11 - level) % dims THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE 0 END)) AS BIGINT) AS mask FROM range(1, 4) AS a(dims), range(0, 12) AS b(level)")
def morton_masks_query(spark, d):
    rows = [(dims, level, m) for dims in (1, 2, 3) for level, m in enumerate(morton_masks(dims, 12))]
    return spark.createDataFrame(rows, "dims long, level long, mask long")


# -- prefix-coded sequences -------------------------------------------------------------------------


def _huffman(spark, d):
    seq = part_sizes(spark, d)
    return HuffmanSequence.build(seq, scratch_folder(spark, "huffman")), ask(spark, seq, Q)


PHEAD = f"WITH {PARTS}, {Q}"


@query("hwm_get", f"{PHEAD} SELECT q.qid, q.lo AS at, s.sym FROM q JOIN s ON s.pos = q.lo")
def hwm_get(spark, d):
    h, q = _huffman(spark, d)
    return h.get(q.select("qid", F.col("lo").alias("at"))).select("qid", "at", "sym")


@query("hwm_count", f"{PHEAD} SELECT q.qid, count(s.pos) AS cnt FROM q LEFT JOIN s ON {IN} AND s.sym = q.symbol GROUP BY q.qid")
def hwm_count(spark, d):
    h, q = _huffman(spark, d)
    return h.count(q).select("qid", "cnt")


def _coded_kth(order: str) -> str:
    return f"{PHEAD}, r AS (SELECT q.qid, s.pos, row_number() OVER (PARTITION BY q.qid ORDER BY s.pos {order}) - 1 AS rn, q.j FROM q JOIN s ON {IN} AND s.sym = q.symbol) SELECT q.qid, r.pos FROM q LEFT JOIN r ON r.qid = q.qid AND r.rn = q.j"


@query("hwm_select", _coded_kth("ASC"))
def hwm_select(spark, d):
    h, q = _huffman(spark, d)
    return h.select(_small_k(q))


@query("hwm_select_last", _coded_kth("DESC"))
def hwm_select_last(spark, d):
    h, q = _huffman(spark, d)
    return h.select(_small_k(q), last=True)


@query("hwm_simple_majority", f"{PHEAD}, r AS (SELECT q.qid, s.sym FROM q JOIN s ON {IN} GROUP BY q.qid, s.sym, q.lo, q.hi HAVING 2 * count(*) > q.hi - q.lo) SELECT q.qid, r.sym AS symbol FROM q LEFT JOIN r USING (qid)")
def hwm_simple_majority(spark, d):
    h, q = _huffman(spark, d)
    return h.simple_majority(q)


#: Huffman's algorithm on a sorted list: two lightest nodes merge; leaves before merged nodes, the last leaf and the oldest node first
HUFFMAN = f"""WITH RECURSIVE {PARTS}, f AS (SELECT row_number() OVER (ORDER BY count(*) DESC, sym) - 1 AS rn, sym AS symbol, count(*) AS weight FROM s GROUP BY sym),
r AS (SELECT 0 AS step, list(struct_pack(w := CAST(weight AS BIGINT), t := 0, o := CAST((SELECT count(*) FROM f) - rn AS BIGINT), m := [CAST(rn AS BIGINT)])) AS q, [CAST(0 AS BIGINT) for x in list(rn)] AS d FROM f
  UNION ALL SELECT step + 1, z[3:] || [struct_pack(w := z[1].w + z[2].w, t := 1, o := CAST(step AS BIGINT), m := z[1].m || z[2].m)], list_transform(d, lambda x, i: x + CASE WHEN list_contains(z[1].m || z[2].m, i - 1) THEN 1 ELSE 0 END)
  FROM (SELECT step, list_sort(q) AS z, d FROM r WHERE len(q) > 1)),
y AS (SELECT list_sort(d) AS d FROM r WHERE len(q) = 1),
c AS (SELECT rn, symbol, weight, (SELECT d FROM y)[CAST(rn + 1 AS INT)] AS len FROM f), x AS (SELECT CAST(max(len) AS INT) AS longest FROM c)"""
#: at every level the free codes, in the order of their reversed bits, lose the last ones to the codes that end there
FREE = f"""{HUFFMAN}, e AS (SELECT list(k ORDER BY n) AS ended FROM (SELECT n, (SELECT count(*) FROM c WHERE c.len = n) AS k FROM x, range(1, 64) AS t(n) WHERE n <= longest)),
lv AS (SELECT 0 AS n, [CAST(0 AS BIGINT)] AS free, CAST([] AS BIGINT[]) AS done UNION ALL
  SELECT n + 1, g[1:len(g) - ended[n + 1]], done || g[len(g) - ended[n + 1] + 1:] FROM (SELECT n, done, ended, longest, list_transform(free, lambda v: v * 2) || list_transform(free, lambda v: v * 2 + 1) AS g FROM lv, e, x WHERE n < longest)),
codes AS (SELECT c.*, CAST(coalesce(sum(CAST(1 AS BIGINT) << CAST(longest - len AS INT)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> CAST(longest - len AS INT) AS canonical,
  (SELECT done FROM lv, x WHERE n = longest)[CAST(rn + 1 AS INT)] AS code, longest FROM c, x)"""


@query("hwm_stats", f"{HUFFMAN} SELECT CAST(sum(weight) AS BIGINT) AS len, max(symbol) AS max_symbol, max(len) AS num_levels, count(*) AS num_symbols FROM c")
def hwm_stats(spark, d):
    return _huffman(spark, d)[0].stats()


@query("hwm_level_lens", f"{HUFFMAN} SELECT n AS level, CAST(sum(weight) AS BIGINT) AS len FROM c, range(0, 64) AS t(n) WHERE n < len GROUP BY n")
def hwm_level_lens(spark, d):
    return _huffman(spark, d)[0].level_lens()


@query("huffman_order", f"WITH {PARTS} SELECT row_number() OVER (ORDER BY count(*) DESC, sym) - 1 AS rn, sym AS symbol, count(*) AS weight FROM s GROUP BY sym")
def huffman_order(spark, d):
    return code_table(part_sizes(spark, d)).select("rn", "symbol", "weight")


@query("huffman_lengths", f"{HUFFMAN} SELECT rn, symbol, weight, len FROM c")
def huffman_lengths(spark, d):
    return code_table(part_sizes(spark, d)).select("rn", "symbol", "weight", "len")


LENS = [(0, 1), (1, 3), (2, 3), (3, 4), (4, 4), (5, 5), (6, 6), (7, 6)]
LEN_TABLE = f"t AS (SELECT CAST(rn AS BIGINT) AS rn, CAST(len AS BIGINT) AS len FROM {values(LENS, 'rn', 'len')})"


@query("huffman_canonical", f"WITH {LEN_TABLE} SELECT rn, len, CAST(coalesce(sum(CAST(1 AS BIGINT) << CAST(6 - len AS INT)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> CAST(6 - len AS INT) AS code FROM t")
def huffman_canonical(spark, d):
    return canonical(spark.sql(f"WITH {LEN_TABLE} SELECT * FROM t"))


@query("huffman_wm_codes", f"{FREE} SELECT rn, symbol, len, canonical, code FROM codes")
def huffman_wm_codes(spark, d):
    return code_table(part_sizes(spark, d)).select("rn", "symbol", "len", "canonical", "code")


@query("huffman_padded", f"{FREE} SELECT symbol, len, code, (code << CAST(longest - len AS INT)) + (CAST(1 AS BIGINT) << CAST(longest - len AS INT)) - 1 AS padded FROM codes")
def huffman_padded(spark, d):
    return code_table(part_sizes(spark, d)).select("symbol", "len", "code", "padded")

