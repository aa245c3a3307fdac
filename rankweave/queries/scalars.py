"""Queries on bit arithmetic, Morton codes, integer codes, histograms and spatial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import bitmath, h2, ranges, zorder
from rankweave.functions.codes import decode_column, encode_column, mapped, unmapped
from rankweave.operators import histogram as hist
from rankweave.operators import spatial
from rankweave.queries.base import query, values
from rankweave.sources.tables import customer_gaps, event_users, line_points, table

LINES = "p AS (SELECT CAST(l_quantity AS BIGINT) AS x, l_suppkey AS y, l_orderkey AS id FROM lineitem)"


def interleave(*coords: str) -> str:
    """A Morton code in DuckDB SQL, bit by bit from the definition."""
    n, width = len(coords), 16 if len(coords) == 2 else 10
    terms = " + ".join(f"((({c} >> CAST(i AS INT)) & 1) << CAST({n} * i + {d} AS INT))" for d, c in enumerate(coords))
    return f"CAST(list_sum(list_transform(range(0, {width}), lambda i: {terms})) AS BIGINT)"


# -- bits -----------------------------------------------------------------------------------------


@query("bits_select_in_word", "WITH w AS (SELECT event_id AS id, event_id * 7919 + user_id AS word, user_id % 12 AS k FROM events) SELECT id, CAST(list_filter(range(0, 63), lambda i: (word >> CAST(i AS INT)) & 1 = 1)[k + 1] AS BIGINT) AS pos FROM w")
def bits_select_in_word(spark, d):
    word = F.col("pos") * 7919 + F.col("sym")
    return event_users(spark, d).select(F.col("pos").alias("id"), bitmath.select_in_word(word, F.col("sym") % 12).alias("pos"))


@query(
    "bits_misc",
    """WITH w AS (SELECT event_id AS id, event_id + 1 AS x FROM events)
SELECT id, length(bin(x)) - 1 AS ilog2, CAST(1 AS BIGINT) << CAST(length(bin(x)) - 1 AS INT) AS bit_floor, (CAST(1 AS BIGINT) << CAST(id % 50 AS INT)) - 1 AS one_mask,
  CAST(bit_count(x) AS BIGINT) AS popcount, CAST(list_filter(range(0, 63), lambda i: (x >> CAST(i AS INT)) & 1 = 1)[1] AS BIGINT) AS trailing_zeros,
  CAST(list_sum(list_transform(range(0, 20), lambda i: ((x >> CAST(i AS INT)) & 1) << CAST(19 - i AS INT))) AS BIGINT) AS reversed FROM w""",
)
def bits_misc(spark, d):
    x = F.col("pos") + 1
    return event_users(spark, d).select(
        F.col("pos").alias("id"), bitmath.ilog2(x).alias("ilog2"), bitmath.bit_floor(x).alias("bit_floor"), bitmath.one_mask(F.col("pos") % 50).alias("one_mask"),
        bitmath.popcount(x).alias("popcount"), bitmath.trailing_zeros(x).alias("trailing_zeros"), bitmath.reverse_low_bits(x, 20).alias("reversed"),
    )


SPANS = [(0, 0, 10, 3, 5), (1, 0, 10, 10, 12), (2, 4, 9, 2, 6), (3, 5, 5, 0, 9), (4, 2, 8, 2, 8), (5, 3, 4, 0, 100)]


@query("range_predicates", f"SELECT CAST(id AS BIGINT) AS id, a < d2 AND c < b AS overlaps, a <= c AND d2 <= b AS contains, a <= d2 AND c <= b AS overlaps_inclusive FROM (SELECT id, lo1 AS a, hi1 AS b, lo2 AS c, hi2 AS d2 FROM {values(SPANS, 'id', 'lo1', 'hi1', 'lo2', 'hi2')})")
def range_predicates(spark, d):
    rows = spark.sql(f"SELECT * FROM {values(SPANS, 'id', 'lo1', 'hi1', 'lo2', 'hi2')}")
    a, b = ((F.col(f"lo{k}"), F.col(f"hi{k}")) for k in (1, 2))
    return rows.select(F.col("id").cast("long").alias("id"), ranges.overlaps(a, b).alias("overlaps"), ranges.contains(a, b).alias("contains"), ranges.extents_overlap(a, b).alias("overlaps_inclusive"))


# -- Morton codes -----------------------------------------------------------------------------------


@query("zorder_encode2", f"WITH {LINES} SELECT DISTINCT x, y, {interleave('x', 'y')} AS code FROM p")
def zorder_encode2(spark, d):
    return line_points(spark, d).select("x", "y").distinct().withColumn("code", zorder.encode2(F.col("x"), F.col("y")))


@query("zorder_encode3", f"WITH q AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS z FROM lineitem) SELECT x, y, z, {interleave('x', 'y', 'z')} AS code FROM q")
def zorder_encode3(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("long").alias("z")).distinct()
    return rows.withColumn("code", zorder.encode3(F.col("x"), F.col("y"), F.col("z")))


def every_bit(c: str, n: int, d: int) -> str:
    width = 16 if n == 2 else 10
    return f"CAST(list_sum(list_transform(range(0, {width}), lambda i: (({c} >> CAST({n} * i + {d} AS INT)) & 1) << CAST(i AS INT))) AS BIGINT)"


CODES = "c AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 AS code FROM events)"


@query("zorder_decode2", f"WITH {CODES} SELECT id, {every_bit('code', 2, 0)} AS x, {every_bit('code', 2, 1)} AS y FROM c")
def zorder_decode2(spark, d):
    x, y = zorder.decode2(F.col("pos") * 2654435761 % 4294967296)
    return event_users(spark, d).select(F.col("pos").alias("id"), x.alias("x"), y.alias("y"))


@query("zorder_decode3", f"WITH {CODES} SELECT id, {every_bit('code', 3, 0)} AS x, {every_bit('code', 3, 1)} AS y, {every_bit('code', 3, 2)} AS z FROM c")
def zorder_decode3(spark, d):
    x, y, z = zorder.decode3(F.col("pos") * 2654435761 % 4294967296)
    return event_users(spark, d).select(F.col("pos").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))


@query("zorder_dim_mask", "SELECT CAST(dim AS BIGINT) AS dim, CAST(dims AS BIGINT) AS dims, CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN i % dims = dim THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE 0 END)) AS BIGINT) AS mask FROM range(1, 9) AS a(dims), range(0, 8) AS b(dim) WHERE dim < dims")
def zorder_dim_mask(spark, d):
    rows = [(k, dims, zorder.dim_mask(k, dims)) for dims in range(1, 9) for k in range(dims)]
    return spark.createDataFrame(rows, "dim long, dims long, mask long")


GRID = "g AS (SELECT CAST(a.v AS BIGINT) AS x, CAST(b.v AS BIGINT) AS y FROM range(0, 16) AS a(v), range(0, 16) AS b(v)), gc AS (SELECT x, y, {code} AS code FROM g)".replace("{code}", interleave("x", "y"))
CUTS = [(0, 1, 2, 6, 9, 20), (1, 0, 0, 15, 15, 77), (2, 5, 3, 9, 12, 60), (3, 2, 7, 13, 8, 130), (4, 4, 4, 7, 7, 49), (5, 0, 5, 15, 6, 100), (6, 3, 0, 3, 15, 33), (7, 1, 1, 14, 14, 191)]
CUT = f"q AS (SELECT CAST(id AS BIGINT) AS id, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(div AS BIGINT) AS div FROM {values(CUTS, 'id', 'x0', 'y0', 'x1', 'y1', 'div')})"
BOX = "gc.x BETWEEN q.x0 AND q.x1 AND gc.y BETWEEN q.y0 AND q.y1"


def _cuts(spark):
    q = spark.sql(f"WITH {CUT} SELECT * FROM q")
    return q, zorder.encode2(F.col("x0"), F.col("y0")), zorder.encode2(F.col("x1"), F.col("y1"))


@query("zorder_litmax", f"WITH {GRID}, {CUT} SELECT q.id, max(gc.code) AS litmax FROM q LEFT JOIN gc ON {BOX} AND gc.code < q.div GROUP BY q.id")
def zorder_litmax(spark, d):
    q, low, high = _cuts(spark)
    return q.select("id", zorder.litmax(low, high, F.col("div")).alias("litmax"))


@query("zorder_bigmin", f"WITH {GRID}, {CUT} SELECT q.id, min(gc.code) AS bigmin FROM q LEFT JOIN gc ON {BOX} AND gc.code > q.div GROUP BY q.id")
def zorder_bigmin(spark, d):
    q, low, high = _cuts(spark)
    return q.select("id", zorder.bigmin(low, high, F.col("div")).alias("bigmin"))


#: the halves of a box: codes with a clear and a set bit where the corners first differ
SPLIT = f"""WITH {GRID}, {CUT}, k AS (SELECT q.*, {interleave('x0', 'y0')} AS lo, {interleave('x1', 'y1')} AS hi FROM q), t AS (SELECT *, CAST(1 AS BIGINT) << CAST(length(bin(xor(lo, hi))) - 1 AS INT) AS top FROM k)
SELECT q.id, max(gc.code) FILTER (WHERE gc.code & q.top = 0) AS litmax, min(gc.code) FILTER (WHERE gc.code & q.top <> 0) AS bigmin FROM t AS q JOIN gc ON {BOX} GROUP BY q.id"""


@query("zorder_litmax_bigmin_2d", SPLIT)
def zorder_litmax_bigmin_2d(spark, d):
    q, low, high = _cuts(spark)
    a, b = zorder.split_at(low, high)
    return q.select("id", a.alias("litmax"), b.alias("bigmin"))


@query("zorder_bbox", f"WITH {CUT} SELECT id, x1 - x0 + 1 AS width, y1 - y0 + 1 AS height, TRUE AS well_formed, {interleave('x1', 'y1')} - {interleave('x0', 'y0')} < (x1 - x0 + 1) * (y1 - y0 + 1) AS one_run FROM q")
def zorder_bbox(spark, d):
    q, low, high = _cuts(spark)
    w, h = zorder.box_size(low, high)
    return q.select("id", w.alias("width"), h.alias("height"), zorder.well_formed(low, high).alias("well_formed"), zorder.range_is_box(low, high).alias("one_run"))


@query("zorder_split_bbox", f"WITH {GRID}, {CUT}, c AS (SELECT q.id, gc.code, gc.code - row_number() OVER (PARTITION BY q.id ORDER BY gc.code) AS g FROM q JOIN gc ON {BOX}) SELECT id AS box, min(code) AS lo, max(code) AS hi FROM c GROUP BY id, g")
def zorder_split_bbox(spark, d):
    q, low, high = _cuts(spark)
    return zorder.split_boxes(q.select(F.col("id").alias("box"), low.alias("low"), high.alias("high")))


# -- integer codes ----------------------------------------------------------------------------------


@query("bic_roundtrip", "WITH k AS (SELECT o_custkey AS id, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT id, count(*) AS n, CAST(sum(k - coalesce(b, -1)) AS BIGINT) AS total FROM k GROUP BY id")
def bic_roundtrip(spark, d):
    back = customer_gaps(spark, d).select("id", decode_column(encode_column(F.col("values"))).alias("v"), "values")
    same = F.when(F.col("v") == F.col("values"), F.col("v")).otherwise(F.raise_error(F.lit("a list changed in the round trip")))
    return back.select("id", F.size(same).cast("long").alias("n"), F.aggregate(same, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


#: the tree of partial sums, built from its last node to the first (node j stands at j - p + 1 when p is next), and the bits of its codes
BIC_SIZE = """WITH RECURSIVE k AS (SELECT o_custkey AS id, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS v, o_orderkey AS o FROM orders),
l AS (SELECT id, count(*) AS n, list(CAST(v AS BIGINT) ORDER BY o) AS t FROM k GROUP BY id),
r AS (SELECT id, n, t, n - 2 AS p FROM l UNION ALL SELECT id, n, [t[p + 1] + t[p + 2] - 1] || t, p - 1 FROM r WHERE p >= 0),
done AS (SELECT id, n, t FROM r WHERE p = -1),
b AS (SELECT id, n, t, list_transform(range(0, n - 1), lambda p: struct_pack(r := t[p + 1], x := CASE WHEN t[2 * p + 3] >= t[2 * p + 2] THEN t[2 * p + 3] - t[2 * p + 2] + 1 ELSE t[2 * p + 2] - t[2 * p + 3] END)) AS c FROM done),
w AS (SELECT id, n, 2 * (length(bin(n)) - 1) + 1 + 2 * (length(bin(t[1])) - 1) + 1 AS head, list_transform(c, lambda e: length(bin(e.r)) - 1 + CASE WHEN e.x - 1 < (CAST(1 AS BIGINT) << CAST(length(bin(e.r)) AS INT)) - e.r THEN 0 ELSE 1 END) AS c FROM b)
SELECT id, n, CAST((head + coalesce(list_sum(c), 0) + 7) // 8 AS BIGINT) AS bytes FROM w"""


@query("bic_size", BIC_SIZE)
def bic_size(spark, d):
    return customer_gaps(spark, d).select("id", F.size("values").cast("long").alias("n"), F.octet_length(encode_column(F.col("values"))).cast("long").alias("bytes"))


@query("bic_mapping", "SELECT vl, vr, vl + vr - 1 AS parent, CASE WHEN vl <= vr THEN vr - vl + 1 ELSE vl - vr END AS rank, vl AS back FROM range(1, 40) AS a(vl), range(1, 40) AS b(vr)")
def bic_mapping(spark, d):
    rows = [(x, y, x + y - 1, mapped(x, y), unmapped(mapped(x, y), x + y - 1)) for x in range(1, 40) for y in range(1, 40)]
    return spark.createDataFrame(rows, "vl long, vr long, parent long, rank long, back long")


@query("gamma_length", "SELECT o_orderkey AS id, CAST(2 * (length(bin(o_custkey + 1)) - 1) + 1 AS BIGINT) AS bits FROM orders")
def gamma_length(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), bitmath.gamma_bits(F.col("o_custkey") + 1).alias("bits"))


# -- histograms -------------------------------------------------------------------------------------

A, B = 1, 4
C = A + B + 1
CENTS = "v AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"
LOG = "(length(bin(greatest(v, 1))) - 1)"


def bin_sql(v: str = "v") -> str:
    log = LOG.replace("v, 1", f"{v}, 1")
    return f"CASE WHEN {v} < {1 << C} THEN {v} >> {A} ELSE (2 + {log} - {C}) * {1 << B} + CAST(floor(({v} - pow(2, {log})) / pow(2, {log} - {B})) AS BIGINT) END"


H2 = f"{CENTS}, h AS (SELECT {bin_sql()} AS bin, count(*) AS cnt FROM v GROUP BY 1), hc AS (SELECT bin, cnt, CAST(sum(cnt) OVER (ORDER BY bin) AS BIGINT) AS cum FROM h)"


def _prices(spark, d):
    return hist.histogram(table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("v")), A, B)


@query("h2_histogram", f"WITH {H2} SELECT * FROM hc")
def h2_histogram(spark, d):
    return _prices(spark, d)


CDF_ROWS = [(0, 0), (1, 63), (2, 64), (3, 5000), (4, 1000000), (5, 3000000), (6, 9000000), (7, 400000000)]


@query("h2_cdf", f"WITH {H2}, q AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(w AS BIGINT) AS w FROM {values(CDF_ROWS, 'qid', 'w')}) SELECT qid, CAST(coalesce((SELECT sum(cnt) FROM h WHERE h.bin <= {bin_sql('q.w')}), 0) AS BIGINT) AS cum, CAST(coalesce((SELECT sum(cnt) FROM h WHERE h.bin <= {bin_sql('q.w')}), 0) AS DOUBLE) / (SELECT sum(cnt) FROM h) AS cdf FROM q")
def h2_cdf(spark, d):
    q = spark.sql(f"SELECT CAST(qid AS BIGINT) AS qid, CAST(w AS BIGINT) AS v FROM {values(CDF_ROWS, 'qid', 'w')}")
    return hist.cumulative(_prices(spark, d), q, A, B).select("qid", "cum", "cdf")


P_ROWS = [(0, "0.0"), (1, "0.1"), (2, "0.25"), (3, "0.5"), (4, "0.9"), (5, "0.99"), (6, "1.0")]


@query("h2_quantile", f"WITH {H2}, q AS (SELECT CAST(qid AS BIGINT) AS qid, CAST(p AS DOUBLE) AS p FROM {values(P_ROWS, 'qid', 'p')}), w AS (SELECT qid, greatest(CAST(ceil(p * (SELECT sum(cnt) FROM h)) AS BIGINT), 1) AS want FROM q), b AS (SELECT w.qid, min(hc.bin) AS bin FROM w JOIN hc ON hc.cum >= w.want GROUP BY w.qid) SELECT qid, bin, (SELECT min(t) FROM (SELECT (bin // {1 << B} - 2 + {C}) AS lg) AS x, LATERAL (SELECT CAST(pow(2, lg) + (bin % {1 << B}) * pow(2, lg - {B}) AS BIGINT) AS t)) AS low FROM b")
def h2_quantile(spark, d):
    q = spark.sql(f"SELECT CAST(qid AS BIGINT) AS qid, CAST(p AS DOUBLE) AS p FROM {values(P_ROWS, 'qid', 'p')}")
    return hist.quantiles(_prices(spark, d), q, A, B).select("qid", "bin", "low")


@query("h2_bins", f"WITH v AS (SELECT CAST(i AS BIGINT) AS v FROM range(0, 5000) AS t(i)), b AS (SELECT {bin_sql()} AS bin, v FROM v) SELECT bin, min(v) AS low, max(v) AS high, max(v) - min(v) + 1 AS width FROM b GROUP BY bin HAVING max(v) < 4095")
def h2_bins(spark, d):
    last = h2.num_bins(A, B, 12) - 1
    bins = spark.range(0, last).select(F.col("id").alias("bin"))
    low, high = h2.lowest(F.col("bin"), A, B), h2.highest(F.col("bin"), A, B)
    return bins.select("bin", low.alias("low"), high.alias("high"), (high - low + 1).alias("width"))


# -- spatial tables ---------------------------------------------------------------------------------

AREAS = [(0, 1, 10, 0, 20), (1, 5, 50, 3, 3), (2, 50, 50, 0, 10000)]
AREA = f"bx AS (SELECT CAST(box AS BIGINT) AS box, x0, x1, y0, y1 FROM {values(AREAS, 'box', 'x0', 'x1', 'y0', 'y1')})"


@query("spatial_ids_for_bbox", f"WITH {LINES}, {AREA} SELECT bx.box, p.id, count(*) AS cnt FROM bx JOIN p ON p.x BETWEEN bx.x0 AND bx.x1 AND p.y BETWEEN bx.y0 AND bx.y1 GROUP BY bx.box, p.id")
def spatial_ids_for_bbox(spark, d):
    return spatial.ids_in_box(line_points(spark, d), spark.sql(f"WITH {AREA} SELECT * FROM bx"))


@query("spatial_counts_for_ids", f"WITH {LINES} SELECT {interleave('x', 'y')} AS code, count(*) AS cnt FROM p WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def spatial_counts_for_ids(spark, d):
    return spatial.cells_of_ids(line_points(spark, d), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")))


@query("spatial_counts", f"WITH {LINES} SELECT ({interleave('x', 'y')} >> 4) << 4 AS code, count(*) AS cnt FROM p GROUP BY 1")
def spatial_counts(spark, d):
    return spatial.cells(line_points(spark, d), 4)
