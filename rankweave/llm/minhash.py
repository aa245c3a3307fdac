"""Near-duplicate components: one-permutation MinHash, banded buckets, star edges, exact confirmation.

Plan (every step distributed; nothing about documents reaches the driver but row counts):

1. one pass over the texts: shingle-set size, set fingerprint and band keys (narrow table);
2. equal sets collapse to one *class* (its smallest id), so copies never meet as pairs;
3. band keys of the classes are bucketed; each bucket of n emits n-1 *star* pairs (its smallest id, the
   hub, with each other member), so pairs grow with documents, never with the square of a bucket;
4. pairs are confirmed on full shingle sets: the hub's set stays in memory while its members' sets pass
   by, sorted by hub; a hub with very many members is dealt over several tasks. Confirmed pairs give
   components;
5. a bucket whose other members still lie in several components may hide links that its hub did not see.
   The hub has met everybody and leaves, the next smallest id becomes the hub of a new star. ``STARS``
   rounds settle every bucket of up to ``STARS + 1`` members;
6. what is still open after that are large buckets. There, and only within a bucket, members outside the
   bucket's largest component are compared with all members of other components, in blocks bounded in
   shingles and rows that emit confirmed links only. So no banded link is lost.

With 50 bands of 5 rows a pair at the threshold 0.8 shares no bucket with probability 3e-9; one of
similarity 0.3 does with probability 0.11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import connected_components
from rankweave.llm.minhash_kernel import band_keys, probe_order, set_fingerprints, shingle_sets, signatures
from rankweave.llm.prefilter import perhaps
from rankweave.llm.scratch import Scratch
from rankweave.llm.textcore import pieces

SIGNED = "<i8"
#: Rounds of stars before large open buckets are compared in blocks.
STARS = 3
#: Members that one task compares with a copy of their hub's set.
STAR_ROWS = 1_000
#: Shingles and rows per block of open buckets, and of the members that ask.
BLOCK_SHINGLES, BLOCK_ROWS = 400_000, 1_000
#: Owners up to which a shingle of a block is handled by pairs of owners; columns of the matrix for the rest.
FEW_OWNERS, MATRIX_COLUMNS = 6, 2_048


def _signature_pass(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = 1 << (bands * rows - 1).bit_length()
        probes = probe_order(slots)
        for batch in batches:
            for piece in pieces(batch.column(1)):
                sets = shingle_sets(piece, width)
                keys = band_keys(signatures(sets, slots, probes), bands, rows)
                f1, f2 = set_fingerprints(sets)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                flat = pa.array(keys.reshape(-1).view(SIGNED))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)), pa.array(size), pa.array(f1.view(SIGNED)), pa.array(f2.view(SIGNED)), lists],
                    names=["id", "n_shingles", "f1", "f2", "keys"],
                )

    return run


def _set_pass(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                sets = shingle_sets(piece, width)
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(SIGNED) if len(sets) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "s"])

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _star_links(percent: int):
    """(hub, part, role, id, s), sorted -> confirmed links; role 0 brings a set of the hub, role 1 a member's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            hub, part, role, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            hit = np.zeros(len(hub), dtype=bool)
            for k in range(len(hub)):
                own = values[edges[k] : edges[k + 1]]
                if role[k]:
                    hit[k] = any(100 * (both := _shared(own, h)) >= percent * (len(own) + len(h) - both) for h in held)
                else:
                    if now != (hub[k], part[k]):
                        now, held = (hub[k], part[k]), []
                    held.append(own.copy())
            yield pa.RecordBatch.from_arrays([pa.array(hub[hit]), pa.array(member[hit])], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(hub, id)`` that reach the threshold on full sets, as ``(a, b)``."""
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    part = F.expr("cast(pmod(xxhash64(id), parts) as int)")
    members = pairs.join(load, "hub").select("hub", part.alias("part"), F.lit(1).alias("role"), "id")
    hubs = load.select("hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("id"))
    rows = members.union(hubs).join(sets, "id").select("hub", "part", "role", "id", "s")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(_star_links(percent), "a long, b long")


def _overlaps(sets: list[np.ndarray], asks: int) -> np.ndarray:
    """Common entries of each of the first ``asks`` sets with each of the others."""
    n = len(sets) - asks
    tokens, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((asks, n), dtype=np.float32)
    # entries that few sets share: pairs along their lists of owners
    few = (many[at] > 1) & (many[at] <= FEW_OWNERS)
    order = np.lexsort((owner[few], at[few]))
    token, who = at[few][order], owner[few][order]
    for step in range(1, FEW_OWNERS):
        both = np.flatnonzero(token[step:] == token[: len(token) - step])
        x, y = who[both], who[both + step]  # ascending: x asks or none of the two does
        met = (x < asks) & (y >= asks)
        np.add.at(out, (x[met], y[met] - asks), 1)
    # all others: columns of a 0/1 matrix, some at a time
    common = np.flatnonzero(many > FEW_OWNERS)
    place = np.full(len(tokens), -1)
    place[common] = np.arange(len(common))
    wide = np.flatnonzero(place[at] >= 0)
    wide = wide[np.argsort(place[at[wide]], kind="stable")]
    column = place[at[wide]]
    for first in range(0, len(common), MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + MATRIX_COLUMNS))
        held = np.zeros((len(sets), min(MATRIX_COLUMNS, len(common) - first)), dtype=np.float32)
        held[owner[wide[lo:hi]], column[lo:hi] - first] = 1
        out += held[:asks] @ held[asks:].T
    return out.astype(np.int64)


def _block_links(percent: int):
    """Confirmed links of asking rows (kind 0) with data rows (kind 1) of one block of a bucket: one for each
    component that an asking row reaches."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("kind", kind="stable")
        asks = int((group.kind == 0).sum())
        if not 0 < asks < len(group):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids, comp, size = group.id.to_numpy(), group.comp.to_numpy(), np.array([len(s) for s in group.s])
        both = _overlaps(group.s.to_list(), asks)
        linked = (comp[:asks, None] != comp[None, asks:]) & (100 * both >= percent * (size[:asks, None] + size[None, asks:] - both))
        x, y = np.nonzero(linked)
        _, one = np.unique(np.column_stack((x, comp[asks:][y])), axis=0, return_index=True)
        return pd.DataFrame({"a": ids[x[one]], "b": ids[asks:][y[one]]})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 50, rows: int = 5) -> DataFrame:
    """``(id_col, n_shingles, class_id, component_id, kept)`` per document.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``width``-word shingles (ASCII letters lowered; a shorter text is one shingle of all its words).

    * null, empty or wordless text: empty set, linked with nothing, kept;
    * very long texts are taken whole, one at a time;
    * equal sets: one class, one component; ``kept`` marks the smallest id of a component;
    * null id: cannot name a component - the row is returned with a null component and kept true;
    * rows that repeat an id: one row each; the id counts as one document holding any of those sets;
    * an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.keep(texts.mapInArrow(_signature_pass(width, bands, rows), "id long, n_shingles long, f1 long, f2 long, keys array<long>"), "signatures")

    real = sig.where("n_shingles > 0 AND id IS NOT NULL")
    own = ["f1", "f2", "n_shingles"]
    classes = scratch.keep(real.groupBy(*own).agg(F.min(F.struct("id", "keys")).alias("r")).select(*own, F.col("r.id").alias("class_id"), F.col("r.keys").alias("keys")), "classes")

    seats = classes.select(F.col("class_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    hubs = seats.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = scratch.keep(hubs.select("key", "hub"), "hubs")  # a table of its own: a join with it can split hot keys
    seats = scratch.keep(seats.join(hubs, "key").select("key", "id", "n", F.col("id").alias("comp"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.id").alias("hub_comp")), "seats-0")
    wanted = seats.select("id").distinct()
    near = perhaps(texts, F.col("id"), wanted, F.col("id"), "near").where("near").select("id", "text")  # most others are never shuffled
    sets = scratch.keep(near.join(wanted, "id", "left_semi").mapInArrow(_set_pass(width), "id long, s array<long>"), "sets")
    scratch.release()

    forest, tested = None, None
    for turn in range(STARS):
        # a pair whose sizes alone rule the threshold out is dropped before its sets are fetched
        pairs = seats.where(f"comp <> hub_comp AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("hub", "id").distinct()
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["hub", "id"], "left_anti"), f"pairs-{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        links = _confirmed(pairs, sets, percent)
        edges = links if forest is None else links.union(forest.select(F.col("id").alias("a"), F.col("component").alias("b")))
        forest = connected_components(scratch.keep(edges, f"links-{turn}"), scratch, f"components-{turn}")
        rest = seats.where("id > hub").select("key", "id", "n").join(forest, "id", "left").withColumn("comp", F.coalesce("component", "id"))
        still = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("id", "n", "comp")).alias("hub")).where("lo <> hi")
        still = scratch.keep(still.select("key", "hub"), f"hubs-{turn + 1}")
        seats = scratch.keep(rest.join(still, "key").select("key", "id", "n", "comp", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.comp").alias("hub_comp")), f"seats-{turn + 1}")
        scratch.drop(f"seats-{turn}", f"links-{turn}")
        scratch.release()
        if seats.isEmpty():
            break

    extra = _open_bucket_links(seats, sets, percent, scratch)
    # ids that carry several different sets tie their classes together
    several = real.groupBy("id").agg(F.min(F.struct(*own)).alias("lo"), F.max(F.struct(*own)).alias("hi")).where("lo <> hi").select("id")
    held = real.join(several, "id").join(classes.select(*own, "class_id"), own)
    many = held.select(F.col("id").alias("a"), F.col("class_id").alias("b"))
    edges = forest.select(F.col("id").alias("a"), F.col("component").alias("b")).union(extra).union(many)
    final = connected_components(scratch.keep(edges, "edges"), scratch, "components")

    named = classes.join(final, classes.class_id == final.id, "left").select("f1", "f2", F.col("n_shingles").alias("n"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = sig.join(named, (sig.f1 == named.f1) & (sig.f2 == named.f2) & (sig.n_shingles == named.n) & sig.id.isNotNull(), "left")
    component = F.coalesce(named.component_id, sig.id)
    result = out.select(
        sig.id.alias(id_col), sig.n_shingles, F.coalesce(named.class_id, sig.id).alias("class_id"), component.alias("component_id"), F.coalesce(component == sig.id, F.lit(True)).alias("kept")
    )
    scratch.drop("sets", "edges", "shape")
    return result


def _open_bucket_links(seats: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Step 6 of the plan: links inside buckets that hold several components, compared in blocks."""
    weight = seats.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    main = F.max(F.struct("c", "comp", "w"))
    blocks = lambda w, c: F.greatest(F.ceil(w / BLOCK_SHINGLES), F.ceil(c / BLOCK_ROWS), F.lit(1)).cast("int")
    shape = weight.groupBy("key").agg(
        main.getField("comp").alias("main"), blocks(F.sum("w"), F.sum("c")).alias("blocks"), blocks(F.sum("w") - main.getField("w"), F.sum("c") - main.getField("c")).alias("ask_blocks")
    )
    shape = scratch.keep(shape, "shape")
    seat = seats.select("key", "id", "comp").join(shape, "key").withColumn("h", F.xxhash64("id"))
    data = seat.select("key", "id", "comp", F.lit(1).alias("kind"), F.expr("pmod(h, blocks)").cast("int").alias("block"), F.explode(F.expr("sequence(0, ask_blocks - 1)")).alias("ask"))
    asks = seat.where("comp <> main").select("key", "id", "comp", F.lit(0).alias("kind"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.expr("pmod(h, ask_blocks)").cast("int").alias("ask"))
    rows = data.union(asks).join(sets, "id")
    return rows.groupBy("key", "block", "ask").applyInPandas(_block_links(percent), "a long, b long")
