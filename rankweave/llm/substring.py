"""Repeated word windows found by recompression, confirmed window by window.

A window is ``WINDOW`` consecutive words of one text; it repeats when the same word sequence starts
anywhere else, in the same text or another. Comparing all windows would shuffle a row per word of the
corpus, so most are ruled out first:

1. *Recompression* (module ``recompress``) names runs and pairs of symbols step by step. Every window has a
   representative: the longest symbol that is certain to be the same in all its occurrences.
2. *Reveal, in Spark rounds.* A round counts the names of the representatives over the whole corpus. A
   window whose representative occurs once cannot repeat and is closed; the next round parses the texts
   that still have open windows with longer symbols (``CAPS``) and names the representatives of open
   windows only. About one word in ten of an open stretch starts a representative.
3. *Verify.* Windows that are still open are compared by 128-bit digests of their full word sequences.

Each round is one shuffle by name and one join of the texts with what stays open; texts that surely have no
open window are told apart before it. Hot names and windows:
equal keys within a stretch of a task are merged before the shuffle into one evidence row, and their places
follow as one list per text, dealt by the text, so a key arrives at most once per batch, not once per
document. Tables are keyed by text, not by row: copies share one entry. Names have 58 bits and the
length; a clash only leaves a window open. Verification uses 128 bits, text identity 98.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.prefilter import perhaps
from rankweave.llm.recompress import Represented, represent
from rankweave.llm.scratch import Scratch, free_names
from rankweave.llm.textcore import Piece, find_words, gram_hashes, mix, pieces, word_hashes

WINDOW = 35
#: Longest symbols of each round, in words.
CAPS = (8, 24)
PLACE_BITS = 30
#: Rows of a task that are searched for equal keys before they are shuffled (some 30 MB).
COMBINED = 1_000_000


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _once(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal keys: a mask of rows that are alone, and the index of one row of each other group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    alone = np.zeros(len(order), dtype=bool)
    alone[order[first[n == 1]]] = True
    return alone, order[first[n > 1]]


def _gathered(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns joined until there are COMBINED rows: equal keys among them are merged before the shuffle."""
    held, n = [], 0
    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= COMBINED:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _evidence(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys..., t1, t2, pos) -> (keys..., t1, spot, settled).

    A key that the stretch holds once is a row of its own. Of others one evidence row (null t1) goes out, and
    their places follow as one list per text (settled), under keys made of the text.
    """
    null = lambda size, kind=pa.int64(): pa.nulls(size, kind)
    for columns in _gathered(found):
        *keys, t1, t2, pos = columns
        alone, known = _once(*keys)
        some, more = np.flatnonzero(alone), np.flatnonzero(~alone)
        more = more[np.lexsort((pos[more], t2[more], t1[more]))]
        other = np.ones(len(more), dtype=bool)
        other[1:] = (t1[more][1:] != t1[more][:-1]) | (t2[more][1:] != t2[more][:-1])
        fresh = other.copy()  # copies of a text in the stretch settle the same places
        fresh[1:] |= pos[more][1:] != pos[more][:-1]
        more, other = more[fresh], other[fresh]
        first = np.flatnonzero(other)
        n, k, t = len(some), len(known), len(first)
        own = [t1[more][first], t2[more][first]]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(more)).astype(np.int32)), pa.array(pos[more].astype(np.int32))) if t else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.concat_arrays([pa.array(key[some]), pa.array(key[known]), pa.array(own[j])]) for j, key in enumerate(keys)),
                pa.concat_arrays([pa.array(t1[some]), null(k), pa.array(own[0])]),
                pa.concat_arrays([pa.array(t2[some] | pos[some]), null(k), pa.array(own[1])]),
                pa.concat_arrays([null(n + k, pa.list_(pa.int32())), lists]),
            ],
            names=[*names, "t1", "spot", "settled"],
        )


def _opened(r: Represented, places: np.ndarray) -> np.ndarray:
    """Window starts whose representative starts at one of the places (and perhaps some more)."""
    known = np.zeros(len(r.of), dtype=bool)
    known[places] = True
    hit = known[r.chosen.start]
    step = np.zeros(len(r.of) + 1, dtype=np.int32)
    np.add.at(step, r.a[hit], 1)
    np.add.at(step, r.b[hit] + 1, -1)
    return (np.cumsum(step[:-1]) > 0) & np.isin(r.of, r.chosen.key()[hit])


def _around(places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all windows that hold one of the places, and the bounds of their stretches among them.

    What represents a window depends on its own words only, so a stretch may be parsed as a text of its own.
    """
    owner = np.searchsorted(bounds, places, side="right") - 1
    step = np.zeros(bounds[-1] + 1, dtype=np.int32)
    np.add.at(step, np.maximum(places - WINDOW + 1, bounds[:-1][owner]), 1)
    np.add.at(step, np.minimum(places + WINDOW, bounds[1:][owner]), -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    text = np.searchsorted(bounds, kept, side="right")
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (np.diff(kept) > 1) | (text[1:] != text[:-1])
    return kept, np.append(np.flatnonzero(new), len(kept))


def _pass(names: list[str], look: Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[list[np.ndarray], np.ndarray]]):
    """(t1, t2, text[, places]) -> evidence; look: word hashes, text bounds and open places -> (keys, word numbers)."""
    mask = np.int64(-1 << PLACE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                t1, t2 = _longs(batch.column(0)), _longs(batch.column(1)) & mask
                for piece in pieces(batch.column(2)):
                    words = find_words(piece)
                    if batch.num_columns > 3:
                        edges = batch.column(3).offsets.to_numpy()[piece.first : piece.first + len(piece) + 1].astype(np.int64)
                        places = batch.column(3).values.to_numpy()[edges[0] : edges[-1]] + np.repeat(words.first[:-1], np.diff(edges))
                        kept, bounds = _around(places, words.first)
                        keys, at = look(word_hashes(piece.data, words.starts[kept], words.ends[kept]), bounds, np.searchsorted(kept, places))
                        at = kept[at]
                    else:
                        keys, at = look(word_hashes(piece.data, words.starts, words.ends), words.first, None)
                    owner = np.searchsorted(words.first, at, side="right") - 1
                    yield *(k.view(np.int64) for k in keys), t1[piece.first + owner], t2[piece.first + owner], at - words.first[owner]

        yield from _evidence(found(), names)

    return run


def _names(turn: int):
    """Names of the representatives of all windows (turn 0) or of those left open by the turn before."""

    def look(h: np.ndarray, bounds: np.ndarray, places: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        opened = None if places is None else _opened(represent(h, bounds, WINDOW, CAPS[turn - 1]), places)
        r = represent(h, bounds, WINDOW, CAPS[turn], opened)
        return [r.chosen.key()], r.chosen.start.astype(np.int64)

    return look


def _digests(h: np.ndarray, bounds: np.ndarray, places: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Digests of the windows that the last turn left open."""
    start = np.flatnonzero(_opened(represent(h, bounds, WINDOW, CAPS[-1]), places))
    if not len(start):
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64)], start
    return [gram_hashes(h, WINDOW)[start], gram_hashes(mix(h + np.uint64(0x2545F4914F6CDD1D)), WINDOW, odd=0xD1342543DE82EF95)[start]], start


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's n words lie in a window that starts at one of starts."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


def _repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(t1, t2, places)``: the places whose keys more than one row carries, or that were settled before."""
    held = rows.withColumn("n", F.count("*").over(Window.partitionBy(*names))).where("t1 IS NOT NULL AND (n > 1 OR settled IS NOT NULL)")
    own = F.array(F.col("spot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    single = held.select("t1", F.shiftright("spot", PLACE_BITS).alias("t2"), F.explode(F.coalesce("settled", own)).alias("pos"))
    return single.groupBy("t1", "t2").agg(F.collect_set("pos").alias("places"))


def repeated_windows(docs: DataFrame, scratch: Scratch, text_col: str) -> DataFrame:
    """``(t1, t2, places)``: for each distinct text with repeated windows, where they start (word numbers)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), text.alias("text"))
    rows, kept = texts, None
    for turn in range(len(CAPS) + 1):
        names = ["name"] if turn < len(CAPS) else ["f1", "f2"]
        look = _names(turn) if turn < len(CAPS) else _digests
        found = rows.mapInArrow(_pass(names, look), "".join(f"{k} long, " for k in names) + "t1 long, spot long, settled array<int>")
        kept = scratch.keep(_repeated(found, names), f"open-{turn}")
        if turn:
            scratch.drop(f"open-{turn - 1}")
        scratch.release()
        if turn == len(CAPS):
            break
        again = kept.withColumnsRenamed({"t1": "o1", "t2": "o2"})
        near = perhaps(texts, F.col("t1"), kept, F.col("t1"), "near").where("near").select("t1", "t2", "text")  # others are never shuffled
        rows = near.withColumn("low", F.shiftright("t2", PLACE_BITS)).join(again, (F.col("t1") == F.col("o1")) & (F.col("low") == F.col("o2")))
        if not turn:  # texts without open windows are not shuffled again
            rows = scratch.keep(rows.select("t1", "t2", "text", "places"), "texts")
            texts = rows.drop("places")
            scratch.release()
        rows = rows.select("t1", "t2", "text", "places")
    scratch.drop("texts")
    return kept


def _with_starts(docs: DataFrame, text_col: str, starts: DataFrame, out: str) -> DataFrame:
    """docs and the column ``out`` of window starts, null where there are none; only rows whose text may have some
    are shuffled. Each row of docs travels in one column, so no name can clash."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(text).alias("t1"), F.shiftright(F.xxhash64(F.lit("text"), text), PLACE_BITS).alias("t2"))
    rows = perhaps(rows, F.col("t1"), starts, F.col("t1"), "near")
    found = rows.where("near").join(starts, ["t1", "t2"], "left").select("row", "places")
    both = found.unionByName(rows.where("NOT near").select("row"), allowMissingColumns=True)
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("places").alias(out))


def _starts_of(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None else np.array(x, dtype=np.int64) for x in column.to_pylist()]


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256)``: every word in a repeated window is removed.

    Null, empty and short texts lose nothing; very long texts are handled whole; ids may be null or repeat
    (rows stand for themselves, and equal texts repeat each other); other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    starts = repeated_windows(docs, scratch, text_col)
    rows = _with_starts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", starts, "starts").select("id", F.coalesce(F.col("text").cast("string"), F.lit("")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, gone, sha = [], [], []
                for text, cuts in zip(part.column(1).to_pylist(), _starts_of(part.column(2)), strict=True):
                    words = text.encode().split()
                    n.append(len(words))
                    gone.append(0)
                    if cuts is not None:
                        out = _covered(cuts, len(words))
                        gone[-1] = int(out.sum())
                        words = [words[k] for k in np.flatnonzero(~out)]
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, starts: np.ndarray) -> str:
    """text without the words covered by windows at starts; what stands between kept words is unchanged."""
    data = text.encode()
    piece = Piece(0, np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    words = find_words(piece)
    out = _covered(starts, len(words))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
    kept, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        kept.append(data[at : words.starts[a]])
        at = words.starts[b] if b < len(words) else words.ends[-1]
    return b"".join([*kept, data[at:]]).decode()


def remove_repeats(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with repeated windows cut out of the text; all rows and columns stay, untouched texts exactly.

    A null text stays null; other columns pass through, whatever their names; the other cases are as in
    ``removal_digests``.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    names = docs.columns
    at = names.index(text_col)
    rows = _with_starts(docs, text_col, repeated_windows(docs, scratch, text_col), free_names(names, "starts")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, cuts = batch.columns
            cuts = _starts_of(cuts)
            texts = columns[at].to_pylist()
            columns[at] = pa.array([t if c is None or t is None else cut_text(t, c) for t, c in zip(texts, cuts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
