"""Toxic spans by a linear-chain conditional random field with two labels.

Labels come per document, so tokens are labelled first: a word, or the beginning of a word, that occurs
in several toxic and (almost) no other labelled documents marks its tokens in toxic documents as toxic;
all other tokens are clean. Those documents are counted over all labelled rows, by 64-bit hashes. The
field is fitted on the tokens of a bounded sample; its emission sums hashed features of the word and its
beginnings and one feature for being marked, by which marked words outside the sample are known; its
transitions are learned with them. Marginals of every token of every
document come from forward-backward. A document's score is a logistic function of its largest marginal
and its expected number of toxic tokens; runs of tokens with a marginal of one half or more are its
offending spans.

Forward-backward in numpy: with two labels the forward message is one ratio and each token is a Moebius
map of it. All texts of a piece form one chain (a text's first token forgets what came before), cut into
blocks; the maps of all blocks are multiplied in lockstep, a short loop passes the ratio from block to
block, and a second lockstep sweep fills in every token. The backward ratio works alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.mixing import word_count
from rankweave.llm.prefilter import perhaps
from rankweave.llm.scratch import Scratch
from rankweave.llm.textcore import LOWER, Piece, find_words, mix, pieces, word_hashes

#: Distinct labelled texts of each class that the field is fitted on at most, and the words of all of them together.
SAMPLE, SAMPLE_WORDS = 1_500, 1_200_000
#: One distinct labelled text in so many is kept for the document scale (half of SAMPLE of each class at most): the
#: scale is that of a field fitted, and marked, without these texts. The field that scores has marks from all.
SCALE_SHARE = 5
#: Texts that must be cut for SAMPLE_WORDS are cut to windows of so many words.
WINDOW = 128
HASH_BITS = 18
#: Lengths in bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
SLOTS = 2 + len(BEGINNINGS)
#: The feature of marked words; hashed features lie below it.
MARKED = (1 << HASH_BITS) - 1
#: Features that a task counts before it hands them on.
HELD = 500_000
BLOCK = 64

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, on UTF-8 bytes."""
    out = LOWER[data]
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 0x20
    return out


def raw_features(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, back, starts, ends, first): 64-bit hashes of each distinct word without outer punctuation and
    of its beginnings, 0 where the word is shorter; back: the row of each word in table."""
    words = find_words(piece)
    data = lowered(piece.data)
    a, b = words.starts.copy(), words.ends.copy()
    for _ in range(4):
        b -= (b - a > 1) & _PUNCT[data[b - 1]]
        a += (b - a > 1) & _PUNCT[data[a]]
    # each distinct word is hashed once per piece
    whole = word_hashes(data, a, b)
    _, at, back = np.unique(whole, return_index=True, return_inverse=True)
    ua, ub, n = a[at], b[at], (b - a)[at]
    table = np.zeros((len(at), SLOTS - 1), dtype=np.uint64)
    table[:, 0] = mix(whole[at] + np.uint64(11))
    for k, size in enumerate(BEGINNINGS, start=1):
        long = np.flatnonzero(n > size)
        h = word_hashes(data, ua[long], ua[long] + size)
        table[long, k] = mix(h + np.uint64(100 + k))
    return table, back, words.starts, words.ends, words.first


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, text) -> the same with one word of each kind (without outer punctuation, in lower case) of the
    text, which has the same features: what is shuffled is several times smaller than the text."""
    for batch in batches:
        for piece in pieces(batch.column(2)):
            table, back, starts, ends, first = raw_features(piece)
            text = np.repeat(np.arange(len(piece)), np.diff(first))
            _, at = np.unique(text * max(len(table), 1) + back, return_index=True)
            size = ends[at] - starts[at] + 1  # and a space
            edge = np.concatenate(([0], np.cumsum(size)))
            data = np.full(edge[-1], ord(" "), dtype=np.uint8)
            keep = np.ones(edge[-1], dtype=bool)
            keep[edge[1:] - 1] = False
            data[keep] = piece.data[np.flatnonzero(keep) + np.repeat(starts[at] - edge[:-1], size - 1)]
            bounds = edge[np.searchsorted(text[at], np.arange(len(piece) + 1))]
            words = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
            part = batch.slice(piece.first, len(piece))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], names=["id", "digest", "text"])


def word_features(piece: Piece, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table, back, starts, ends, first): hashed features of each distinct word, then MARKED where one of them is
    in the sorted marks; 0: none. back: the row of each word in table."""
    raw, back, starts, ends, first = raw_features(piece)
    mask = np.uint64((1 << HASH_BITS) - 1)
    table = np.zeros((len(raw), SLOTS), dtype=np.int32)
    table[:, :-1] = np.where(raw == 0, 0, 1 + ((raw & mask) % (mask - np.uint64(1))).astype(np.int64))
    if len(marks):
        near = marks[np.minimum(np.searchsorted(marks, raw), len(marks) - 1)]
        table[((near == raw) & (raw != 0)).any(axis=1), -1] = MARKED
    return table, back, starts, ends, first


@dataclass
class Field:
    """weights: emission by feature (0: none); bias; trans[i][j]: from label i to j; begin: of label 1;
    marks: sorted 64-bit features that mark words."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    begin: float
    scale: tuple[float, float, float] = (0.0, 0.0, 0.0)
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def emission(self, feats: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[feats].sum(axis=1) + self.bias, -30, 30).astype(np.float64)


def _ratios(e: np.ndarray, reset: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x_k = e_k (t01 + x t11) / (t00 + x t10) along the chain, or e_k start_k where reset."""
    n = len(e)
    rows = -(-n // BLOCK)
    grid = lambda v, fill: np.concatenate((v, np.full(rows * BLOCK - n, fill))).reshape(rows, BLOCK).T.copy()
    e2, r2, s2 = grid(e, 1.0), grid(reset, False), grid(start, 1.0)
    # maps x -> (p + q x) / (u + v x), composed over each block
    p, q, u, v = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)
    for k in range(BLOCK):
        ek, rk = e2[k], r2[k]
        p, q, u, v = ek * (t[0, 1] * u + t[1, 1] * p), ek * (t[0, 1] * v + t[1, 1] * q), t[0, 0] * u + t[1, 0] * p, t[0, 0] * v + t[1, 0] * q
        if rk.any():
            p, q, u, v = np.where(rk, ek * s2[k], p), np.where(rk, 0.0, q), np.where(rk, 1.0, u), np.where(rk, 0.0, v)
        if k % 4 == 3:
            top = np.maximum(np.maximum(p, q), np.maximum(u, v))
            p, q, u, v = p / top, q / top, u / top, v / top
    into, x = np.empty(rows), 1.0
    for k, (pk, qk, uk, vk) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
        into[k] = x
        x = min(max((pk + qk * x) / max(uk + vk * x, 1e-300), 1e-200), 1e200)
    out = np.empty((BLOCK, rows))
    x = into
    for k in range(BLOCK):
        x = np.where(r2[k], e2[k] * s2[k], e2[k] * (t[0, 1] + x * t[1, 1]) / (t[0, 0] + x * t[1, 0]))
        out[k] = x
    return out.T.reshape(-1)[:n]


def marginals(field: Field, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward ratio, backward ratio, marginal of label 1) of every token; first: text bounds."""
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    t, w = np.exp(field.trans), np.exp(e)
    begins = first[:-1][np.diff(first) > 0]
    reset = np.zeros(n, dtype=bool)
    reset[begins] = True
    forward = _ratios(w, reset, t, np.full(n, np.exp(field.begin)))
    # backward: s_k = (t10 + t11 y) / (t00 + t01 y) with y = e_{k+1} s_{k+1}; s = 1 at a text's end.
    # In reverse order z_k = e_k s_k follows the same recursion with transposed transitions.
    ends = np.zeros(n, dtype=bool)
    ends[np.append(begins[1:], n) - 1] = True
    z = _ratios(w[::-1], ends[::-1], t.T, np.ones(n))[::-1]
    backward = z / w
    odds = forward * backward
    return forward, backward, odds / (1 + odds)


def _pairs(field: Field, e: np.ndarray, first: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Expected counts of label pairs at adjacent tokens."""
    n = len(e)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    k = np.flatnonzero(inner)
    t, y, x = np.exp(field.trans), np.exp(e[k]) * backward[k], forward[k - 1]
    parts = np.array([np.full(len(k), t[0, 0]), t[0, 1] * y, x * t[1, 0], x * t[1, 1] * y])
    return (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)


#: Sums per feature: toxic and other documents, of all and of those that are not kept for the scale.
SUMS = ("bad", "good", "bad_rest", "good_rest")


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    features, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return features, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(features)) for k in range(1, 1 + len(SUMS)))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """``(feature, bad, good, bad_rest, good_rest)``, partial sums: the documents of labelled(text, y, weight, scales)
    with a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(f, *sums):
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *map(pa.array, sums)], names=["feature", *SUMS])

        held, size = [], 0
        for batch in batches:
            y, weight, scales = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2, 3))
            shares = [weight * y, weight * (1 - y), weight * y * (1 - scales), weight * (1 - y) * (1 - scales)]
            for piece in pieces(batch.column(0)):
                table, back, _, _, first = raw_features(piece)
                if not len(back):
                    continue
                text = np.repeat(np.arange(len(piece)), np.diff(first))
                seen = np.unique(text * len(table) + back)
                features, at = np.unique(table, return_inverse=True)
                at = at.reshape(table.shape)
                seen = np.unique(((seen // len(table))[:, None] * len(features) + at[seen % len(table)]).reshape(-1))
                doc, feature = piece.first + seen // len(features), seen % len(features)
                held.append((features, *(np.bincount(feature, share[doc], len(features)) for share in shares)))
                size += len(features)
                if size > 2 * HELD:
                    held = [_counted(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield made(*held[0])
                        held, size = [], 0
        if held:
            yield made(*_counted(held))

    return labelled.select("text", "y", "weight", "scales").mapInArrow(run, "feature long" + "".join(f", {c} double" for c in SUMS))


def find_marks(labelled: DataFrame, sizes: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Features found in at least five toxic documents, and at least 20 times as often among them as among
    the others: by all labelled documents, and by those that are not kept for the scale. sizes: how many
    documents each of SUMS counts."""
    sums = feature_counts(labelled).groupBy("feature").agg(*[F.sum(c).alias(c) for c in SUMS])
    share = lambda c: (F.col(c) + 0.25) / (sizes[c] + 0.5)  # noqa: E731  a word unseen counts as a quarter of a document
    # weights of repeated rows are fractions, whose sums may miss a whole number by a little
    marks = lambda bad, good: (F.col(bad) > 5 - 1e-6) & (share(bad) > 20 * share(good))
    both = sums.where("feature <> 0").select("feature", marks(*SUMS[:2]).alias("all"), marks(*SUMS[2:]).alias("rest")).where("all OR rest").toArrow()
    feature = both.column("feature").to_numpy().view(np.uint64)
    return tuple(np.sort(feature[both.column(c).to_numpy(zero_copy_only=False).astype(bool)]) for c in ("all", "rest"))


def document_stats(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest marginal and the sum of those above a hundredth, per text (0 without tokens)."""
    n = np.diff(first)
    at = np.minimum(first[:-1], max(len(p) - 1, 0))
    if not len(p):
        return np.zeros(len(n)), np.zeros(len(n))
    top = np.where(n > 0, np.maximum.reduceat(p, at), 0.0)
    total = np.where(n > 0, np.add.reduceat(np.where(p > 0.01, p, 0.0), at), 0.0)
    return top, total


def word_limit(counts: np.ndarray, total: int) -> int | None:
    """The largest limit to the words of each text that keeps the sum within total; None if no text need be cut."""
    if counts.sum() <= total:
        return None
    lo, hi = 1, int(counts.max())
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if np.minimum(counts, middle).sum() <= total else (lo, middle - 1)
    return lo


def windows(n: int, limit: int | None) -> list[tuple[int, int]]:
    """Evenly spread stretches of the n words of a text, of at most limit words together."""
    if limit is None or n <= limit:
        return [(0, n)] if n else []
    size = min(WINDOW, limit)
    cells, wanted = -(-n // size), max(1, limit // size)
    return [(k * size, min(n, (k + 1) * size)) for k in ((2 * i + 1) * cells // (2 * wanted) for i in range(min(wanted, cells)))]


def _cut(got: DataFrame, limit: int | None) -> DataFrame:
    """``(digest, y, part)``: the windows of each text of got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for piece in pieces(batch.column(2)):
                words = find_words(piece)
                for k in range(len(piece)):
                    a = words.first[k]
                    for i, j in windows(int(words.first[k + 1] - a), limit):
                        part = piece.data[words.starts[a + i] : words.ends[a + j - 1]].tobytes().decode("utf-8", "replace")
                        rows.append((keys[piece.first + k], y[piece.first + k], part))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["digest", "y", "part"])

    return got.select("digest", "y", "text").mapInArrow(run, "digest string, y int, part string")


def _scale(field: Field, got: DataFrame, share: float) -> tuple[float, float, float]:
    """The document scale, from the whole texts of got; share: of toxic documents among all labelled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                table, back, _, _, first = word_features(piece, field.marks)
                top, total = document_stats(marginals(field, field.emission(table)[back], first)[2], first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(top), pa.array(total)], names=["y", "top", "total"])

    rows = got.select("y", "text").mapInArrow(run, "y int, top double, total double").orderBy("y", "top", "total").toArrow()
    y, top, total = (rows.column(k).to_numpy().astype(float) for k in range(3))
    return _logistic(np.column_stack((np.ones(len(top)), top, np.log1p(total))), y, share)


def fit(texts: list[str], toxic: np.ndarray, marks: np.ndarray, rounds: int = 25) -> Field:
    """The field without its document scale; tokens of toxic texts are toxic where they are marked."""
    tables, backs, counts, rows = [], [], [], 0
    for piece in pieces(pa.array(texts, pa.string())):
        table, back, _, _, first = word_features(piece, marks)
        tables.append(table)
        backs.append(back + rows)
        counts.append(np.diff(first))
        rows += len(table)
    table, back, counts = np.concatenate(tables), np.concatenate(backs), np.concatenate(counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    y = (table[:, -1] == MARKED)[back] & np.repeat(toxic, counts)
    field = Field(np.zeros(1 << HASH_BITS), -3.0, np.zeros((2, 2)), 0.0, marks=marks)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    k = np.flatnonzero(inner)
    seen_pairs = np.bincount(2 * y[k - 1] + y[k], minlength=4).reshape(2, 2)
    begins = np.flatnonzero(~inner)
    weight_grad2, other_grad2 = np.full(1 << HASH_BITS, 1e-6), np.full(6, 1e-6)
    for _ in range(rounds):  # AdaGrad on the log-likelihood
        e = field.emission(table)[back]
        forward, backward, p = marginals(field, e, first)
        left = y - p
        by_word = np.bincount(back, np.where(np.abs(left) > 1e-4, left, 0.0), len(table))
        g = np.bincount(table.reshape(-1), np.repeat(by_word, SLOTS), 1 << HASH_BITS) - 0.01 * field.weights
        g[0] = 0
        weight_grad2 += g * g
        field.weights = field.weights + 0.8 * g / np.sqrt(weight_grad2)
        pair = seen_pairs - _pairs(field, e, first, forward, backward)
        o = np.concatenate((pair.reshape(-1), [left.sum(), left[begins].sum()]))
        other_grad2 += o * o
        step = 0.3 * o / np.sqrt(other_grad2)
        field.trans = np.clip(field.trans + step[:4].reshape(2, 2), -6, 6)
        field.bias, field.begin = float(field.bias + step[4]), float(np.clip(field.begin + step[5], -6, 6))
    field.weights = field.weights.astype(np.float32)
    return field


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, classes weighted to their natural shares."""
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-2, 1e-2]) * len(y) * 0.05
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge @ w)
    return tuple(float(v) for v in w)


def score(field: Field, top: np.ndarray, total: np.ndarray) -> np.ndarray:
    a, b, c = field.scale
    return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log1p(total), -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``(id_col, held_out, score, predicted, spans)``; spans are ``[start, end)`` in characters of the text.

    ``learn_from`` is a condition on ``id``: labels are read only where it holds. Null and empty texts
    have no tokens and get the score of such texts; very long ones are scored whole. Labels of unknown or
    null ids are ignored; an id or a text with both labels is toxic; copies of a text count once in learning.
    Rows that repeat an id are scored one by one; other columns are ignored, whatever their names; an empty
    table gives an empty result. Without labels of both kinds nothing can be learned: the score is 0 and
    there are no spans.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(learn_from & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    # one narrow row for each distinct labelled text: its copies count once, and as toxic if any is
    named = texts.where(F.col("text").isNotNull()).select("id", F.md5("text").alias("digest")).join(known, "id")
    rows = named.groupBy("digest", "id").agg(F.count("*").alias("n"), F.max("y").alias("y")).groupBy("digest").agg(F.max("y").alias("y"), F.min(F.struct("id", "n")).alias("one"))
    scales = F.pmod(F.xxhash64("digest"), F.lit(SCALE_SHARE)) == 0
    distinct = scratch.keep(rows.select("digest", "y", "one.id", (1 / F.col("one.n")).alias("weight"), scales.alias("scales")), "distinct")
    lowest = lambda y, share, n: distinct.where((F.col("y") == y) & (F.col("scales") == share)).orderBy(F.xxhash64(F.lit("toxic"), "id"), "digest").limit(n)
    picked = scratch.keep(lowest(0, False, sample).union(lowest(1, False, sample)).union(lowest(0, True, sample // 2)).union(lowest(1, True, sample // 2)), "picked")
    # at most 3 * sample ids, so the broadcast is bounded
    got = texts.withColumn("digest", F.md5("text")).join(F.broadcast(picked), ["id", "digest"]).dropDuplicates(["digest"])
    got = scratch.keep(got.withColumn("n_words", word_count(F.col("text"))), "sample")
    fits, measures = got.where("NOT scales"), got.where("scales")
    field = None
    if fits.select("y").distinct().count() == 2:
        n = known.agg(F.count("*").alias("n"), F.sum("y").alias("bad")).first()
        counts = [(r.y, r.scales, r.n) for r in distinct.groupBy("y", "scales").agg(F.count("*").alias("n")).collect()]
        size = lambda y, rest: sum(n for z, scales, n in counts if z == y and not (rest and scales))
        near = perhaps(texts.where(F.col("text").isNotNull()), F.col("id"), distinct, F.col("id"), "near").where("near")  # most others are never shuffled
        kinds = near.select("id", F.md5("text").alias("digest"), "text").mapInArrow(_distinct_words, "id long, digest string, text binary")
        labelled = kinds.join(distinct, ["id", "digest"])
        marks, marks_rest = find_marks(labelled, dict(zip(SUMS, (size(1, False), size(0, False), size(1, True), size(0, True)), strict=True)))
        limit = word_limit(fits.select("n_words").toArrow().column(0).to_numpy(), SAMPLE_WORDS)
        parts = _cut(fits, limit).toArrow()
        order = np.argsort(np.array(parts.column("digest").to_pylist(), dtype=str), kind="stable")
        texts_of = parts.column("part").to_pylist()
        cut, toxic = [texts_of[k] for k in order], parts.column("y").to_numpy()[order] > 0
        if cut:
            field = fit(cut, toxic, marks)
            # the scale comes from texts that a field and its marks have not seen; from all, if these lack a class
            if measures.select("y").distinct().count() == 2:
                field.scale = _scale(fit(cut, toxic, marks_rest), measures, n.bad / n.n)
            else:
                field.scale = _scale(field, got, n.bad / n.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for piece in pieces(batch.column(1)):
                value, spans = np.zeros(len(piece)), [[] for _ in range(len(piece))]
                if field is not None:
                    table, back, starts, ends, first = word_features(piece, field.marks)
                    _, _, p = marginals(field, field.emission(table)[back], first)
                    value = score(field, *document_stats(p, first))
                    chars = np.concatenate(([0], np.cumsum((piece.data & 0xC0) != 0x80)))
                    text = np.repeat(np.arange(len(piece)), np.diff(first))
                    hit = np.flatnonzero(p >= 0.5)
                    if len(hit):
                        new = np.concatenate(([True], (np.diff(hit) > 1) | (text[hit[1:]] != text[hit[:-1]])))
                        last = np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)
                        for a, b in zip(hit[new], hit[last], strict=True):
                            zero = chars[piece.bounds[text[a]]]
                            spans[text[a]].append({"start": int(chars[starts[a]] - zero), "end": int(chars[ends[b]] - zero)})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(value), pa.array(spans, span)], names=["id", "score", "spans"])

    scored = texts.mapInArrow(run, "id long, score double, spans array<struct<start:int,end:int>>")
    held_out = ~F.coalesce(learn_from, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
