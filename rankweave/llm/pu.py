"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Only trusted positives and unlabelled text are used; negative labels never are. With class prior p the
risk of a scorer g is ``p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])`` for the logistic loss l; the
second term estimates the risk on the unseen negatives and is kept from going below zero, where a
flexible model would only be fitting noise. The prior is estimated from all documents: a first scorer
separates P from U, and the smallest ratio of U's to P's share among the highest scores, with a margin for
sampling error, is the share of positives in U.

Features are shares of a text's own words and characters, cut into quantile bins, so a linear scorer can
bend. Quantiles and the prior are corpus statistics over every document (mergeable sketches, counts above
cuts). Only the gradient steps run on the driver on at most ``SAMPLE`` rows of each kind, chosen by the
lowest hashes of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.rules import _line_counts, _repeat_words
from rankweave.llm.scratch import Scratch
from rankweave.llm.textcore import Piece, find_words, pieces, word_hashes

#: Rows of positives, and of unlabelled text, that the scorer's weights are fitted on at most.
SAMPLE = 8_000
#: Entries of a quantile sketch: ranks are off by one part in so many at most.
SKETCH = 1_000
BINS = 12
FEATURES = ("log_words", "word_length", "capitals", "symbols", "marks", "stops", "digits", "wide", "lines", "duplicate_lines", "repeated", "adjacent", "distinct", "pipes", "other_symbols")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "capitals": _mask(bytes(range(ord("A"), ord("Z") + 1))),
    "symbols": _mask(b"#*$%&|<>"),
    "marks": _mask(b"!?"),
    "stops": _mask(b".,;:"),
    "digits": _mask(b"0123456789"),
    "wide": _mask(bytes(range(0xC0, 0x100))),
    "pipes": _mask(b"|"),
    "other_symbols": _mask(b"@^~_=+{}[]()/\\\"'`-"),
}


def features(piece: Piece) -> np.ndarray:
    """One row of FEATURES per text; an empty text is all zeros."""
    words = find_words(piece)
    h = word_hashes(piece.data, words.starts, words.ends)
    n = words.counts
    some = np.maximum(n, 1)
    letters = np.add.reduceat(np.append(words.ends - words.starts, 0), np.minimum(words.first[:-1], len(words)))
    letters = np.where(n > 0, letters, 0)
    count = {c: np.diff(np.concatenate(([0], np.cumsum(m[piece.data])))[piece.bounds]) for c, m in _CLASSES.items()}
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][n > 0]] = False
    adjacent = np.diff(np.concatenate(([0], np.cumsum(same)))[words.first])
    lines = np.array([_line_counts(piece.text(k)) for k in range(len(piece))], dtype=np.int64).reshape(-1, 2)
    repeat = np.array([_repeat_words(h[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    # distinct words among stretches of 100, so that long texts are not judged by their length
    stretch = np.concatenate([np.arange(k) // 100 for k in n]) if len(h) else np.zeros(0, np.int64)
    key = (words.text_of.astype(np.uint64) << np.uint64(32)) | stretch.astype(np.uint64)
    order = np.lexsort((h, key))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
    distinct = np.bincount(words.text_of[order], weights=new, minlength=len(piece))
    long = np.maximum(letters, 1)
    cols = {
        "log_words": np.log1p(n), "word_length": letters / some, "capitals": count["capitals"] / long, "symbols": count["symbols"] / some, "marks": count["marks"] / some, "stops": count["stops"] / some,
        "digits": count["digits"] / long, "wide": count["wide"] / long, "lines": lines[:, 0] / some, "duplicate_lines": lines[:, 1] / np.maximum(lines[:, 0], 1), "repeated": repeat / some,
        "adjacent": adjacent / some, "distinct": distinct / some, "pipes": count["pipes"] / some, "other_symbols": count["other_symbols"] / some,
    }
    return np.column_stack([cols[f] for f in FEATURES]).astype(np.float64)


@dataclass
class Scorer:
    """Bin edges per feature, one weight per bin (the last weight is the constant), and the prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.weights[_bins(self.edges, x)].sum(axis=1) + self.weights[-1]


def _cuts(some: bool) -> list[float]:
    """Probabilities of the bin edges: of all values, or of those above zero (many features are zero for most)."""
    n = BINS // 2 if some else BINS
    return [float(p) for p in np.linspace(0, 1, n + 1)[1:-1]]


def quantile_edges(rows: DataFrame) -> list[np.ndarray]:
    """Bin edges of each feature from all of ``rows(x)``: quantiles of all values and of the values above zero."""
    wanted = []
    for k in range(len(FEATURES)):
        value = F.col("x")[k]
        wanted += [F.percentile_approx(value, _cuts(False), SKETCH).alias(f"a{k}"), F.percentile_approx(F.when(value > 0, value), _cuts(True), SKETCH).alias(f"s{k}"), F.min(value).alias(f"m{k}")]
    got = rows.agg(*wanted).first()
    out = []
    for k in range(len(FEATURES)):
        zero = [0.0] if got[f"m{k}"] is not None and got[f"m{k}"] <= 0 else []
        out.append(np.unique(np.array([*(got[f"a{k}"] or []), *zero, *((got[f"s{k}"] or []) if zero else [])], dtype=np.float64)))
    return out


def _bins(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The weight number of each feature's bin."""
    out, at = np.empty(x.shape, dtype=np.int64), 0
    for k, e in enumerate(edges):
        out[:, k] = at + np.searchsorted(e, x[:, k], side="left")
        at += len(e) + 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, size: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


#: Shares of the positives above the cuts at which their scores are compared with those of all documents.
TAILS = np.linspace(0.01, 0.7, 70)


def prior_from_shares(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> float:
    """The share of positives among n_u unlabelled texts, from the shares of both kinds above some cuts.

    Among the highest scores (almost) all of u is positive, so there the ratio of u's share to p's is
    the prior; the cut is where the ratio's upper confidence bound is lowest.
    """
    margin = 2 * (np.sqrt(in_u * (1 - in_u) / n_u) + np.sqrt(in_p * (1 - in_p) / n_p))
    ratio = in_u / np.maximum(in_p, 1e-9)
    return float(np.clip(ratio[np.argmin(ratio + margin / np.maximum(in_p, 1e-9))], 0.05, 0.98))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The same from the scores themselves."""
    cuts = np.quantile(p, TAILS)
    return prior_from_shares(*(x for s in (p, u) for x in (1 - np.searchsorted(np.sort(s), cuts) / len(s), len(s))))


class Fitting:
    """Weights over the bins of positives p and unlabelled u (features by row), for given edges."""

    def __init__(self, edges: list[np.ndarray], p: np.ndarray, u: np.ndarray, penalty: float = 1e-4):
        self.edges, self.bp, self.bu, self.penalty = edges, _bins(edges, p), _bins(edges, u), penalty
        self.size = sum(len(e) + 1 for e in edges) + 1

    def scores(self, bins: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w[bins].sum(axis=1) + w[-1]

    def back(self, bins: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The mean over rows of v times the row's indicator of bins."""
        out = np.bincount(bins.reshape(-1), weights=np.repeat(v, bins.shape[1]), minlength=self.size)
        out[-1] = v.sum()
        return out / len(v)

    def separate(self, rounds: int = 300) -> np.ndarray:
        """Weights that tell p from u, from every second row of each."""
        a, b = self.bp[::2], self.bu[::2]
        return _adam(lambda w: -self.back(a, 1 - _sigmoid(self.scores(a, w))) + self.back(b, _sigmoid(self.scores(b, w))) + self.penalty * w, self.size, rounds)

    def risk(self, w: np.ndarray, prior: float) -> float:
        """The non-negative unbiased risk (without the penalty)."""
        zp, zu = self.scores(self.bp, w), self.scores(self.bu, w)
        loss = lambda z: np.logaddexp(0, z).mean()  # noqa: E731  of a text that is no positive
        return prior * loss(-zp) + max(0.0, loss(zu) - prior * loss(zp))

    def gradient(self, w: np.ndarray, prior: float) -> np.ndarray:
        """Of risk and penalty; where the risk on negatives is below zero, the way back up instead."""
        zp, zu = self.scores(self.bp, w), self.scores(self.bu, w)
        negative = self.back(self.bu, _sigmoid(zu)) - prior * self.back(self.bp, _sigmoid(zp))
        if np.logaddexp(0, zu).mean() < prior * np.logaddexp(0, zp).mean():
            return -negative + self.penalty * w
        return negative - prior * self.back(self.bp, 1 - _sigmoid(zp)) + self.penalty * w

    def fit(self, prior: float, rounds: int = 1500) -> Scorer:
        return Scorer(self.edges, _adam(lambda w: self.gradient(w, prior), self.size, rounds), prior)


def feature_table(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)``: the features of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), _lists(features(piece))], names=["id", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, x array<double>")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _above(rows: DataFrame, scorer: Scorer, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all ``rows(x)`` score each cut or more, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(cuts), dtype=np.int64), 0
        for batch in batches:
            z = np.sort(scorer(_matrix(batch.column(0))))
            held, n = held + len(z) - np.searchsorted(z, cuts), n + len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array(np.append(held, n))], names=["k", "n"])

    got = dict(rows.select("x").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect())
    return np.array([got.get(k, 0) for k in range(len(cuts))], dtype=np.float64), int(got.get(len(cuts), 0))


def learn(rows: DataFrame, labels: DataFrame, *, learn_from: Column, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Scorer | None:
    """Fit a scorer on ``rows(id, x)``, the features of all documents; None without positives or documents.

    ``learn_from`` is a condition on ``id``: labels are read only where it holds. Of rows that repeat an id the
    one with the lowest features is the sample's. Only the rows of chosen ids reach the driver, at most
    ``sample`` of each kind.
    """
    trusted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(learn_from & (F.col("y") == 1) & F.col("id").isNotNull()).select("id").distinct()
    ids = rows.where("id IS NOT NULL").select("id").distinct()

    def lowest(some: DataFrame, kind: str) -> np.ndarray:
        key = F.xxhash64(F.lit(kind), "id")
        chosen = F.broadcast(some.orderBy(key, "id").limit(sample))  # so the broadcast is bounded
        table = rows.join(chosen, "id").groupBy("id").agg(F.min("x").alias("x")).orderBy(key, "id").toArrow()
        return _matrix(table.column("x")) if table.num_rows else np.zeros((0, len(FEATURES)))

    p, u = lowest(ids.join(trusted, "id", "left_semi"), "p"), lowest(ids, "u")
    if not len(p) or not len(u):
        return None
    fitting = Fitting(quantile_edges(rows), p, u)
    prior = 0.5
    if len(p) > 20 and len(u) > 20:
        first = Scorer(fitting.edges, fitting.separate(), 0.0)
        rest = np.sort(first(p[1::2]))  # positives that the first scorer has not seen
        cuts = np.quantile(rest, TAILS)
        above, n = _above(rows, first, cuts)
        prior = prior_from_shares(1 - np.searchsorted(rest, cuts) / len(rest), len(rest), above / n, n)
    return fitting.fit(prior)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def add_score(rows: DataFrame, scorer: Scorer | None, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """rows with the score of each whole text: no shuffle, rows stay where they are. A column named out_col is replaced."""
    rows = rows.drop(out_col)
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                score = _sigmoid(scorer(features(piece))) if scorer is not None else np.full(len(piece), 0.5)
                yield pa.RecordBatch.from_arrays([*batch.slice(piece.first, len(piece)).columns, pa.array(score)], names=[*names, out_col])

    return rows.mapInArrow(run, "".join(f"`{c}` {t}, " for c, t in rows.dtypes) + f"`{out_col}` double")


def classify(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` of every row of docs.

    Null and empty texts have all features zero and the score of such texts; very long ones are taken whole;
    equal texts get equal scores. Labels of unknown or null ids are ignored, repeated ones count once; rows
    with a null or repeated id are scored one by one; a null id is held out. Other columns are ignored,
    whatever their names; an empty table gives an empty result. Without positives or documents nothing can
    be learned: the score is 0.5 everywhere.
    """
    rows = Scratch(docs.sparkSession, "quality").keep(feature_table(docs, id_col=id_col, text_col=text_col), "features")
    scorer = learn(rows, labels, learn_from=learn_from, id_col=id_col, label_col=label_col, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _sigmoid(scorer(_matrix(batch.column(1)))) if scorer is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    held_out = ~F.coalesce(learn_from, F.lit(False))
    return rows.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
