"""Risk-controlled quality rules.

Every rule rejects a document when one of its ratios exceeds a cutoff. Cutoffs are not guessed: for each
stratum they are chosen on labelled good documents so that the share of good documents that *any* rule
rejects is at most ``alpha``, with confidence ``1 - delta`` for all strata together.

* Each distinct text counts once: copies are no independent draws. By a hash of the text it falls to
  the tuning share or to the holdout.
* The tuning share gives the order of tightening: from no cutoffs at all, always the rule and cutoff that
  newly reject most junk for the good texts they cost, as long as there is junk left to reject.
* The holdout walks that one path. A step is safe when, with k of n good texts rejected by any rule, the
  exact binomial ``P(Bin(n, alpha) <= k)`` is within the level, i.e. when the Clopper-Pearson upper bound is
  within alpha. The walk ends before the first step that is not (fixed-sequence testing, so the number of
  steps costs nothing); the strata share ``delta`` equally (Bonferroni).

A stratum with too few labelled good texts, or no labelled junk, gets no cutoffs: nothing is rejected on guesses.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.scratch import Scratch
from rankweave.llm.textcore import find_words, gram_hashes, pieces, word_hashes

#: The counted symbols (fixed by the contract of the query).
SYMBOLS = b"#*$%&|<>"
_COUNTED = np.zeros(256, dtype=bool)
_COUNTED[list(SYMBOLS)] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_FIRST_BYTE = np.ones(256, dtype=bool)
_FIRST_BYTE[0x80:0xC0] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")

#: ratio of each rule, and its cutoffs from loose to tight
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "duplicate_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "repeated_words": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.05)),
    "capitals": ("n_capitals / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1)),
    "exclamations": ("n_bangs / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03)),
}


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() strips exactly \x20 and \x09-\x0D
    return len(lines), len(lines) - len(set(lines))


def _repeat_words(h: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    _, at, n = np.unique(gram_hashes(h, 3), return_inverse=True, return_counts=True)
    again = np.flatnonzero(n[at] > 1)
    if not len(again):
        return 0
    cover = np.zeros(len(h), dtype=bool)
    for k in range(3):
        cover[again + k] = True
    return int(cover.sum())


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column(0)):
            words = find_words(piece)
            h = word_hashes(piece.data, words.starts, words.ends)
            inside = np.zeros(len(piece.data) + 1, dtype=np.int8)
            inside[words.starts] += 1
            inside[words.ends] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            total = lambda mask, p=piece: np.diff(np.concatenate(([0], np.cumsum(mask)))[p.bounds])
            lines = np.array([_line_counts(piece.text(k)) for k in range(len(piece))], dtype=np.int64).reshape(-1, 2)
            repeat = np.array([_repeat_words(h[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], dtype=np.int64)
            columns = [words.counts, total(inside & _FIRST_BYTE[piece.data]), total(_COUNTED[piece.data]), lines[:, 1], repeat, lines[:, 0], total(_CAPITAL[piece.data]), total(piece.data == ord("!"))]
            keys = [c.slice(piece.first, len(piece)) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.astype(np.int64)) for c in columns)], names=["id", "stratum", "t1", "t2", *COUNTS])


def text_counts(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``(id, stratum, t1, t2)`` and the counts of every whole text; a null text counts as empty. t1 and t2 tell
    texts apart; stratum is ``0`` and the stratum's name, or ``1`` for null."""
    text, stratum = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(stratum_col).cast("string")
    rows = docs.select(
        text.alias("text"), F.col(id_col).cast("long").alias("id"), F.when(stratum.isNull(), "1").otherwise(F.concat(F.lit("0"), stratum)).alias("stratum"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"),
    )
    return rows.mapInArrow(_count_pass, "id long, stratum string, t1 long, t2 long, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed from log terms."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1.0)) + log(p) - log1p(-p) if k else np.zeros(0)
    terms = n * log1p(-p) + np.concatenate(([0.0], np.cumsum(steps)))
    top = terms.max()
    return float(min(1.0, np.exp(top + np.log(np.exp(terms - top).sum()))))


def tightening_path(first: np.ndarray, good: np.ndarray, junk: np.ndarray, sizes: tuple[int, ...]) -> list[int]:
    """The rules in the order in which they take their next cutoff.

    first: for each kind of text (rows) and rule, the step of the rule that first rejects it; good, junk: how
    many such texts; sizes: cutoffs of each rule. Ties go to the cheaper move, then the shorter, then the
    earlier rule.
    """
    taken, gone, path = [0] * len(sizes), np.zeros(len(good), dtype=bool), []
    while True:
        moves = []
        for r, size in enumerate(sizes):
            for to in range(taken[r] + 1, size + 1):
                new = ~gone & (first[:, r] <= to)
                gain, cost = int(junk[new].sum()), int(good[new].sum())
                if gain:
                    moves.append((-gain / (cost + 1), cost, to - taken[r], r))
        if not moves:
            return path
        _, _, steps, r = min(moves)
        taken[r] += steps
        gone |= first[:, r] <= taken[r]
        path += [r] * steps


def safe_steps(path: list[int], first: np.ndarray, weight: np.ndarray, rules: int, risk: float, level: float) -> list[int]:
    """Steps taken of each rule before the first step of the path that is not safe."""
    taken, gone, n = [0] * rules, np.zeros(len(weight), dtype=bool), int(weight.sum())
    for r in path:
        gone |= first[:, r] <= taken[r] + 1
        if binomial_tail(int(weight[gone].sum()), n, risk) > level:
            break
        taken[r] += 1
    return taken


def _exceeds(rule: str, cutoff: Column) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.col(top) > cutoff * F.col(bottom), F.lit(False))


def learn_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float, delta: float, tuning: int = 5) -> DataFrame:
    """``(stratum, n_good, cutoff_<rule>...)`` from ``labels(id, good)``; null cutoffs reject nothing.

    One text in ``tuning`` belongs to the tuning share. Texts are gathered by the step at which each rule
    rejects them, so a stratum's search sees kinds of texts (a few hundred rows), not texts.
    """
    known = labels.where("id IS NOT NULL AND good IN (0, 1)").groupBy("id").agg(F.max("good").alias("good"))
    # the tightest cutoffs are exceeded first: a text that exceeds e of m is first rejected at step m - e + 1
    steps = [(F.lit(len(cutoffs) + 1) - sum((_exceeds(rule, F.lit(c)).cast("int") for c in cutoffs), F.lit(0))).alias(rule) for rule, (_, cutoffs) in RULES.items()]
    placed = counts.join(known, "id").select("stratum", "t1", "t2", "good", *steps)
    once = placed.groupBy("stratum", "t1", "t2", *RULES).agg(F.max("good").alias("good"))
    kinds = once.groupBy("stratum", (F.pmod("t2", F.lit(tuning)) == 0).alias("tunes"), *RULES).agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("junk"))
    strata = max(1, once.select("stratum").distinct().count())

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(RULES))
        sizes = tuple(len(c) for _, c in RULES.values())
        tune, hold = group[group.tunes], group[~group.tunes]
        path = tightening_path(tune[list(RULES)].to_numpy(), tune.good.to_numpy(), tune.junk.to_numpy(), sizes)
        taken = safe_steps(path, hold[list(RULES)].to_numpy(), hold.good.to_numpy(), len(RULES), alpha, delta / strata)
        chosen = {f"cutoff_{rule}": [cutoffs[k - 1] if k else None] for k, (rule, (_, cutoffs)) in zip(taken, RULES.items(), strict=True)}
        return pd.DataFrame({"stratum": [group.stratum.iloc[0]], "n_good": [int(group.good.sum())], **chosen})

    return kinds.groupBy("stratum").applyInPandas(search, "stratum string, n_good long" + "".join(f", cutoff_{rule} double" for rule in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.
    ``kept``: not base_failed and within the cutoffs of the document's stratum.

    Null, empty and wordless texts have zero counts and fail; very long texts are counted whole. Null is a
    stratum of its own, apart from the empty string; a stratum without labels rejects nothing. Labels with a
    null id or for unknown ids are ignored, repeated ones count once, and so do equal texts of a stratum;
    a text with both labels is good. Documents that repeat an id are rows of their own. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    counts = scratch.keep(text_counts(docs, id_col, text_col, stratum_col), "counts")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(good_col).cast("int").alias("good"))
    cutoffs = scratch.keep(learn_cutoffs(counts, known, alpha, delta), "cutoffs")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | _exceeds(rule, F.col(f"cutoff_{rule}"))
    joined = counts.join(cutoffs, "stratum", "left").withColumn("base_failed", failed)
    return joined.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
