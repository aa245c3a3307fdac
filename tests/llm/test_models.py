"""Rules, classifier and toxicity: exact bounds, held-out accuracy, awkward rows."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave.llm import crf, pu, rules
from rankweave.llm.textcore import pieces
from small_corpus import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


@pytest.mark.parametrize("name", ["generated", "awkward"])
def test_rule_counts(request, spark, name):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(1, 1), (None, 0), (1, 1), (999, 1)], "doc_id long, quality int")
    got = Counter(tuple(r) for r in rules.quality_rules(docs, labels).collect())
    want = Counter()
    for r in docs.collect():
        c = brute_counts(r.text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(r.doc_id, *c, failed, not failed)] += 1  # too few labels for any cutoff
    assert got == want


def test_rules_on_no_rows(none, spark):
    assert rules.quality_rules(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_binomial_bound_is_exact():
    for n, p in ((1, 0.3), (20, 0.05), (200, 0.01), (500, 0.5)):
        exact = Fraction(p)
        for k in {0, 1, n // 3, n - 1, n}:
            tail = sum(comb(n, i) * exact**i * (1 - exact) ** (n - i) for i in range(k + 1))
            assert rules.binomial_tail(k, n, p) == pytest.approx(float(tail), rel=1e-9, abs=1e-300)


def brute_cutoffs(texts, risk, level, tuning=5):
    """Cutoffs of one stratum by the definition; texts: (hash, counts by name, good)."""
    value = {}
    for rule, (ratio, cutoffs) in rules.RULES.items():
        top, bottom = ratio.split(" / ")
        value[rule] = lambda c, t=top, b=bottom: (c[t], c[b])
    rejects = lambda c, at: any(at[r] and value[r](c)[0] > rules.RULES[r][1][at[r] - 1] * value[r](c)[1] for r in at)
    tune, hold = [x for x in texts if x[0] % tuning == 0], [x for x in texts if x[0] % tuning]
    at, path = dict.fromkeys(rules.RULES, 0), []
    while True:
        left = [x for x in tune if not rejects(x[1], at)]
        moves = []
        for k, r in enumerate(rules.RULES):
            for to in range(at[r] + 1, len(rules.RULES[r][1]) + 1):
                new = [x for x in left if rejects(x[1], {r: to})]
                gain, cost = sum(not x[2] for x in new), sum(x[2] for x in new)
                if gain:
                    moves.append((-gain / (cost + 1), cost, to - at[r], k, r))
        if not moves:
            break
        _, _, steps, _, r = min(moves)
        at[r] += steps
        path += [r] * steps
    good = [x for x in hold if x[2]]
    safe = dict.fromkeys(rules.RULES, 0)
    for r in path:
        step = safe | {r: safe[r] + 1}
        k, n = sum(rejects(x[1], step) for x in good), len(good)
        if sum(comb(n, i) * Fraction(risk) ** i * (1 - Fraction(risk)) ** (n - i) for i in range(k + 1)) > level:
            break
        safe = step
    return safe, rejects


@pytest.fixture(scope="module")
def ruled(spark):
    """Two strata with junk of several kinds, copies and a few good texts that look like junk; one without labels."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        w = [f"a{rng.integers(4000)}b" for _ in range(rng.integers(51, 90))]
        kind = rng.random()
        good = 1
        if kind < 0.1:
            w, good = [x + "***" for x in w], 0
        elif kind < 0.2:
            w, good = [x.upper() if rng.random() < 0.8 else x for x in w], 0
        elif kind < 0.21:
            w = [x + "!" if rng.random() < 0.5 else x for x in w]
        rows.append((k, " ".join(w), [None, "de", "", "fr"][int(rng.integers(3)) if k < 1400 else 3], good))
    rows += [(2000 + k, rows[5][1], rows[5][2], 1) for k in range(300)]  # copies are one draw
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[2] != "fr"], "doc_id long, quality int")
    return rows, docs, labels


def test_kept_equals_brute_force(ruled):
    rows, docs, labels = ruled
    alpha, delta = 0.05, 0.05
    counts = {r.id: r.asDict() for r in rules.text_counts(docs, "doc_id", "text", "lang").collect()}
    got = {r.doc_id: r.kept for r in rules.quality_rules(docs, labels, alpha=alpha, delta=delta).collect()}
    used = 0
    for lang in (None, "de", "", "fr"):
        mine = [r for r in rows if r[2] == lang]
        texts = {} if lang == "fr" else {r[1]: (counts[r[0]]["t2"], counts[r[0]], bool(r[3])) for r in mine}
        safe, rejects = brute_cutoffs(list(texts.values()), alpha, delta / 3)
        used += sum(safe.values())
        for r in mine:
            c = counts[r[0]]
            failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
            assert got[r[0]] == (not failed and not rejects(c, safe)), (r, safe)
    assert used and {r[2] for r in rows if not got[r[0]]} >= {None, "de", ""} and all(got[r[0]] for r in rows if r[2] == "fr")


def test_false_rejection_stays_within_the_risk():
    """Paths over random good texts whose true rates of rejection are known."""
    rng, bad = np.random.default_rng(0), 0
    rates = np.array([0.005, 0.015, 0.06])  # good texts rejected at steps 1, 2, 3 of the only rule
    for _ in range(300):
        first = np.array([[1], [2], [3], [4]])
        good = rng.multinomial(2000, [0.005, 0.01, 0.045, 0.94])
        taken = rules.safe_steps([0, 0, 0], first, good, 1, 0.02, 0.05)[0]
        bad += taken > 0 and rates[taken - 1] > 0.02
    assert bad <= 0.05 * 300 + 8
    assert rules.safe_steps([0, 0], first, np.array([0, 0, 0, 80]), 1, 0.02, 0.05) == [0]  # too few


def _frames(spark, seed, n):
    rows = corpus(seed, n)
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_classifier_on_held_out_documents(spark):
    rows, docs, labels = _frames(spark, 5, 900)
    got = {r.doc_id: r for r in pu.classify(docs, labels, learn_from=F.col("id") % 3 != 0).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert all(got[r[0]].held_out for r in held)
    good = [got[r[0]].score for r in held if r[2]]
    junk = [got[r[0]].score for r in held if not r[2]]
    assert np.mean([g > j for g in good for j in junk]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.97
    # labels of held-out rows are never read
    flipped = labels.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in pu.classify(docs, flipped, learn_from=F.col("id") % 3 != 0).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p, bad = rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000)
    for share in (0.2, 0.5, 0.9):
        u = np.where(rng.random(6000) < share, rng.normal(2, 1, 6000), bad)
        assert abs(pu.estimate_prior(p, u) - share) < 0.05


def _fitting(seed=2):
    rng = np.random.default_rng(seed)
    p, u = rng.normal(1, 1, (40, len(pu.FEATURES))), rng.normal(0, 1, (60, len(pu.FEATURES)))
    return pu.Fitting([np.quantile(u[:, k], [0.25, 0.5, 0.75]) for k in range(u.shape[1])], p, u, penalty=0.01), rng


def test_risk_by_its_definition():
    f, rng = _fitting()
    clipped = 0
    for prior in (0.2, 0.5, 0.9):
        for scale in (0.05, 0.5, 3):
            w = rng.normal(0, scale, f.size)
            loss = lambda z: float(np.mean([np.log1p(np.exp(-v)) for v in z]))
            zp = [sum(w[b] for b in row) + w[-1] for row in f.bp]
            zu = [sum(w[b] for b in row) + w[-1] for row in f.bu]
            rest = loss([-z for z in zu]) - prior * loss([-z for z in zp])
            assert f.risk(w, prior) == pytest.approx(prior * loss(zp) + max(0.0, rest))
            total = lambda v, prior=prior: f.risk(v, prior) + f.penalty * (v @ v) / 2
            g = f.gradient(w, prior)
            if rest > 0:
                step = 1e-6 * np.eye(f.size)
                assert g == pytest.approx(np.array([(total(w + e) - total(w - e)) / 2e-6 for e in step]), abs=1e-5)
            else:  # a step against it raises what the clamp holds at zero
                clipped += 1
                up = w - 1e-4 * (g - f.penalty * w)
                neg = lambda v, prior=prior: np.logaddexp(0, f.scores(f.bu, v)).mean() - prior * np.logaddexp(0, f.scores(f.bp, v)).mean()
                assert neg(up) > neg(w)
    assert clipped


def test_quantiles_and_tails_cover_all_documents(spark):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((3000, len(pu.FEATURES))) < 0.3, 0.0, rng.gamma(2, 1, (3000, len(pu.FEATURES))))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(7)
    for k, edges in enumerate(pu.quantile_edges(rows)):
        for probabilities, values in ((pu._cuts(False), x[:, k]), (pu._cuts(True), x[:, k][x[:, k] > 0])):
            order = np.sort(values)
            for q in probabilities:  # some edge has the rank asked for, within the sketch's error
                near = order[[max(0, int((q - 0.005) * len(order)) - 1), min(len(order) - 1, int((q + 0.005) * len(order)) + 1)]]
                assert ((edges >= near[0]) & (edges <= near[1])).any()
    scorer = pu.Scorer([np.array([0.5, 2.0])] * len(pu.FEATURES), rng.normal(0, 1, 3 * len(pu.FEATURES) + 1), 0.5)
    cuts = np.array([-3.0, 0.0, 1.5])
    above, n = pu._above(rows, scorer, cuts)
    assert n == 3000 and above.tolist() == [(scorer(x) >= c).sum() for c in cuts]


def test_quality_by_brute_force(spark):
    """Scores equal those of the same steps done at once on all rows, without Spark."""
    rows, docs, labels = _frames(spark, 6, 500)
    x = np.concatenate([pu.features(piece) for piece in pieces(pa.array([t for _, t, _, _ in rows]))])
    good = np.array([q == 1 and k % 3 != 0 for k, _, q, _ in rows])
    got = {r.doc_id: r.score for r in pu.classify(docs, labels, learn_from=F.col("id") % 3 != 0).collect()}
    table = spark.createDataFrame([(k, v.tolist()) for (k, _, _, _), v in zip(rows, x, strict=True)], "id long, x array<double>")
    rank = {kind: {r.id: r.h for r in docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.lit(kind), "doc_id").alias("h")).collect()} for kind in "pu"}
    order = lambda kind, keep: [k for k in sorted(range(len(rows)), key=lambda i: rank[kind][rows[i][0]]) if keep[k]]
    p, u = x[order("p", good)], x[order("u", np.ones(len(rows), bool))]
    fitting = pu.Fitting(pu.quantile_edges(table), p, u)
    first = pu.Scorer(fitting.edges, fitting.separate(), 0.0)
    prior = pu.estimate_prior(first(p[1::2]), first(x))
    want = 1 / (1 + np.exp(-fitting.fit(prior)(x)))
    assert np.array([got[k] for k, _, _, _ in rows]) == pytest.approx(want, abs=1e-9)


def test_scores_of_awkward_rows(awkward, none, spark):
    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 1), (None, 1, 1), (77, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for made in (pu.classify(awkward, labels, learn_from=F.lit(True)), crf.toxicity(awkward, labels, learn_from=F.lit(True)), pu.classify(awkward, empty, learn_from=F.lit(True)), crf.toxicity(awkward, empty, learn_from=F.lit(True))):
        rows = made.collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert pu.classify(none, labels, learn_from=F.lit(True)).count() == 0
    assert crf.toxicity(none, labels, learn_from=F.lit(True)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = crf.Field(np.zeros(4), 0.0, rng.normal(size=(2, 2)), 0.7)
    first = np.array([0, 3, 3, 10, 12])
    e = rng.normal(size=12) * 2
    _, _, p = crf.marginals(field, e, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        weight, total = np.zeros(n), 0.0
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            s = sum(e[a + k] * y[k] for k in range(n)) + sum(field.trans[y[k - 1], y[k]] for k in range(1, n)) + (field.begin * y[0] if n else 0)
            total += np.exp(s)
            weight += np.exp(s) * np.array(y)
        if n:
            assert np.allclose(p[a:b], weight / total)


def test_marginals_of_long_chains_are_finite():
    field = crf.Field(np.zeros(4), 0.0, np.array([[2.0, -3.0], [-1.0, 1.5]]), -1.0)
    e = np.random.default_rng(2).normal(size=50_000) * 25
    p = crf.marginals(field, np.clip(e, -30, 30), np.array([0, 50_000]))[2]
    assert np.isfinite(p).all() and p.min() >= 0 and p.max() <= 1


def test_toxicity_on_held_out_documents(spark):
    rows, docs, labels = _frames(spark, 7, 1200)
    got = {r.doc_id: r for r in crf.toxicity(docs, labels, learn_from=F.col("id") % 3 != 0).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    right = np.mean([got[r[0]].predicted == r[3] for r in held])
    assert right > 0.97
    bad = {"idiotic", "moronic", "wretch", "vermin"}
    spans = [(r[1], s) for r in held if r[3] for s in got[r[0]].spans]
    assert spans and np.mean([bool(bad & set(t[s.start : s.end].split())) for t, s in spans]) > 0.9


def test_toxicity_learns_from_long_documents(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):  # every text is over 20,000 characters; toxic ones hold two insults
        w = [f"w{v}x" for v in rng.integers(0, 2000, 4500)]
        if k % 2:
            w[100 + k] = w[3000 - k] = "moronic"
        rows.append((k, " ".join(w), k % 2))
    assert min(len(t) for _, t, _ in rows) > 20_000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in crf.toxicity(docs, labels, learn_from=F.col("id") % 4 < 2).collect()}
    assert np.mean([got[k].predicted == bad for k, _, bad in rows if k % 4 > 1]) > 0.9


def test_copies_do_not_shrink_the_sample(spark):
    rng = np.random.default_rng(4)
    text = lambda bad: " ".join([f"w{v}x" for v in rng.integers(0, 500, 40)] + ["moronic"] * bad)
    copied = {y: text(y) for y in (0, 1)}
    rows = [(k, copied[k % 2] if k < 900 else text(k % 2), k % 2) for k in range(1000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in crf.toxicity(docs, labels, learn_from=F.lit(True), sample=12).collect()}
    assert np.mean([got[k].predicted == bad for k, _, bad in rows if k >= 900]) > 0.9


def test_windows_keep_to_the_limit():
    counts = np.array([5, 40, 1000, 90_000])
    limit = crf.word_limit(counts, 3000)
    assert np.minimum(counts, limit).sum() <= 3000 < np.minimum(counts, limit + 1).sum()
    assert crf.word_limit(counts, 10**6) is None
    for n in (0, 1, 127, 128, 500, 90_000):
        for limit in (None, 3, 130, 600):
            w = crf.windows(n, limit)
            assert sum(b - a for a, b in w) <= min(n, limit or n) and all(0 <= a < b <= n for a, b in w) and bool(w) == (n > 0)
            assert all(x[1] <= y[0] for x, y in zip(w, w[1:], strict=False))


def test_toxicity_knows_rare_words_of_all_labelled_documents(spark):
    # 60 insults, each in ten toxic documents in all; a sample of 120 of 480 holds hardly any of them five times
    rng = np.random.default_rng(5)
    insults = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}qq" for k in range(60)]
    rows = [(k, " ".join([f"w{v}x" for v in rng.integers(0, 300, 30)] + [insults[(k // 2) % 60]] * (k % 2)), k % 2) for k in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in crf.toxicity(docs, labels, learn_from=F.col("id") < 960, sample=120).collect()}
    held = [r for r in rows if r[0] >= 960]
    assert np.mean([got[k].predicted for k, _, bad in held if bad]) > 0.9
    assert np.mean([got[k].predicted for k, _, bad in held if not bad]) < 0.05
