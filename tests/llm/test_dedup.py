"""Near duplicates and repeated windows against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import minhash, prefilter, substring
from rankweave.llm.minhash import near_duplicates
from rankweave.llm.recompress import represent, symbols
from rankweave.llm.substring import cut_text, remove_repeats, removal_digests
from rankweave.llm.textcore import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(rows, width, percent):
    """rows: (id, text) with distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_brute_force(generated, width):
    got = near_duplicates(generated, width=width).collect()
    want = brute_components([(r.doc_id, r.text) for r in generated.collect()], width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(r.class_id != r.component_id for r in got)


def test_links_that_no_star_tests(spark, monkeypatch):
    """A family around a text that is just too far from it, yet near to each other, in blocks of any size."""
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        w = list(base)
        for j in range(5):  # 5 edits: too far from the base, two of a pair share four of them
            w[(j * 23 + (k // 2 if j == 4 else 0)) % 120] = f"e{j}_{k // 2 if j == 4 else 0}"
        w[119] = f"own{k}"
        rows.append((k, " ".join(w)))
    want = {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stars, size, rows in ((3, 400_000, 1_000), (1, 700, 1_000), (1, 400_000, 5), (20, 400_000, 1_000)):
        monkeypatch.setattr(minhash, "STARS", stars)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", size)
        monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
        monkeypatch.setattr(minhash, "STAR_ROWS", rows)
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, width=4).collect()} == want


def test_one_id_with_several_texts_ties_their_groups(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (7, "c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, width=4).collect()} == {(1, 1, True), (2, 1, False), (5, 1, False), (7, 7, True)}


def test_no_link_is_lost_at_the_threshold():
    """Pairs at exactly four fifths, of any size, share a bucket."""
    rng = np.random.default_rng(5)
    probes = minhash.probe_order(256)
    lost = 0
    for size in (4, 8, 20, 60, 200, 800):
        sets = []
        for _ in range(300):
            pool = np.unique(rng.integers(0, 2**64, size // 4 * 5, dtype=np.uint64))
            sets += [pool, np.sort(rng.permutation(pool)[: size // 4 * 4])]
        keys = minhash.band_keys(minhash.signatures(sets, 256, probes), 50, 5)
        lost += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
    assert lost == 0


def test_components_on_awkward_rows(awkward, none):
    rows = near_duplicates(awkward, width=4).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for k in (1, 2, 3) for r in by[k])
    assert [r.component_id for r in by[7]] == [6, 6] and not any(r.kept for r in by[7])
    assert all(r.component_id is None and r.kept for r in by[None])
    assert {r.component_id for r in by[10]} == {10}
    assert by[12][0].component_id == 8
    assert near_duplicates(none).count() == 0


def brute_removal(texts):
    seen = Counter()
    split = [WORD.findall(t or "") for t in texts]
    for w in split:
        seen.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("name", ["generated", "awkward"])
def test_removal_equals_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_removal([r.text for r in rows]), strict=True))
    got = Counter(tuple(r) for r in removal_digests(docs).collect())
    assert got == want and any(x[2] for x in want)


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_filter_rules_out_no_wanted_row(spark, monkeypatch, bits):
    monkeypatch.setattr(prefilter, "FILTER_BITS", bits)
    rows, wanted = spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("text")), spark.range(0, 2000, 40)
    got = prefilter.perhaps(rows, F.col("k"), wanted, F.col("id"), "near")
    assert got.columns == ["k", "text", "near"] and got.count() == 2000
    near = {r.k for r in got.where("near").collect()}
    assert near >= set(range(0, 2000, 40)) and (bits == 64 or len(near) < 150)
    assert prefilter.perhaps(rows, F.col("k"), wanted.limit(0), F.col("id"), "near").where("near").count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_results_do_not_depend_on_the_filter(generated, monkeypatch, bits):
    monkeypatch.setattr(prefilter, "FILTER_BITS", bits)
    rows = generated.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_removal([r.text for r in rows]), strict=True))
    assert Counter(tuple(r) for r in removal_digests(generated).collect()) == want


def test_removal_of_nothing(none, spark):
    assert removal_digests(none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert removal_digests(one).first().n_removed == 0


def test_removal_keeps_rows_and_columns(awkward):
    out = remove_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    before = Counter(r.text for r in awkward.collect())
    after = Counter(r.text for r in out.collect())
    assert after[None] == before[None]
    assert after["a b c d e f g"] == 1


def test_cut_text_leaves_the_rest_alone():
    w = [f"w{k}" for k in range(100)]
    text = "  " + "\n".join(w) + "\t"
    cut = cut_text(text, np.array([10, 11, 60]))
    assert cut.split() == w[:10] + w[46:60] + w[95:]
    assert cut.startswith("  w0\nw1\n") and cut.endswith("w99\t")
    assert cut_text(" ".join(w[:35]), np.array([0])) == ""


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 8, 50])
@pytest.mark.parametrize("cap", [8, 24])
def test_equal_windows_have_equal_representatives(vocabulary, cap):
    rng = np.random.default_rng(vocabulary)
    base = [rng.integers(0, vocabulary, rng.integers(1, 150)) for _ in range(5)]
    base.append(np.tile(rng.integers(0, vocabulary, 4), 30))
    texts = []
    for _ in range(60):
        b = base[rng.integers(len(base))]
        i = rng.integers(len(b))
        around = [rng.integers(0, vocabulary, rng.integers(0, 9)) for _ in range(2)]
        texts.append(np.concatenate((around[0], b[i : i + rng.integers(len(b))], around[1])))
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = np.concatenate(texts)
    r = represent(mix(words.astype(np.uint64) + np.uint64(5)), bounds, 35, cap)
    keys = defaultdict(set)
    for k in range(len(texts)):
        for p in range(bounds[k], max(bounds[k], bounds[k + 1] - 34)):
            keys[tuple(words[p : p + 35])].add(int(r.of[p]))
    assert keys and all(len(x) == 1 and 0 not in x for x in keys.values())
    assert set(r.chosen.key().tolist()) == set.union(*keys.values())
    # symbols stand for what they cover: equal names, equal words
    covers = defaultdict(set)
    s = symbols(mix(words.astype(np.uint64) + np.uint64(5)), bounds, cap)
    for name, a, b in zip(s.name.tolist(), s.start, s.end, strict=True):
        covers[name].add(tuple(words[a:b]))
    assert all(len(x) == 1 for x in covers.values()) and max(len(w) for x in covers.values() for w in x) <= cap


def test_rounds_of_any_caps_find_the_same(generated, monkeypatch):
    want = Counter(tuple(r) for r in removal_digests(generated).collect())
    monkeypatch.setattr(substring, "CAPS", (3, 6, 30))
    monkeypatch.setattr(substring, "COMBINED", 50)
    assert Counter(tuple(r) for r in removal_digests(generated).collect()) == want
