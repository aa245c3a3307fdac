"""Each stage of the pipeline on its predecessor's rows, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from small_corpus import corpus  # noqa: E402
from test_dedup import WORD, brute_components, brute_removal  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """sf_dir and the rows of documents and after each stage."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(9, 400)
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t, _, _ in rows] + [(500, "", "en", "s0", 0), (None, rows[0][1], None, None, 1), (3, rows[3][1], "en", "s0", 1)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(k, q, x) for k, _, q, x in rows if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    df, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(df.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, sf_dir).write.parquet(f"{sf_dir}/stage{k}")
        df = spark.read.parquet(f"{sf_dir}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(df.collect())
    return sf_dir, out


def test_quality_keeps_prose_and_drops_junk(stages):
    before, after = stages[1][0], stages[1][1]
    junk = {r.doc_id for r in before if re.search(r"(\*\*\*|\$\$\$|&&&)", r.text or "")}
    kept = {r.doc_id for r in after}
    prose = {r.doc_id for r in before if r.doc_id not in junk and len((r.text or "").split()) > 20}
    assert len(prose & kept) > 0.97 * len(prose) and len(junk & kept) < 0.05 * len(junk)
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages[1][1], stages[1][2]
    groups = brute_components([(r.doc_id, r.text) for r in {r.doc_id: r for r in before if r.doc_id is not None}.values()], 5, 80)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)


def test_substring_dedup_removes_repeated_windows(stages):
    before, after = stages[1][2], stages[1][3]
    want = brute_removal([r.text for r in before])
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r, (n, gone, _) in zip(before, want, strict=True):
        assert len(WORD.findall(texts[r.doc_id])) == n - gone
        if not gone:
            assert texts[r.doc_id] == r.text
    assert any(g for _, g, _ in want) and all(r.n_chars == len(r.text) for r in after)


def test_mix_repeats_and_drops_whole_documents(stages):
    before, after = stages[1][3], stages[1][4]
    n = Counter(map(tuple, after))
    assert not set(n) - set(map(tuple, before)) and max(n.values()) <= 2
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 2000


def test_tokens_of_every_row(stages):
    from tokenizers import Tokenizer

    from rankweave.llm.queries import tokenizer_path

    before, after = stages[1][4], stages[1][5]
    library = Tokenizer.from_file(tokenizer_path())
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in before)


def test_run_gives_the_last_stage(stages, spark):
    sf_dir, out = stages
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, out[-1]))


#: Names that the operators use, or once used, for columns of their own.
CLASHING = """id row place score words copy copies source_size target starts starts_ t1 t2 name key n x y kept low places size hub comp
_row _score _words _copy _size _sk _digit _rn _start _text _t1 _t2 _starts _at _q SCORE Row""".split()


def test_stages_with_clashing_columns(stages, spark):
    sf_dir, rows = stages
    names = [c for c in CLASHING if c.lower() not in {d.lower() for d in CLASHING[: CLASHING.index(c)]}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(f"{sf_dir}/stage{k - 1}" if k else f"{sf_dir}/documents.parquet")
        wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
        out = stage(spark, wide, sf_dir)
        if name == "tokens":
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, rows[k + 1]))
            continue
        assert out.columns == wide.columns
        got = out.collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, rows[k + 1])), name
        assert all(tuple(r)[5:] == tuple(f"own {c}" for c in names) for r in got), name


def test_stages_on_no_rows(stages, spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, stages[0]).count() == 0


def test_stages_on_awkward_rows(stages, spark, awkward):
    """Nulls in any column, empty and long texts, repeated rows and ids; all but the classifier keep what they must."""
    docs = awkward.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    before = docs.collect()
    scored, single, cut, mixed, coded = (stage(spark, docs, stages[0]).collect() for _, stage in corpus_pipeline.STAGES)
    assert not Counter(map(tuple, scored)) - Counter(map(tuple, before))
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11] and sum(r.doc_id is None for r in single) == 2
    assert Counter(r.doc_id for r in cut) == Counter(r.doc_id for r in before) and {r.doc_id for r in cut if r.text is None} == {1, None}
    assert all(r.text == "" for r in cut if r.doc_id in (6, 7)) and not Counter(map(tuple, mixed)) - Counter({tuple(r): 2 * n for r, n in Counter(map(tuple, before)).items()})
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in before) and all(r.n_tokens == 0 for r in coded if r.doc_id in (1, 2))
