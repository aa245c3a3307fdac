"""A corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on everything the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.bpe import encode_digests
from rankweave.llm.minhash import near_duplicates
from rankweave.llm.mixing import systematic_mix, word_count
from rankweave.llm.pu import add_score, feature_table, learn
from rankweave.llm.queries import tokenizer_path
from rankweave.llm.scratch import Scratch, free_names
from rankweave.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts (score of 0.7 or more).

    Null, empty and very long texts are scored like others; rows with a null or repeated id are judged one by
    one, equal texts alike; labels of unknown or null ids are ignored. Without positives or documents every
    score is 0.5, so nothing stays. Other columns pass through, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    rows = Scratch(spark, "quality").keep(feature_table(docs, id_col="doc_id", text_col="text"), "features")
    scorer = learn(rows, labels, learn_from=~held)
    (score,) = free_names(docs.columns, "score")
    return add_score(docs, scorer, out_col=score).where(F.col(score) >= 0.7).select(*named(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that repeat an id are one document, of which the row with the lowest text hash stays. Rows
    without an id cannot be named as a group's document; one of each distinct text stays (lowest hash of the
    row). Null and empty
    texts are alike to nothing and stay; very long texts are compared whole; an empty table stays empty.
    Other columns pass through, whatever their names.
    """
    rows = docs.select(F.struct(*named(docs)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    kept = near_duplicates(docs.where("doc_id IS NOT NULL"), width=5, percent=80).where("kept").select(F.col("doc_id").alias("id")).distinct()
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text"), F.xxhash64("row")))
    with_id = rows.where("id IS NOT NULL").join(kept, "id", "left_semi").withColumn("place", first("id"))
    others = rows.where("id IS NULL").withColumn("place", first("text"))
    return with_id.where("place = 1").select("row.*").union(others.where("place = 1").select("row.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of the texts; all documents stay, ``n_chars`` follows the text.

    Null texts stay null, empty and short ones as they are; very long ones are cut anywhere; copies of a text
    lose it all. Ids may be null or repeat: rows stand for themselves. An empty table stays empty. Other
    columns pass through, whatever their names.
    """
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return remove_repeats(docs).select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: each document as often as it was drawn (0, 1 or 2 times).

    A document's size is its words; null, empty and very long texts are drawn by the same rule. A null source
    is a source of its own; ties of size go by a hash of the id, then the id; rows that repeat an id are
    separate documents. An empty table stays empty. Other columns pass through, whatever their names.
    """
    words, size, target, copies, copy = free_names(docs.columns, "words", "source_size", "target", "copies", "copy")
    sized = docs.select(*named(docs), word_count(F.col("text")).alias(words))
    mixed = systematic_mix(sized, size_col=words, out_cols=(size, target, copies))
    return mixed.select(*named(docs), F.explode(F.expr(f"array_repeat(0, {copies})")).alias(copy)).select(*named(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the text decoded from them, one row per document.

    A null text counts as empty (no tokens); very long texts are encoded whole; rows that repeat an id keep
    their rows, equal texts get equal values. An empty table gives an empty result; other columns are ignored.
    """
    return encode_digests(docs, tokenizer_path())


def named(docs: DataFrame) -> list[Column]:
    """All columns of docs, also those whose names need quoting."""
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("tokens", tokens)]

#: No SQL says what the classifier and the token stage do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        scratch.release()
    return docs
