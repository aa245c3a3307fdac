"""The thin ``opN_<name>`` queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.licenses import license_sql
from rankweave.llm.mixing import mix_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the token query is defined on."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _learn_from(mod: int, held: int) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo mod, is not held."""
    return (F.crc32(F.col("id").cast("string").cast("binary")) % mod) != held


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.pu import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_learn_from(4, 2))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.jpeg import add_media, read_media
    from rankweave.llm.scratch import Scratch

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = Scratch(spark, "media").keep(add_media(docs).drop("text"), "media")
    return read_media(stored, keep=("doc_id", "n_bytes"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.mixing import systematic_mix, word_count
    from rankweave.llm.scratch import Scratch

    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = systematic_mix(Scratch(spark, "sizes").keep(sized, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.crf import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_learn_from(5, 0))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.scratch import Scratch
    from rankweave.llm.warc import read_payloads, read_records, write_archive

    path = f"{Scratch(spark, 'warc').base}/archive"
    write_archive(_table(spark, sf_dir, "pages"), path)
    payloads = read_payloads(spark, path).select("key", "payload_bytes", "payload_digest")
    joined = read_records(spark, path).join(payloads, "key")
    return joined.select(F.expr("try_cast(record AS long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.substring import removal_digests

    return removal_digests(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_matches", "license", "dice")


def op10_license_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankweave.llm.licenses import license_stretches

    return license_stretches(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_pu_quality, op3_minhash, op4_jpeg_media, op5_source_mix, op6_crf_toxicity, op7_bpe, op8_warc, op9_substring, op10_licenses, op10_license_stretches)
}

ORACLE_SQL: dict[str, str] = {
    "op5_source_mix": mix_sql(),
    "op10_licenses": license_sql(),
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM p
""",
}
