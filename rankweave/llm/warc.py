"""Content-addressed WARC archive: payload bytes once per digest, exact record headers beside them.

An archive is a folder with two Parquet tables:

* ``payloads(key, size, payload)`` - every distinct payload once, under its SHA-256;
* ``records(record, header, key)`` - one row per record: the WARC header block exactly as written, and
  the key of its payload.

Original records come back by joining the two. Everything is DataFrame functions; the bytes are shuffled
once (deduplicated on the map side first), records and digests are narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"


def _header(kind: Column, url: Column, record: Column, refers: Column, sha1: Column, size: Column, date: str) -> Column:
    """A WARC/1.1 header block; a revisit names the record that holds its payload."""
    profile = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), record, F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        # a line break inside a URL would end the header line; it is written percent-encoded
        F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.when(kind == "revisit", F.concat(F.lit(f"{CRLF}{profile}WARC-Refers-To: <urn:page:"), refers, F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), sha1, F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF),
    )


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of pages.

    The payload is the UTF-8 text (null: empty). Among records whose payloads are equal and have at
    least ``revisit_bytes`` bytes, those with the largest id are of type ``response``, the others
    ``revisit``; smaller payloads are all ``response``. A null id is written as ``-`` and ranks below
    all others; rows that repeat an id with the same payload share its type. A null URL is empty. An
    empty table gives an empty archive. Columns other than the three named are ignored.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("rank"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = base.withColumns({"key": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    digests.select("key", "sha1", "size", "payload").dropDuplicates(["key", "sha1", "size"]).write.option("compression", "zstd").parquet(f"{path}/payloads")

    narrow = digests.select("id", "rank", "url", "key", "sha1", "size")
    owner = narrow.where(F.col("size") >= revisit_bytes).groupBy("key").agg(F.max("rank").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    placed = narrow.join(owner, "key", "left")
    kind = F.when(F.col("top").isNull() | F.col("rank").eqNullSafe(F.col("top")), "response").otherwise("revisit")
    record = F.coalesce("id", F.lit("-"))
    header = _header(kind, F.col("url"), record, F.col("top").cast("string"), F.col("sha1"), F.col("size"), date)
    placed.select(record.alias("record"), header.alias("header"), "key").write.option("compression", "zstd").parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(key, payload, payload_bytes, payload_digest)``, digests taken anew; a changed byte raises an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("key"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("key"))))
    return stored.select("key", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, record_type, refers_to, header, key)``, the fields parsed from the stored header blocks."""
    field = lambda name, value: F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: {value}\r\n", 1), F.lit(""))
    return spark.read.parquet(f"{path}/records").select("record", field("WARC-Type", "([^\r]*)").alias("record_type"), field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"), "header", "key")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``(record, warc)``: every record as it was, header block, full payload and closing line breaks."""
    joined = read_records(spark, path).join(read_payloads(spark, path), "key")
    return joined.select("record", F.concat(F.encode("header", "UTF-8"), "payload", F.lit(CRLF + CRLF).cast("binary")).alias("warc"))
