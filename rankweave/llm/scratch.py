"""Tables that cut lineage: written to the folder the cluster shares, so a lost executor loses nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; where it is unset, a folder of our own in local mode
    (tests) and an error elsewhere: executors of a cluster would not see a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows and bytes per Arrow batch at most: whole texts go to Python, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to BATCH_ROWS and BATCH_BYTES (a longer row is a batch of its own).

    Results are lazy, so the setting stays for the session. Smaller ones are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def free_names(taken: list[str], *stems: str) -> list[str]:
    """The stems, each with as many underscores as it takes to be no column name (names ignore case)."""
    low, out = {c.lower() for c in taken}, []
    for stem in stems:
        while stem.lower() in low:
            stem += "_"
        low.add(stem.lower())
        out.append(stem)
    return out


#: On a local file system every file gets a checksum file beside it, and Hadoop launches a process for each of the two.
#: Scratch files need no checksum file; other file systems do not look at these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """Named Parquet tables of one operator run under a fresh folder of the shared root."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        small_batches(spark)
        path, files = self._file("")
        files.mkdirs(path)
        files.deleteOnExit(path)  # what a lazy result still reads goes with the driver

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a reader of what was written."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").options(compression="zstd", **PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path, files = self._file(name)
            files.delete(path, True)

    def release(self) -> None:
        """Let the context cleaner remove the shuffle files of steps whose results were written.

        Spark frees them only when the driver's JVM collects the handles, by default every 30 minutes;
        a long job would otherwise hold every step's shuffle on disk at once.
        """
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
