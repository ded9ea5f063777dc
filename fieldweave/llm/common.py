"""What the corpus operators share: scratch tables, word splitting and slices of Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, where
    driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(spark.sparkContext, "_fieldweave_scratch", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="fieldweave-")
        spark.sparkContext._fieldweave_scratch = folder
    return folder


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of a few megabytes, however long they are.

    Each running task holds a batch outside the heap and in Python; a session's
    own smaller bound is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    ``write`` returns the table as read back; ``drop`` deletes one that no
    later step reads. What remains goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with every column but ``used`` under a name that nothing else has; ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c if c in used else f"_own{i}" for i, c in enumerate(docs.columns)])


def utf8(text: str | Column) -> Column:
    """The text's bytes; no text counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def words(text: str | Column) -> Column:
    """The words of a text as an array of strings; none for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), BLANKS), lambda w: w != "")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of a batch's rows whose ``column`` (binary, without nulls) holds about ``most_bytes``; one row at least.

    Bounds what Python objects are alive at once; a single text is never cut.
    """
    values = batch.column(batch.schema.get_field_index(column))
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(values).to_pylist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start), values.slice(start).to_pylist()


def broadcast_if(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if rows <= most else df
