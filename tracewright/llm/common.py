"""What the operators share: reading tables, the shared work folder, and Arrow-batch helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder, seen by the driver and all executors, under the cluster's checkpoint folder.

    Only where spark.checkpoint.dir is unset (a local session, as in tests) is a temporary folder chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.gettempdir() + "/tracewright"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Jobs run here give their shuffle files back as soon as they end, not when the driver next collects garbage. Frames
    run here are not to be run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The frame after a round trip through Parquet: a cut lineage that survives lost executors."""
    with freed(df.sparkSession):
        df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by shared_folder, through Hadoop so that any store works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(rows: Callable) -> Callable:
    """A function over Arrow batches whose worker, which lives on after the task, gives its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def column(name: str, of: str = "") -> Column:
    """A column (of a struct) by its name as it stands, dots and backticks included."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def places(df: DataFrame) -> list[str]:
    """Names for a frame's columns by their place, for functions over Arrow batches, which take plain names only."""
    return [f"c{k}" for k in range(len(df.columns))]


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text as string ('' for null); other columns go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_bucket(doc_id: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text has about ``limit`` bytes at most (one long row may exceed it)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0 or texts.nbytes <= limit:
            yield batch
            continue
        start = size = 0
        lengths = pc.binary_length(texts).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)
