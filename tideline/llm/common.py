"""What the corpus operators share: the shared folder, written tables, files and words."""

from __future__ import annotations

import contextlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD_BREAKS = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset one is made in local mode, as in tests; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written() tables that are no longer read."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The pyarrow file system of a URI or absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write chunks of bytes under a passing name, then rename: a task that is run again leaves one whole file."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    passing, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with files.open_output_stream(passing) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(passing, path)
    return size


def once_per_process(key: str, make: Callable):
    """make()'s value, kept for later tasks in the same Python worker."""
    kept = sys.__dict__.setdefault("_tideline_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trim() -> None:
    """Give memory that a task has freed back to the system; an idle worker would hold it next to the executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drop what once_per_process() keeps; for stages that need the worker's memory for other things."""
    if sys.__dict__.pop("_tideline_kept", None):
        trim()


def slices(batches, rows: int = 1000):
    """The rows of Arrow batches in batches of at most so many, so that lists of their values stay short."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    trim()


def text_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column; None for null."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def n_words(text) -> F.Column:
    """Words of a text column, counted on the JVM side; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_BREAKS}]+")), F.lit(0)).cast("long")


def as_row(docs: DataFrame, *more: F.Column) -> DataFrame:
    """docs with all its columns inside one struct, row, beside the columns more: whatever docs calls its columns, they clash with none of an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def row_columns(columns: list[str]) -> list[F.Column]:
    """The columns of as_row()'s struct, as they were."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def without(columns: list[str], *taken: str) -> list[str]:
    """columns but for those whose names, in any case, are taken."""
    low = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in low]
