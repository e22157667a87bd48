"""What the operators of this subpackage share: table access, lineage cuts and batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pairsmith.operators.values import shared_folder


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a query, whose session is to send texts to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For queries, which own their session: Arrow batches of fewer rows than Spark's default of 10,000, which long texts
    would make too large for an executor. A session's own setting stands. Operators leave settings alone; they take
    batches of any size."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffles of frames that are made and run here are deleted as soon as they have run. Spark would keep
    them until the driver's JVM happens to collect their plans."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation. What was
    shuffled to compute it is deleted."""
    shared_folder(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a compressed Parquet table in the same folder, and its path: for rows with whole texts, which checkpoints hold
    as they are. Small row groups bound what a writing task holds. The table goes by ``dropped`` or when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    kept(df.sparkSession, path)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(spark: SparkSession, path: str) -> None:
    """Notes a folder that this driver writes, to be deleted when it ends."""
    if not _written:
        atexit.register(lambda: [dropped(s, p) for p, s in list(_written.items())])
    _written[path] = spark


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    _written.pop(path, None)
    with contextlib.suppress(Exception):  # the session has ended
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hidden(df: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """df with new names for its columns that begin with an underscore or are named in ``added``, and old names by new
    ones: such names are the operators' own while they run. ``withColumnsRenamed`` gives the old names back."""
    taken, own = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_") or c.lower() in added:
            new = f"own{c}"
            while new.lower() in taken:
                new = f"own{new}"
            taken.add(new.lower())
            own[new] = c
    return df.withColumnsRenamed({c: new for new, c in own.items()}), own


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give their memory back after each task."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


def release() -> None:
    """Gives free memory back to the system: workers outlive their tasks, and an executor counts what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
