"""Helpers of the corpus operators: tables, shared scratch space and streamed groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs on one machine, as in tests, a temporary folder takes its place; on a
    cluster that is an error, for its executors do not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skerry-"))
            known = spark.sparkContext.getCheckpointDir()
        root = known
    return f"{root.rstrip('/')}/skerry/{uuid.uuid4().hex}"


#: Bytes that Spark sends a Python worker at a time while it writes a stored table.
BATCH_BYTES = 4 << 20


#: Shuffle files go with the write that made them; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs neither recompute it nor lose it with an executor.

    Its shuffle files are deleted when it is written.

    Python stages on the way get batches of at most ``BATCH_BYTES``, so a worker's memory does not grow with the texts.
    """
    spark = df.sparkSession
    path = scratch(spark)
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), _CLEANUP: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        # a new frame, for the setting is read when one is made
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _files(spark, path, "deleteOnExit")  # what is not discarded before goes with the application
    out = spark.read.schema(df.schema).parquet(path)
    out._skerry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote, when nothing reads it any more."""
    path = getattr(df, "_skerry_path", None)
    if path:
        _files(df.sparkSession, path, "delete", True)


def _files(spark: SparkSession, path: str, call: str, *args) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(p, *args)


def lean(run: Callable) -> Callable:
    """``run``, for mapInArrow, giving freed memory back at its end: workers live on, and their memory counts while others work."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return inner


def sliced(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of at most ``rows`` rows and, but for a longer single text, ``size`` bytes in ``column``."""
    at = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        n = n or 0
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` dealt over all cores when it has fewer partitions than that, whatever its file sizes."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism * per_core))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` has not got yet, upper and lower case being the same."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys out of batches sorted by them; only the present run is held."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, k in enumerate(rows):
            if k != key:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield key, pa.Table.from_batches(held)
                held, start, key = [], i, k
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8; nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def long_sum(name: str):
    return F.sum(name).cast("long")
