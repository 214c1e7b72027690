"""What the operators share: pinned tables in the shared folder, Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch to a Python worker has at most, so that long texts can't fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and all runs in one process (tests), a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps neither recompute it nor lose it with an executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """The same in buckets by a column, as a table of the session, so that grouping by it moves no rows."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_pinned(df: DataFrame) -> None:
    """Removes a pinned table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_llm.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.write(root.parent / "__init__.py", "ledgerloom/__init__.py")
            for f in sorted(root.glob("*.py")):
                z.write(f, f"ledgerloom/llm/{f.name}")
        spark.sparkContext.addPyFile(str(path))
        atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
        _SHIPPED.add(app)


def bound_batches(spark: SparkSession) -> None:
    """To be called before Python code runs on executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that gives its memory back to the system when it ends, so that idle workers stay small. It makes no cycles, so none are looked for meanwhile."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow

        pyarrow.set_memory_pool(pyarrow.system_memory_pool())
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            trim()

    return wrapped


def trim() -> None:
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(col: str = "text"):
    """The column's UTF-8 bytes, none for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def packed(df: DataFrame, without: tuple[str, ...] = ()):
    """All columns in one struct named row, so that no name of theirs can meet one of ours; `without`: names that the result replaces."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in without)).alias("row")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
