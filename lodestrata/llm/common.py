"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of every word definition here, as a class body.
WS = r"\x20\x09-\x0D"
#: Names that no input table uses; operators keep their own columns under them.
OWN = "__llm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where a session on one machine has no such setting (tests), one temporary
    folder is made, set, and removed when Python ends. On a cluster executors would
    write to disks of their own: there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which the worker, which waits for other tasks, gives back the memory that it does not use."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        from . import bytewords

        try:
            yield from run(batches)
        finally:
            bytewords._powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


#: While this is set, a query's shuffle files go when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Batches that Python gets are cut by bytes too, since rows may be long.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation, and what a
    non-deterministic step has decided (row ids) stays decided. The shuffle files of
    the step are deleted, so that disks hold one step at a time.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    own = {_CLEAN: "true", _BATCH: BATCH_BYTES}
    old = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a ``materialize()`` result that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def words(text: str) -> str:
    """SQL for the array of words of a text column; a null text has none."""
    return f"array_remove(split(coalesce({text}, ''), '[{WS}]+'), '')".replace("\\", "\\\\")


def crc_mod(doc_id: str, mod: int):
    """crc32 of the decimal id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod)).cast("int")


def pinned(df: DataFrame, column: str) -> DataFrame:
    """Keep later filters on ``column`` above its computation.

    The optimizer would push such a filter down and write the whole chain of
    expressions into it again, once for each mention inside a lambda. It does
    not push filters below a generator, so the value goes through one.
    """
    return df.withColumn(column, F.explode(F.array(F.col(column))))
