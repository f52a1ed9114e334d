"""Folders in any store that Spark reads: listings, whole replacement, scratch places."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ArchiveError

#: A listing of so many files at most is made on the driver, file by file; a longer one by the cluster.
FEW_FILES = 2000


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(bytes, milliseconds) of a file, None where there is none."""
    fs, p = _at(spark, path)
    found = fs.globStatus(p)
    m = _STATUS.search(found[0].toString()) if found else None
    return (int(m[3] or 0), int(m[4])) if m else None


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, old)
    if not fs.rename(p, _at(spark, new)[1]):
        raise ArchiveError("rename_failed", f"{old} -> {new}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse of a session on one machine.

    On a cluster every executor needs to see the folder, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ArchiveError("no_shared_folder", "set spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir")
        path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        # one machine, no folder of its own: what is left there goes when Python ends
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
        return path
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, made once and read back from a scratch folder, for callers that read them several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def below(column: str, root: str = "data"):
    """What follows ``/<root>/`` in a column of file paths, without URI escapes."""
    return F.url_decode(F.replace(F.regexp_extract(column, f"/{root}/(.*)$", 1), F.lit("+"), F.lit("%2B")))


_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+);")


def few(spark: SparkSession, root: str) -> dict[str, tuple[int, int]] | None:
    """Data file below ``root`` -> (bytes, milliseconds), or None if there are more than FEW_FILES.

    A folder's statuses come as one text, since each call to the JVM costs more than a file.
    """
    fs, p = _at(spark, root)
    if not fs.exists(p):
        return {}
    head, out, folders = f"/{root.rstrip('/').rpartition('/')[2]}/", {}, [p]
    text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString
    while folders:
        for path, folder, size, modified in _STATUS.findall(text(fs.listStatus(folders.pop()))):
            name = path.rpartition(head)[2]
            if name.rpartition("/")[2][:1] in ("_", "."):
                continue
            if folder == "true":
                folders.append(spark._jvm.org.apache.hadoop.fs.Path(path))
            else:
                out[name] = int(size), int(modified)
            if len(out) + len(folders) > FEW_FILES:
                return None
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(file, bytes, modified) of each data file below ``root``, by the cluster; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    name = root.rstrip("/").rpartition("/")[2]
    return files.select(F.regexp_extract("path", f"/{name}/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified"))


@contextmanager
def file_by_file(spark: SparkSession, root: str) -> Iterator[None]:
    """Scans that run inside give a task one file below ``root``, or a piece of one, and not as many as their bytes allow; four where there are very many."""
    cost = "spark.sql.files.openCostInBytes"
    before, whole = spark.conf.get(cost), int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    spark.conf.set(cost, str(whole if few(spark, root) is not None else whole // 4))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


@contextmanager
def dealt(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Shuffles that run inside have so many partitions, whatever the session's number, and none are merged."""
    held = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``.

    Readers see the old folder or the new one; between the two renames they see
    none, and :func:`recover` brings the old one back if the second never came.
    """
    old = f"{path}.old-{uuid.uuid4().hex}"
    if exists(spark, path):
        rename(spark, path, old)
        try:
            rename(spark, new, path)
        except Exception:
            rename(spark, old, path)
            raise
        delete(spark, old)
    else:
        fs, p = _at(spark, path)
        fs.mkdirs(p.getParent())
        rename(spark, new, path)


def recover(spark: SparkSession, path: str) -> bool:
    """Bring back what a replacement had moved aside when it ended early. True if there was something."""
    if exists(spark, path):
        return False
    fs, p = _at(spark, path)
    parent = p.getParent()
    if not fs.exists(parent):
        return False
    aside = [s.getPath() for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{p.getName()}.old-")]
    if not aside:
        return False
    return bool(fs.rename(max(aside, key=lambda x: fs.getFileStatus(x).getModificationTime()), p))
