"""COPY: a table or a query into files, whole or not at all."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import storage
from .tables import FORMATS, ArchiveError

#: Options of a copy, and what they may be.
_OPTIONS = {"compression": ("zstd", "snappy", "gzip", "none", "uncompressed", "lz4"), "header": ("true", "false"), "delimiter": None, "mode": ("errorifexists", "overwrite", "append"), "files": None}
_COPY = re.compile(
    r"\s*COPY\s+(?:\((?P<query>.*)\)|(?P<table>[\w.`]+))\s+TO\s+'(?P<path>[^']+)'"
    r"(?:\s+STORED\s+AS\s+(?P<format>\w+))?(?:\s+PARTITIONED\s+BY\s*\((?P<parts>[^)]*)\))?(?:\s+OPTIONS\s*\((?P<options>.*)\))?\s*;?\s*\Z",
    re.I | re.S,
)


def copy_to(df: DataFrame, path: str, format: str | None = None, partition_by: tuple[str, ...] = (), **options: str) -> int:
    """Write rows as files of a format (by default the one that the path's extension names) and return how many.

    The folder is made aside and then put in place. An option that is not known or not
    one of its values is an error; so is a column that is not there.
    """
    spark = df.sparkSession
    kind = FORMATS.get((format or path.rstrip("/").rpartition(".")[2]).lower())
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ArchiveError("unknown_format", format or path)
    options = {k.lower(): str(v).strip("'\"") for k, v in options.items()}
    for k, v in options.items():
        if k not in _OPTIONS or _OPTIONS[k] and v.lower() not in _OPTIONS[k] or k == "files" and not v.isdigit():
            raise ArchiveError("bad_option", f"{k}: {v}")
    if missing := [c for c in partition_by if c not in df.columns]:
        raise ArchiveError("unknown_column", missing[0])
    mode = options.pop("mode", "errorifexists").lower()
    there = storage.exists(spark, path)
    if there and mode == "errorifexists":
        raise ArchiveError("exists", path)
    if n := int(options.pop("files", 0)):
        df = df.repartition(n)
    if kind == "csv":
        options.setdefault("header", "true")
        if "delimiter" in options:
            options["sep"] = options.pop("delimiter")
    target = path if there and mode == "append" else f"{path}.new-{uuid.uuid4().hex}"
    observed = _counted(df)
    w = observed[0].write.format(kind).mode("append").options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(target)
    if target != path:
        storage.replace(spark, target, path)
    return observed[1].get["rows"]


def _counted(df: DataFrame):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation(f"copy-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def copy(spark: SparkSession, statement: str) -> DataFrame:
    """``COPY { table | (query) } TO 'path' [STORED AS format] [PARTITIONED BY (a, b)] [OPTIONS (key value, ...)]``: one row with the count."""
    m = _COPY.match(statement)
    if not m:
        raise ArchiveError("bad_copy", statement)
    df = spark.sql(m["query"]) if m["query"] else spark.table(m["table"])
    options = {}
    for pair in re.findall(r"(?:'[^']*'|[^,'])+", m["options"] or ""):
        key, _, value = pair.strip().partition(" ")
        if not value:
            raise ArchiveError("bad_option", pair)
        options[key.strip("'").rpartition(".")[2]] = value.strip().strip("'")
    n = copy_to(df, m["path"], m["format"], tuple(c.strip(" `") for c in (m["parts"] or "").split(",") if c.strip()), **options)
    return spark.createDataFrame([(n,)], "count long")
