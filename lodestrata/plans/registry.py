"""Where queries and the SQL that checks them meet."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources import archive, storage
from lodestrata.sources.tables import TABLES, read_table

_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, **options: object) -> str:
    """The archive of a table, with its metadata, below the session's shared folder; written once for a session and a state of the table."""
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path, storage.stamp(spark, path), tuple(sorted(options.items()))
    if key not in _stored or not storage.exists(spark, _stored[key]):
        where = storage.scratch(spark, f"archive-{name}")
        archive.write(read_table(spark, sf_dir, name), where, archive.WriteOptions(**options))
        _stored[key] = where
    return _stored[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with the oracle's SQL if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a SQL text over the tables; the oracle runs the same text unless it has its own dialect."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            read_table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text
