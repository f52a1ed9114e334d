"""Archives, conversions, exports and streams, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.sources import archive, copying, storage, tables
from lodestrata.streaming import ingest

from .registry import query, stored


def _folder(spark: SparkSession) -> str:
    return storage.scratch(spark, "formats")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey BETWEEN 100 AND 120 AND o_orderstatus <> 'O'")
def archive_pruned_read(spark: SparkSession, d: str) -> DataFrame:
    path = stored(spark, d, "orders", cluster_by=("o_custkey",), bloom=("o_custkey",), partitions=4)
    return archive.read(spark, path, P.AND(P.pred("Between", "o_custkey", 100, 120), P.pred("NotEq", "o_orderstatus", "O"))).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS findings FROM supplier")
def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    path = stored(spark, d, "supplier", partitions=3)
    bad = archive.verify(spark, path).agg(F.count("*").alias("findings"))
    return archive.scan_manifest(spark, path).agg(F.count("*").alias("rows")).join(F.broadcast(bad))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def convert_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, n = _folder(spark), tables.read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n.write.option("header", True).csv(f"{path}.csv")
    archive.convert(spark, f"{path}.csv", path)
    return archive.read(spark, path)


KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def convert_orc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    tables.read_table(spark, d, "orders").select(*KEPT).write.orc(f"{path}.orc")
    archive.convert(spark, f"{path}.orc", path, archive.WriteOptions(cluster_by=("o_custkey",)))
    return archive.read(spark, path)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def convert_parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    tables.read_table(spark, d, "orders").select(*KEPT).write.parquet(f"{path}.parquet")
    archive.convert(spark, f"{path}.parquet", path, archive.WriteOptions(cluster_by=("o_orderkey",)))
    return archive.read(spark, path)


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def copy_query(spark: SparkSession, d: str) -> DataFrame:
    """COPY of a query into files; the count is of what the files hold."""
    path = _folder(spark)
    tables.read_table(spark, d, "orders").createOrReplaceTempView("orders")
    copying.copy(spark, f"COPY (SELECT * FROM orders WHERE o_orderstatus = 'F') TO '{path}' STORED AS PARQUET PARTITIONED BY (o_orderpriority) OPTIONS (compression 'zstd')")
    return spark.read.parquet(path).agg(F.count("*").alias("count"))


@query("SELECT 'first' AS version, count(*) AS n FROM customer UNION ALL SELECT 'second', count(*) FROM customer WHERE c_acctbal > 0")
def replaced_archive(spark: SparkSession, d: str) -> DataFrame:
    """An archive before and after it is replaced as a whole."""
    path, c = _folder(spark), tables.read_table(spark, d, "customer")
    archive.write(c, path)
    first = spark.createDataFrame([("first", archive.read(spark, path).count())], "version string, n long")
    archive.write(c.where("c_acctbal > 0"), path, archive.WriteOptions(mode="overwrite"))
    return first.union(archive.read(spark, path).agg(F.count("*").alias("n")).select(F.lit("second"), "n"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def convert_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, r = _folder(spark), tables.read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    r.write.json(f"{path}.jsonl")
    archive.convert(spark, f"{path}.jsonl", path, schema=r.schema)
    return archive.read(spark, path)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
def export_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    archive.write_partitioned(tables.read_table(spark, d, "customer"), path, "c_mktsegment")
    return spark.read.parquet(path).where("c_mktsegment = 'AUTOMOBILE'").select("c_custkey", "c_mktsegment")


@query("SELECT 'create' AS kind, 'CREATE TABLE \"customer\" (\"c_custkey\" BIGINT, \"c_name\" VARCHAR);' AS statement UNION ALL SELECT 'insert', 'INSERT INTO \"customer\" VALUES (' || c_custkey || ', ''' || c_name || ''');' FROM customer")
def sql_export(spark: SparkSession, d: str) -> DataFrame:
    return archive.sql_export(tables.read_table(spark, d, "customer").select("c_custkey", "c_name"), "customer")


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS json FROM customer")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    return archive.json_rows(tables.read_table(spark, d, "customer").select("c_custkey", "c_name"))


@query("WITH RECURSIVE s AS (SELECT n_regionkey AS k, n_name AS p, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), c AS (SELECT k, i, sha256('' || p) AS h FROM s WHERE i = 1 UNION ALL SELECT s.k, s.i, sha256(c.h || s.p) FROM c JOIN s ON s.k = c.k AND s.i = c.i + 1) SELECT k AS n_regionkey, CAST(max(i) AS INTEGER) AS n, arg_max(h, i) AS head FROM c GROUP BY k")
def digest_chain(spark: SparkSession, d: str) -> DataFrame:
    return archive.trust_chain(tables.read_table(spark, d, "nation"), ["n_regionkey"], ["n_nationkey"], F.col("n_name"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: micro-batches become snapshots, which are then read as one table."""
    path, e = _folder(spark), tables.read_table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d if "://" in d else f"file://{d}")
    ingest.ingest(stream, f"{path}/out", f"{path}/check", keys=["event_id"]).awaitTermination()
    return ingest.snapshots(spark, f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))
