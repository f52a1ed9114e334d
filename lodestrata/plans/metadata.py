"""Aggregates answered from synopses, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import synopses, zones
from lodestrata.sources import metadata
from lodestrata.sources.tables import read_table

from .registry import query, stored
from .skipping import ORDERS, orders, orders_archive


def _of_orders(spark: SparkSession, d: str) -> synopses.Synopses:
    """What the orders' archive has stored, if it holds for every file."""
    return metadata.synopses(orders_archive(spark, d))


@query("SELECT o_orderstatus AS key, count(*) AS n FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) t GROUP BY 1")
def meta_merged_archives(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two archives, merged."""
    other = metadata.synopses(metadata.opened(spark, stored(spark, d, "orders", **{**ORDERS, "partitions": 2, "indexes": ()})))
    return synopses.group_count(metadata.merged([_of_orders(spark, d), other]), "o_orderstatus")


@query("SELECT count(*) AS n FROM orders")
def meta_count(spark: SparkSession, d: str) -> DataFrame:
    return synopses.count_rows(_of_orders(spark, d))


@query("SELECT count(nullif(l_discount, 0)) AS n FROM lineitem")
def meta_count_col(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "lineitem").select(zones.morsel("l_orderkey").alias("morsel"), F.expr("nullif(l_discount, 0)").alias("x"))
    return synopses.count_column(synopses.build(df, ["morsel"], ["x"]), "x")


@query("SELECT min(o_custkey) AS low, max(o_custkey) AS high FROM orders")
def meta_min_max(spark: SparkSession, d: str) -> DataFrame:
    return synopses.min_max(_of_orders(spark, d), "o_custkey")


@query("SELECT CAST(sum(o_custkey) AS DOUBLE) AS total, CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey) AS mean FROM orders")
def meta_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    return synopses.sum_avg(_of_orders(spark, d), "o_custkey")


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def meta_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return synopses.count_distinct(_of_orders(spark, d), "o_custkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')")
def meta_hist_filtered(spark: SparkSession, d: str) -> DataFrame:
    return synopses.count_where(_of_orders(spark, d), "o_orderstatus", ["F", "P", None])


@query("SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1")
def meta_hist_group(spark: SparkSession, d: str) -> DataFrame:
    return synopses.group_count(_of_orders(spark, d), "o_orderstatus")


@query("SELECT o_orderstatus AS key, count(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY 1")
def meta_guard_falls_back(spark: SparkSession, d: str) -> DataFrame:
    """Rows are hidden, so that synopses may not answer and the scan does."""
    df = orders(spark, d)
    s = synopses.build(df, ["morsel"], ["o_orderstatus"], ["o_orderstatus"], all_visible=False)
    answer = synopses.group_count(s, "o_orderstatus")
    return answer if answer is not None else df.where("o_orderkey > 100").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT CAST(floor(o_orderkey / 4096) AS BIGINT) AS morsel, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1, 2")
def zone_histogram(spark: SparkSession, d: str) -> DataFrame:
    return synopses.histogram(orders(spark, d), ["morsel"], "o_orderpriority")


@query("SELECT CAST(floor(doc_id / 4096) AS BIGINT) AS morsel, count(*) FILTER (WHERE toxic = 1) AS trues, count(*) FILTER (WHERE toxic = 0) AS falses, 0 * count(*) AS nulls FROM labels GROUP BY 1")
def bool_counts(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "labels").select(zones.morsel("doc_id").alias("morsel"), (F.col("toxic") == 1).alias("b"))
    return synopses.truth_counts(df, ["morsel"], "b")


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def topk_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return synopses.heavy_hitters(read_table(spark, d, "events"), "user_id", 10)


@query("SELECT event_type, key, n, place FROM (SELECT event_type, user_id AS key, count(*) AS n, CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS INTEGER) AS place FROM events GROUP BY 1, 2) t WHERE place <= 3")
def topk_by_zone(spark: SparkSession, d: str) -> DataFrame:
    return synopses.heavy_hitters(read_table(spark, d, "events"), "user_id", 3, ["event_type"])


@query("SELECT count(DISTINCT o_custkey) AS n, true AS close FROM orders")
def hll_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: merged sketches of zones, within 3 in 100 of the count."""
    df = orders(spark, d)
    guess = synopses.distinct_estimate(synopses.distinct_sketch(df, "o_custkey", ["morsel"])).withColumnRenamed("n", "guess")
    exact = df.agg(F.count_distinct("o_custkey").alias("n"))
    return exact.join(F.broadcast(guess)).select("n", (F.abs(F.col("guess") - F.col("n")) <= F.ceil(0.03 * F.col("n"))).alias("close"))


SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]
NEAR = "SELECT CAST(share AS DOUBLE) AS share, true AS close FROM (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) t(share)"


def _near(df: DataFrame, column: str, found: DataFrame, tolerance: float) -> DataFrame:
    """(share, close): whether each quantile's rank is within a tolerance. The quantiles are a few rows."""
    one = df.join(F.broadcast(found.withColumnRenamed("value", "guess")))
    c = F.col(column)
    ranks = one.groupBy("share").agg((F.count_if(c < F.col("guess")) / F.count(c)).alias("below"), (F.count_if(c <= F.col("guess")) / F.count(c)).alias("upto"))
    return ranks.select(F.col("share").cast("double").alias("share"), ((F.col("below") <= F.col("share") + tolerance) & (F.col("upto") >= F.col("share") - tolerance)).alias("close"))


@query(NEAR)
def kll_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles from merged KLL sketches of zones, each within 3 hundredths of its rank."""
    df = read_table(spark, d, "events")
    return _near(df, "value", synopses.quantile_estimate(synopses.quantile_sketch(df, "value", ["event_type"]), SHARES), 0.03)


@query(NEAR)
def approximate_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles by Spark's own summary, each within a hundredth of its rank."""
    df = read_table(spark, d, "events")
    return _near(df, "value", synopses.quantiles(df, "value", SHARES), 0.01)
