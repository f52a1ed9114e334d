"""Data skipping, indexes, coverage and visibility on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import predicates as P
from lodestrata.operators import coverage, joins, key_index, visibility, zones
from lodestrata.sources import archive, metadata, storage
from lodestrata.sources.tables import read_table

from .registry import query, stored

Z = "CAST(floor(o_orderkey / 4096) AS BIGINT)"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").withColumn("morsel", zones.morsel("o_orderkey"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").withColumn("morsel", zones.morsel("l_orderkey"))


#: How the orders' archive is laid out: by key, in files of some thousand rows, with indexes and histograms.
ORDERS = {"cluster_by": ("o_orderkey",), "partitions": 8, "zone_rows": zones.MORSEL_ROWS, "indexes": ("o_custkey", "o_orderkey"), "include": ("o_orderkey", "o_totalprice"), "histograms": ("o_orderstatus", "o_custkey")}


def orders_archive(spark: SparkSession, d: str) -> metadata.Archive:
    """The stored orders, opened: written once for a session, read back by every query."""
    return metadata.opened(spark, stored(spark, d, "orders", **ORDERS))


PRED = P.AND(P.pred("Between", "o_orderkey", 5000, 9000), P.OR(P.pred("Gt", "o_totalprice", 200000.0), P.pred("Eq", "o_orderstatus", "P")))
PRED_SQL = "o_orderkey BETWEEN 5000 AND 9000 AND (o_totalprice > 200000 OR o_orderstatus = 'P')"


@query(f"SELECT {Z} AS morsel, count(*) AS rows, count(*) - count(o_custkey) AS o_custkey__nulls, min(o_custkey) AS o_custkey__min, max(o_custkey) AS o_custkey__max, false AS o_custkey__nan, 0 * count(*) AS o_orderstatus__nulls, min(o_orderstatus) AS o_orderstatus__min, max(o_orderstatus) AS o_orderstatus__max, false AS o_orderstatus__nan FROM orders GROUP BY 1")
def zone_stats(spark: SparkSession, d: str) -> DataFrame:
    return zones.zone_stats(orders(spark, d), ["morsel"], ["o_custkey", "o_orderstatus"])


@query("SELECT CAST(floor(l_orderkey / 4096) AS BIGINT) AS morsel, count(*) AS rows, count(*) - count(nullif(l_discount, 0)) AS nulls, min(nullif(l_discount, 0)) AS min, max(nullif(l_discount, 0)) AS max, count(DISTINCT nullif(l_discount, 0)) AS \"distinct\", false AS constant, false AS all_null, false AS has_nan FROM lineitem GROUP BY 1")
def zone_flags(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).withColumn("x", F.expr("nullif(l_discount, 0)"))
    return zones.describe_zones(df, ["morsel"], "x")


@query(f"SELECT {Z} AS morsel, CASE WHEN min(o_orderkey) > 9000 OR max(o_orderkey) < 5000 THEN 'definitely_no' WHEN min(o_orderkey) >= 5000 AND max(o_orderkey) <= 9000 THEN 'definitely_yes' ELSE 'unknown' END AS outcome FROM orders GROUP BY 1")
def zone_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = zones.zone_stats(orders(spark, d), ["morsel"], ["o_orderkey"])
    return s.select("morsel", zones.three_valued(zones.outcome(P.pred("Between", "o_orderkey", 5000, 9000))).alias("outcome"))


@query("SELECT CAST(floor(l_orderkey / 4096) AS BIGINT) AS morsel, CASE WHEN count(nullif(l_discount, 0)) = count(*) THEN 'definitely_no' ELSE 'unknown' END AS is_null, CASE WHEN count(nullif(l_discount, 0)) = count(*) THEN 'definitely_yes' ELSE 'unknown' END AS is_not_null FROM lineitem GROUP BY 1")
def zone_null_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = zones.zone_stats(lines(spark, d).withColumn("x", F.expr("nullif(l_discount, 0)")), ["morsel"], ["x"])
    return s.select("morsel", *(zones.three_valued(zones.outcome(P.pred(op, "x"))).alias(n) for op, n in (("IsNull", "is_null"), ("IsNotNull", "is_not_null"))))


@query("SELECT a, b, CASE WHEN a = 0 OR b = 0 THEN 0 WHEN a = 2 THEN b WHEN b = 2 THEN a WHEN a = 1 OR b = 1 THEN 1 ELSE 3 END AS both_of, CASE WHEN a = 2 OR b = 2 THEN 2 WHEN a = 0 THEN b WHEN b = 0 THEN a WHEN a = 1 OR b = 1 THEN 1 ELSE 3 END AS either, CASE a WHEN 2 THEN 0 WHEN 0 THEN 3 ELSE a END AS no_of FROM (VALUES (0), (1), (2), (3)) x(a), (VALUES (0), (1), (2), (3)) y(b)")
def outcome_algebra(spark: SparkSession, d: str) -> DataFrame:
    v = spark.range(16).select((F.col("id") % 4).cast("int").alias("a"), F.expr("cast(id div 4 as int)").alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("a", "b", zones.outcome_and(a, b).alias("both_of"), zones.outcome_or(a, b).alias("either"), zones.outcome_not(a, F.lit(False)).alias("no_of"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {PRED_SQL}")
def pruned_scan_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Through the stored statistics: files that cannot match are not opened."""
    return archive.read(spark, orders_archive(spark, d).path, PRED).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {PRED_SQL}")
def pruned_zones_equal_full(spark: SparkSession, d: str) -> DataFrame:
    """Through statistics of this table's zones, made on the way."""
    df = orders(spark, d)
    stats = zones.zone_stats(df, ["morsel"], ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return zones.pruned_scan(df, ["morsel"], stats, PRED).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey < 0) AS low FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey - 1000000000 FROM orders) t WHERE o_orderkey < 100")
def pruned_stale_archive(spark: SparkSession, d: str) -> DataFrame:
    """A file that came after the metadata is read, whatever the statistics of the others prove."""
    path = storage.scratch(spark, "stale")
    df = read_table(spark, d, "orders")
    archive.write(df, path, archive.WriteOptions(cluster_by=("o_orderkey",), partitions=4))
    df.withColumn("o_orderkey", F.col("o_orderkey") - 1_000_000_000).coalesce(1).write.mode("append").parquet(f"{path}/data")
    return archive.read(spark, path, P.pred("Lt", "o_orderkey", 100)).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") < 0).alias("low"))


@query("SELECT 'read' AS what, count(*) AS n FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'pruned', 1")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a selective scan, and whether its counters show files that were left out."""
    a = orders_archive(spark, d)
    p = P.pred("Eq", "o_custkey", 42)
    shown = metadata.counters(a, P.AND(p, P.pred("Lt", "o_orderkey", 100))).select(F.lit("pruned").alias("what"), F.when(F.col("files_pruned") > 0, 1).otherwise(0).cast("long").alias("n"))
    return archive.read(spark, a.path, p).agg(F.count("*").alias("n")).select(F.lit("read").alias("what"), "n").union(shown)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 77")
def late_materialised_scan(spark: SparkSession, d: str) -> DataFrame:
    return archive.read_late(spark, orders_archive(spark, d).path, P.pred("Eq", "o_custkey", 77), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 6, 1234)")
def lookup_only_scan(spark: SparkSession, d: str) -> DataFrame:
    """Through the index alone: no zone is looked at."""
    return archive.lookup(spark, orders_archive(spark, d).path, "o_custkey", [5, 6, 1234]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_custkey < 300")
def hilbert_archive(spark: SparkSession, d: str) -> DataFrame:
    path = stored(spark, d, "orders", curve=("o_totalprice", "o_custkey"), curve_kind="hilbert", partitions=8)
    return archive.read(spark, path, P.AND(P.pred("Between", "o_totalprice", 100000.0, 150000.0), P.pred("Lt", "o_custkey", 300))).select("o_orderkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    o, c = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), read_table(spark, d, "customer").where("c_acctbal > 0")
    return joins.salted_join(o, c, ["c_custkey"], 4, "left").select("o_orderkey", "c_mktsegment")


@query("WITH v AS (SELECT * FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT v.event_id, b.event_id AS last_event_id FROM v ASOF LEFT JOIN b ON v.user_id = b.user_id AND v.ts >= b.ts")
def join_asof_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Each view with its user's last purchase, a day's events of a user at a time."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views, buys = e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", "at", "event_id")
    return joins.asof_join(views, buys, ["user_id"], "at", prefix="last_", step=86_400_000_000).select("event_id", "last_event_id")


@query(f"SELECT {Z} AS morsel, count(*) AS rows, CASE WHEN min(o_orderkey) > 9000 OR max(o_orderkey) < 5000 THEN 'pruned' ELSE 'kept' END AS decision, CASE WHEN min(o_orderkey) > 9000 OR max(o_orderkey) < 5000 THEN 'Between:o_orderkey' ELSE 'none' END AS evidence FROM orders GROUP BY 1")
def explain_pruning(spark: SparkSession, d: str) -> DataFrame:
    stats = zones.zone_stats(orders(spark, d), ["morsel"], ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return zones.explain_pruning(stats, ["morsel"], PRED).drop("outcome")


@query("WITH z AS (SELECT floor(o_orderkey / 4096) AS m, count(*) AS n, min(o_orderkey) > 9000 OR max(o_orderkey) < 5000 AS no FROM orders GROUP BY 1) SELECT count(*) AS zones, count(*) FILTER (WHERE no) AS zones_pruned, 0 * count(*) AS zones_whole, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE no), 0) AS BIGINT) AS rows_pruned FROM z")
def plan_cost(spark: SparkSession, d: str) -> DataFrame:
    return zones.plan_cost(zones.zone_stats(orders(spark, d), ["morsel"], ["o_orderkey", "o_totalprice", "o_orderstatus"]), PRED)


@query("SELECT DISTINCT CAST(floor(l_orderkey / 4096) AS BIGINT) AS morsel, l_returnflag AS key FROM lineitem")
def exact_set(spark: SparkSession, d: str) -> DataFrame:
    return zones.exact_sets(lines(spark, d), ["morsel"], "l_returnflag")


@query(f"SELECT o_orderpriority AS key, array_to_string(list_sort(list(DISTINCT {Z})), ',') AS zones FROM orders GROUP BY 1")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return zones.inverted_index(orders(spark, d), ["morsel"], "o_orderpriority").select("key", F.array_join(F.col("zones").cast("array<string>"), ",").alias("zones"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 11, 1400)")
def inverted_lookup_scan(spark: SparkSession, d: str) -> DataFrame:
    df, keys = orders(spark, d), [7, 11, 1400]
    held = zones.zones_of_keys(zones.exact_sets(df, ["morsel"], "o_custkey"), ["morsel"], keys)
    return zones.pruned_scan(df, ["morsel"], None, P.pred("InSet", "o_custkey", keys), held).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R') AND l_linestatus IN ('F') AND l_quantity = 50")
def composite_zone(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d)
    held = zones.composite_zones(df, ["morsel"], ["l_returnflag", "l_linestatus", "l_quantity"]).where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity = 50").select("morsel")
    p = P.AND(P.pred("InSet", "l_returnflag", ["R"]), P.pred("InSet", "l_linestatus", ["F"]), P.pred("Eq", "l_quantity", 50.0))
    return zones.pruned_scan(df, ["morsel"], None, p, held).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def bloom_scan(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    held = zones.bloom_zones(zones.bloom_index(df, ["morsel"], "o_custkey"), ["morsel"], F.lit(77).cast("long"))
    return zones.pruned_scan(df, ["morsel"], None, P.pred("Eq", "o_custkey", 77), held).select("o_orderkey")


@query(f"SELECT morsel, place, value FROM (SELECT {Z} AS morsel, o_totalprice AS value, CAST(row_number() OVER (PARTITION BY {Z} ORDER BY o_totalprice DESC) AS INTEGER) AS place FROM orders) t WHERE place <= 3")
def topn_zone(spark: SparkSession, d: str) -> DataFrame:
    return zones.top_n_summary(orders(spark, d), ["morsel"], "o_totalprice", 3)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topn_hinted_scan(spark: SparkSession, d: str) -> DataFrame:
    """Stored bounds give a value that at least 15 rows reach; rows below it need no sort, and files below it are not opened. The sort is kept."""
    return metadata.top_n(orders_archive(spark, d), "o_totalprice", 15, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topn_zone_scan(spark: SparkSession, d: str) -> DataFrame:
    df = orders(spark, d)
    held = zones.top_n_zones(zones.top_n_summary(df, ["morsel"], "o_totalprice", 15), ["morsel"], 15)
    return df.join(held, "morsel", "left_semi").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CAST(list_sum(list_transform(range(6), lambda i: ((p_size >> i) & 1) * (1 << (2 * i)) + (((p_partkey % 64) >> i) & 1) * (2 << (2 * i)))) AS BIGINT) AS z FROM part")
def z_order_key(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", zones.z_order(F.col("p_size"), F.col("p_partkey") % 64, bits=6).alias("z"))


@query("SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS rank FROM (SELECT DISTINCT p_brand AS value FROM part) t")
def domain_ranks(spark: SparkSession, d: str) -> DataFrame:
    return zones.domain(read_table(spark, d, "part"), "p_brand")


@query("WITH r AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS rank FROM (SELECT DISTINCT p_brand AS value FROM part) t) SELECT CAST(floor(p_partkey / 4096) AS BIGINT) AS morsel, min(rank) AS low_rank, max(rank) AS high_rank FROM part JOIN r ON p_brand = value GROUP BY 1")
def domain_rank_ranges(spark: SparkSession, d: str) -> DataFrame:
    return zones.domain_rank_ranges(read_table(spark, d, "part").withColumn("morsel", zones.morsel("p_partkey")), ["morsel"], "p_brand")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT (o_custkey < 100 AND o_orderstatus <> 'P')")
def predicate_normal_form(spark: SparkSession, d: str) -> DataFrame:
    p = P.AND(P.OR(P.pred("Eq", "o_orderstatus", "F"), P.pred("Gt", "o_totalprice", 300000.0)), P.NOT(P.AND(P.pred("Lt", "o_custkey", 100), P.pred("NotEq", "o_orderstatus", "P"))))
    return orders(spark, d).where(P.to_column(P.normal_form(p, "dnf"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey >= 20 AND o_custkey <= 30 AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_language(spark: SparkSession, d: str) -> DataFrame:
    p = P.AND(*map(P.parse_filter, ("o_custkey gte 20", "o_custkey lte 30", "o_orderpriority in (1-URGENT,5-LOW)", "o_orderkey is_not_null")))
    return orders(spark, d).where(P.to_column(p)).select("o_orderkey")


@query("SELECT policy, n FROM (SELECT 'SqlWhere' AS policy, count(*) AS n FROM lineitem WHERE nullif(l_discount, 0) < 0.05 UNION ALL SELECT 'NullIncluded', count(*) FROM lineitem WHERE l_discount < 0.05 UNION ALL SELECT 'NullOnly', count(*) FROM lineitem WHERE l_discount = 0 UNION ALL SELECT 'NullExcluded', count(*) FROM lineitem WHERE nullif(l_discount, 0) < 0.05) t")
def null_policies(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).withColumn("x", F.expr("nullif(l_discount, 0)"))
    p = P.pred("Lt", "x", 0.05)
    counts = df.agg(*(F.count_if(P.with_null_policy(p, n)).alias(n) for n in P.NULL_POLICIES[:4]))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, counts.columns)), F.array(*counts.columns))).alias("policy", "n"))


# secondary indexes
def custkeys(spark: SparkSession, d: str) -> tuple[DataFrame, key_index.KeyIndex]:
    df = orders(spark, d)
    return df, key_index.build(df, "o_custkey", ["morsel"], "o_orderkey", fingerprint=d)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 99")
def index_eq(spark: SparkSession, d: str) -> DataFrame:
    a = orders_archive(spark, d)
    return metadata.fetch(a, key_index.lookup_eq(metadata.index(a, "o_custkey"), 99), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 10 AND o_custkey <= 14")
def index_range(spark: SparkSession, d: str) -> DataFrame:
    a = orders_archive(spark, d)
    return metadata.fetch(a, key_index.lookup_range(metadata.index(a, "o_custkey"), 10, 14, low_open=True)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3, 100000)")
def index_membership(spark: SparkSession, d: str) -> DataFrame:
    df, i = custkeys(spark, d)
    return key_index.fetch(df, i, key_index.lookup_in(i, [1, 2, 3, 100000])).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey AS key, s_suppkey IN (SELECT o_custkey FROM orders) AS present FROM supplier")
def index_membership_answer(spark: SparkSession, d: str) -> DataFrame:
    return key_index.membership(custkeys(spark, d)[1], read_table(spark, d, "supplier").select("s_suppkey"))


@query("SELECT count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high, count(DISTINCT o_custkey) AS kinds, count(*) > 0 AS some FROM orders")
def index_only_aggregates(spark: SparkSession, d: str) -> DataFrame:
    i = custkeys(spark, d)[1]
    out = None
    for kind, name in (("count", "n"), ("min", "low"), ("max", "high"), ("distinct_count", "kinds"), ("exists", "some")):
        part = key_index.aggregate(i, kind).withColumnRenamed("answer", name)
        out = part if out is None else out.join(F.broadcast(part))
    return out


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'ECONOMY%'")
def index_prefix(spark: SparkSession, d: str) -> DataFrame:
    df = read_table(spark, d, "part").withColumn("morsel", zones.morsel("p_partkey"))
    i = key_index.build(df, "p_type", ["morsel"], "p_partkey")
    return key_index.fetch(df, i, key_index.lookup_prefix(i, "ECONOMY")).select("p_partkey")


@query("WITH h AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 100000), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM h) SELECT CAST(0 AS BIGINT) AS file, min(k) AS start, count(*) AS length FROM g GROUP BY island")
def coverage_coalesce(spark: SparkSession, d: str) -> DataFrame:
    hit = orders(spark, d).where("o_totalprice > 100000").select(F.lit(0).cast("long").alias("file"), F.col("o_orderkey").alias("start"), F.lit(1).cast("long").alias("length"))
    return coverage.coalesce_ranges(hit, ["file"])


def _fragments(spark: SparkSession, d: str, where: str) -> DataFrame:
    return read_table(spark, d, "lineitem").where(where).select(F.expr("l_partkey div 16").alias("fragment")).distinct()


@query("SELECT DISTINCT l_partkey // 16 AS fragment FROM lineitem WHERE l_quantity = 1 OR l_quantity = 2")
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    return coverage.union(_fragments(spark, d, "l_quantity = 1"), _fragments(spark, d, "l_quantity = 2"))


@query("SELECT l_partkey // 16 AS fragment FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT l_partkey // 16 AS fragment FROM lineitem WHERE l_quantity = 2")
def coverage_intersection(spark: SparkSession, d: str) -> DataFrame:
    return coverage.intersection(_fragments(spark, d, "l_quantity = 1"), _fragments(spark, d, "l_quantity = 2"))


@query("WITH a AS (SELECT DISTINCT l_partkey // 16 AS f FROM lineitem WHERE l_quantity = 1), b AS (SELECT DISTINCT l_partkey // 16 AS f FROM lineitem) SELECT (SELECT count(*) FROM a) AS covered, (SELECT count(*) FROM b) AS fragments, (SELECT count(*) FROM a) * 1000000 // (SELECT count(*) FROM b) AS ppm")
def coverage_degree(spark: SparkSession, d: str) -> DataFrame:
    return coverage.degree_ppm(_fragments(spark, d, "l_quantity = 1"), _fragments(spark, d, "true"))


# visibility
RANGES = [(0, 100, 50), (0, 120, 100), (0, 5000, 1), (0, 9000, 3000), (0, 400, 0)]


def _overlay(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "file int, start long, length long")


DELETED = "(o_orderkey BETWEEN 100 AND 219 OR o_orderkey = 5000 OR o_orderkey BETWEEN 9000 AND 11999)"


@query(f"SELECT o_orderkey FROM orders WHERE NOT {DELETED}")
def overlay_deleted_ranges(spark: SparkSession, d: str) -> DataFrame:
    return visibility.apply_overlay(orders(spark, d).withColumn("file", F.lit(0)), ["file"], "o_orderkey", "DeletedRanges", _overlay(spark)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE {DELETED}")
def overlay_visible_ranges(spark: SparkSession, d: str) -> DataFrame:
    return visibility.apply_overlay(orders(spark, d).withColumn("file", F.lit(0)), ["file"], "o_orderkey", "VisibleRanges", _overlay(spark)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def overlay_bitmap(spark: SparkSession, d: str) -> DataFrame:
    gone = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit(0).alias("file"), F.col("c_custkey").alias("row"))
    return visibility.apply_overlay(orders(spark, d).withColumn("file", F.lit(0)), ["file"], "o_orderkey", "DeletedBitmap", gone).select("o_orderkey")


@query("SELECT CAST(0 AS INTEGER) AS file, count(*) - 3121 AS visible FROM orders")
def overlay_visible_count(spark: SparkSession, d: str) -> DataFrame:
    files = orders(spark, d).groupBy(F.lit(0).alias("file")).agg(F.count("*").alias("rows"))
    return visibility.visible_count(files, "DeletedRanges", _overlay(spark))


@query("SELECT * FROM (VALUES ('prune', false, 'allowed'), ('prune', true, 'allowed'), ('scan', false, 'apply_overlay'), ('scan', true, 'apply_overlay'), ('lookup', false, 'apply_overlay'), ('lookup', true, 'apply_overlay'), ('exact_domain', false, 'forbidden'), ('exact_domain', true, 'allowed'), ('exact_aggregate', false, 'forbidden'), ('exact_aggregate', true, 'allowed')) t(operation, aware, decision)")
def overlay_decision_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = [(o, a, visibility.overlay_decision(o, True, a)) for o in ("prune", "scan", "lookup", "exact_domain", "exact_aggregate") for a in (False, True)]
    return spark.createDataFrame(rows, "operation string, aware boolean, decision string")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN '***' ELSE c_name END AS c_name FROM customer")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"column": "c_acctbal", "policy": "Hide", "when": "c_acctbal < 0"}, {"column": "c_name", "policy": "Placeholder", "placeholder": "***", "when": "c_mktsegment = 'BUILDING'"}]
    return visibility.redact(read_table(spark, d, "customer"), rules).select("c_custkey", "c_acctbal", "c_name")
