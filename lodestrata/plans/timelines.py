"""Object histories made of the events table: a user is an object, an event a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import joins, projection, temporal
from lodestrata.sources.tables import read_table

from .registry import query

def records(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    kind = F.when(F.col("event_id") % 11 == 3, "Tombstone").when(F.col("event_id") % 7 == 2, "Snapshot").otherwise("Delta")
    props = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("type"), F.col("event_type"))).otherwise(
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k")))
    )
    return e.select(
        F.lit("User").alias("object_type"), F.lit("main").alias("branch_key"), F.md5(F.col("user_id").cast("string")).alias("goid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"),
        F.col("event_id").alias("csn"), F.lit(0).cast("long").alias("segment_id"), F.col("event_id").alias("row_index"), F.col("event_id").cast("string").alias("record_id"), kind.alias("kind"), props.alias("properties"),
    )


R_SQL = """r AS (SELECT md5(CAST(user_id AS VARCHAR)) AS goid, epoch_us(ts) AS t, event_id AS csn,
 CASE WHEN event_id % 11 = 3 THEN 'Tombstone' WHEN event_id % 7 = 2 THEN 'Snapshot' ELSE 'Delta' END AS kind,
 event_type AS type, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 3 <> 0 AS has_k FROM events)"""


def _state_sql(reset: str, brings: str, where: str = "true", tail: str = "") -> str:
    return f"""WITH {R_SQL},
o AS (SELECT *, row_number() OVER w AS ord, sum(CASE WHEN {reset} THEN 1 ELSE 0 END) OVER w AS epoch, count(*) OVER (PARTITION BY goid) AS n FROM r WHERE {where} WINDOW w AS (PARTITION BY goid ORDER BY t, csn)),
l AS (SELECT *, max(epoch) OVER (PARTITION BY goid) AS last_epoch, max(ord) OVER (PARTITION BY goid) AS last_ord FROM o),
k AS (SELECT * FROM l WHERE epoch = last_epoch)
SELECT goid, CASE WHEN arg_max(kind, ord) = 'Tombstone' THEN 'Tombstone' ELSE 'Live' END AS status, any_value(n) AS version,
 arg_max(type, ord) FILTER (WHERE {brings}) AS type, arg_max(coalesce(k, '-'), ord) FILTER (WHERE ({brings}) AND has_k) AS k
FROM k GROUP BY goid {tail}"""


CORE = ("kind = 'Snapshot'", "kind <> 'Tombstone' OR ord = 1")
FRESH = ("kind IN ('Snapshot', 'Tombstone')", "kind <> 'Tombstone'")
LIVE = "HAVING arg_max(kind, ord) <> 'Tombstone'"


def _show(states: DataFrame) -> DataFrame:
    k = F.when(F.map_contains_key("properties", "k"), F.coalesce(F.col("properties")["k"], F.lit("-")))
    return states.select("goid", "status", "version", F.col("properties")["type"].alias("type"), k.alias("k"))


@query(_state_sql(*CORE, tail=LIVE))
def temporal_latest(spark: SparkSession, d: str) -> DataFrame:
    return _show(temporal.reconstruct(records(spark, d)))


@query(_state_sql(*CORE))
def temporal_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return _show(temporal.reconstruct(records(spark, d), include_tombstones=True))


@query(_state_sql(*FRESH, where="csn <= 5000", tail=LIVE))
def temporal_asof_csn(spark: SparkSession, d: str) -> DataFrame:
    return _show(temporal.as_of(records(spark, d), csn=5000))


@query(_state_sql(*FRESH, where="t <= 1705276800000000", tail=LIVE))
def temporal_asof_ts(spark: SparkSession, d: str) -> DataFrame:
    return _show(temporal.as_of(records(spark, d), timestamp_us=1705276800000000))


@query(f"WITH {R_SQL} SELECT goid, CAST(csn AS VARCHAR) AS record_id, CAST(lag(csn) OVER (PARTITION BY goid ORDER BY t, csn) AS VARCHAR) AS prev_ref FROM r")
def temporal_history(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_previous(records(spark, d)).select("goid", "record_id", "prev_ref")


@query(f"WITH {R_SQL}, p AS (SELECT goid, csn, lag(csn) OVER (PARTITION BY goid ORDER BY t, csn) AS e FROM r) SELECT goid, CAST(csn AS VARCHAR) AS record_id, CAST(CASE WHEN csn % 100 = 7 THEN 1 ELSE e END AS VARCHAR) AS prev_ref, CAST(e AS VARCHAR) AS expected FROM p WHERE csn % 100 = 7 AND e IS DISTINCT FROM 1")
def temporal_prev_ref_check(spark: SparkSession, d: str) -> DataFrame:
    good = temporal.with_previous(records(spark, d))
    broken = good.withColumn("prev_ref", F.when(F.col("csn") % 100 == 7, "1").otherwise(F.col("prev_ref")))
    return temporal.bad_references(broken).select("goid", "record_id", "prev_ref", "expected")


@query(f"WITH {R_SQL} SELECT goid, CAST(csn AS VARCHAR) AS record_id, 'type' AS property, type AS value FROM r UNION ALL SELECT goid, CAST(csn AS VARCHAR), 'k', k FROM r WHERE has_k")
def proj_property_version(spark: SparkSession, d: str) -> DataFrame:
    return projection.property_versions(records(spark, d)).select("goid", "record_id", "property", "value")


@query(_state_sql(*FRESH, where="csn <= 7000", tail=LIVE))
def proj_asof(spark: SparkSession, d: str) -> DataFrame:
    return _show(projection.temporal_view(records(spark, d), "as_of_csn:7000"))


def _events(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = read_table(spark, d, "events").where(F.col("event_type") == kind)
    return e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


@query("WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, max(event_id) AS event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id, ts) SELECT p.user_id, p.event_id, p.t, v.event_id AS right_event_id, v.t AS right_t FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the latest view of its user before it."""
    return joins.asof_join(_events(spark, d, "purchase"), _events(spark, d, "view"), ["user_id"], "t")


@query("SELECT p.user_id, p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND epoch_us(p.ts) >= epoch_us(v.ts) AND epoch_us(p.ts) < epoch_us(v.ts) + 3600000000 WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within an hour of a view of the same user."""
    v = _events(spark, d, "view").select("user_id", F.col("event_id").alias("view_id"), F.col("t").alias("a"), (F.col("t") + 3600000000).alias("b"))
    return joins.interval_join(_events(spark, d, "purchase"), v, ["user_id"], "t", "a", "b", 3600000000).select("user_id", "event_id", "view_id")
