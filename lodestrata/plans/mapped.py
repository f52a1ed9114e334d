"""Customers, orders and suppliers as three sources of one mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import canonical as K
from lodestrata.operators import mapping as M
from lodestrata.operators.projection import Output, Projection, Projector, project_evidence
from lodestrata.sources.tables import read_table

from .registry import query

KEY = (M.Component("name", "key"),)
MAPPING = M.Mapping(
    bytes(range(16)), "1",
    (M.Source("customer", 2, "internal", 1, ("retain",)), M.Source("crm", 1, "restricted", 5, ("private", "retain")), M.Source("orders", 3)),
    (
        M.Rule("customer", "customer", "Party", (M.Component("key", "key", "utf8", ("trim_lower",)),), (M.Property("segment", "segment", conflict="source_priority_wins"), M.Property("nation", "nation", conflict="source_priority_wins"))),
        M.Rule("crm", "crm", "Party", (M.Component("key", "key", "utf8", ("trim_lower",)),), (M.Property("segment", "segment", conflict="source_priority_wins"),), operation="PatchProperty"),
        M.Rule("order", "orders", "Order", (M.Component("key", "okey", "int64"),), (M.Property("status", "status"), M.Property("price", "price"))),
        M.Rule("maybe", "crm", "Party", (M.Component("segment", "segment"),), merge_class="candidate"),
    ),
    (M.Association("placed", "placed", "orders", "order", "customer", (M.Component("key", "ckey", "utf8", ("trim_lower",)),)),),
)


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three sources: all customers, all orders, and a derived CRM extract, which as such extracts do knows some of the customers (every third)."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    return {
        "customer": c.select(F.col("c_custkey").alias("row_index"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation")),
        "crm": c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_index"), F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("key"), F.when(F.col("c_custkey") % 2 == 0, "VIP").alias("segment")),
        "orders": o.select(F.col("o_orderkey").alias("row_index"), F.col("o_orderkey").alias("okey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("price"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("ckey")),
    }


def _key_sql(rule: str, type_id: int, value: str) -> str:
    """The key tuple of one utf8 component in hexadecimal, little-endian lengths written byte by byte."""
    le = lambda n, size: "".join(f"{n >> 8 * i & 255:02X}" for i in range(size))
    text = lambda s: le(len(s), 8) + s.encode().hex().upper()
    head = b"JOIN-KEY-V1".hex().upper() + le(type_id, 4) + text(rule) + le(1, 4) + text("key") + text("utf8") + "01"
    return f"'{head}' || printf('%02X', strlen({value})) || '00000000000000' || hex({value})"


def _goid_sql(rule: str, type_id: int, value: str) -> str:
    le = lambda n, size: "".join(f"{n >> 8 * i & 255:02X}" for i in range(size))
    text = lambda s: le(len(s), 8) + s.encode().hex().upper()
    head = le(16, 8) + bytes(range(16)).hex().upper() + text("1") + le(4, 8) + le(type_id, 4) + text(rule)
    key = f"({_key_sql(rule, type_id, value)})"
    size = f"(printf('%02X', (length({key}) // 2) % 256) || printf('%02X', (length({key}) // 2) // 256) || '000000000000')"
    return f"substr(sha256(unhex('{head}' || {size} || {key} || '{'0' * 16}')), 1, 32)"


PARTY = MAPPING.types()["Party"]
NAME = "lower(c_name)"
#: Each customer's object, under either rule.
IDS = f"ids AS (SELECT c_custkey, 'customer' AS rule_id, {_goid_sql('customer', PARTY, NAME)} AS goid FROM customer UNION ALL SELECT c_custkey, 'crm', {_goid_sql('crm', PARTY, NAME)} FROM customer WHERE c_custkey % 3 = 0)"


@query(f"SELECT c_custkey AS row_index, sha256(unhex({_key_sql('customer', PARTY, NAME)})) AS key_digest FROM customer")
def map_join_keys(spark: SparkSession, d: str) -> DataFrame:
    ids = M.identities(MAPPING, sources(spark, d))
    return ids.where("rule_id = 'customer'").select("row_index", "key_digest")


@query(f"WITH {IDS} SELECT c_custkey AS row_index, rule_id, goid FROM ids")
def map_goid(spark: SparkSession, d: str) -> DataFrame:
    return M.identities(MAPPING, sources(spark, d)).where("rule_id in ('customer', 'crm')").select("row_index", "rule_id", "goid")


@query("SELECT c_custkey, trim(c_mktsegment) AS trimmed, lower(c_mktsegment) AS lowered, sha256(c_mktsegment) AS hashed, nfc_normalize(c_name || 'é') AS nfc, CAST(c_nationkey AS VARCHAR) AS parsed, c_name || '|' || c_mktsegment AS joined FROM customer")
def map_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    seg = F.concat(F.lit("\t "), F.col("c_mktsegment"), F.lit("  "))
    return c.select(
        "c_custkey", K.canonicalise(seg, ["trim"]).alias("trimmed"), K.canonicalise(seg, ["trim_lower"]).alias("lowered"), K.canonicalise(F.col("c_mktsegment"), ["identity", "sha256_hex"]).alias("hashed"),
        K.canonicalise(F.concat("c_name", F.lit("é")), ["unicode_nfc"]).alias("nfc"), K.canonicalise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")), ["parse_int64"]).alias("parsed"), K.concat_delimited(F.col("c_name"), F.col("c_mktsegment")).alias("joined"),
    )


# a mapping in which both sources' keys are one rule's, so that rows merge
MERGED = M.Mapping(bytes(16), "1", MAPPING.sources[:2], tuple(M.Rule("party", s, "Party", (M.Component("key", "key", "utf8", ("trim_lower",)),), (M.Property("segment", "segment", conflict="source_priority_wins"),)) for s in ("customer",)), do_not_merge=(("customer:3", "customer:5"), ("customer:4", "customer:4")))


def stacked(spark: SparkSession, d: str) -> DataFrame:
    """Identities of customers and of their records in the second source under one rule."""
    s = sources(spark, d)
    one = M.identities(MERGED, {"customer": s["customer"]})
    two = M.identities(MERGED, {"customer": s["crm"].withColumn("nation", F.lit(""))}).withColumns({"source_id": F.lit("crm"), "source_order": F.lit(1)})
    return one.unionByName(two)


@query("SELECT 'customer:' || c_custkey AS anchor, 'customer:' || c_custkey AS member FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'crm:' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def map_identity_groups(spark: SparkSession, d: str) -> DataFrame:
    return M.equivalences(stacked(spark, d)).select("anchor", "member")


@query("SELECT 'customer:4' AS a, 'customer:4' AS b")
def map_do_not_merge(spark: SparkSession, d: str) -> DataFrame:
    return M.check_do_not_merge(MERGED, stacked(spark, d)).select("a", "b")


@query("SELECT 'crm' AS source_id, c_custkey AS row_index, 'maybe' AS rule_id FROM customer WHERE c_custkey % 3 = 0")
def map_candidates(spark: SparkSession, d: str) -> DataFrame:
    return M.candidates(M.identities(MAPPING, sources(spark, d))).select("source_id", "row_index", "rule_id")


@query("SELECT 'customer' AS rule_id, c_custkey AS row_index, 'Baseline' AS record_kind FROM customer UNION ALL SELECT 'crm', c_custkey, 'Delta' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'order', o_orderkey, 'Baseline' FROM orders")
def map_objects(spark: SparkSession, d: str) -> DataFrame:
    return M.objects(M.identities(MAPPING, sources(spark, d))).select("rule_id", "row_index", "record_kind")


def _merged_values(spark: SparkSession, d: str) -> DataFrame:
    """Both sources' segment of each customer, asserted of one object."""
    s = sources(spark, d)
    a = s["customer"].select("row_index", F.col("segment").alias("value"), F.lit("customer").alias("source_id"), F.lit(2).alias("priority"), F.lit(0).alias("source_order"))
    b = s["crm"].select("row_index", F.col("segment").alias("value"), F.lit("crm").alias("source_id"), F.lit(1).alias("priority"), F.lit(1).alias("source_order"))
    return a.union(b).withColumns({"goid": F.col("row_index").cast("string"), "property": F.lit("segment"), "policy": F.lit("source_priority_wins"), "assertion_id": F.concat(F.col("source_id"), F.lit(".segment"))})


@query("SELECT c_custkey AS row_index, 'customer' AS source_id, CASE WHEN c_custkey % 6 = 0 THEN 'suppressed' ELSE 'won' END AS fate FROM customer UNION ALL SELECT c_custkey, 'crm', CASE WHEN c_custkey % 2 = 0 THEN 'won' ELSE 'null' END FROM customer WHERE c_custkey % 3 = 0")
def map_conflict_priority(spark: SparkSession, d: str) -> DataFrame:
    return M.resolve(_merged_values(spark, d)).select("row_index", "source_id", "fate")


@query("SELECT CAST(c_custkey AS VARCHAR) AS goid, CAST(2 AS BIGINT) AS kinds FROM customer WHERE c_custkey % 6 = 0")
def map_conflict_reject(spark: SparkSession, d: str) -> DataFrame:
    return M.conflicts(_merged_values(spark, d).withColumn("policy", F.lit("reject_conflict"))).select("goid", "kinds")


@query(f"WITH {IDS} SELECT o_orderkey AS row_index, goid AS target_goid FROM orders JOIN customer ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') JOIN ids ON ids.c_custkey = customer.c_custkey AND rule_id = 'customer'")
def map_associations(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    return M.associations(MAPPING, s, M.identities(MAPPING, s)).select("row_index", "target_goid")


@query("SELECT kind AS output_kind, n FROM (SELECT 'object' AS kind, (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'property', 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + 2 * (SELECT count(*) FROM orders)) t")
def map_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    ids = M.identities(MAPPING, s)
    return M.evidence(M.objects(ids), M.resolve(M.property_values(MAPPING, s, ids))).groupBy("output_kind").agg(F.count("*").alias("n"))


@query("SELECT 'Fact' AS operation, 'Baseline' AS record_kind, (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) + (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'PatchProperty', 'Delta', count(*) FROM customer WHERE c_custkey % 3 = 0")
def map_operations(spark: SparkSession, d: str) -> DataFrame:
    return M.operation_counts(MAPPING, M.identities(MAPPING, sources(spark, d)))


@query("SELECT c_custkey AS row_index, CAST(CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 1 END AS INTEGER) AS rank, CASE WHEN c_custkey % 3 = 0 THEN 'restricted' ELSE 'internal' END AS labels, CASE WHEN c_custkey % 3 = 0 THEN 'private,retain' ELSE 'retain' END AS policies FROM customer")
def map_governance(spark: SparkSession, d: str) -> DataFrame:
    ids = stacked(spark, d)
    g = M.governance(MAPPING, M.objects(ids))
    anchor = ids.where("source_id = 'customer'").select("goid", "row_index")
    return g.join(anchor, "goid").select("row_index", "rank", F.array_join("labels", ",").alias("labels"), F.array_join("policies", ",").alias("policies"))


@query("WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS m, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer WHERE c_custkey % 6 = 0) AS v) SELECT CAST(3 AS BIGINT) AS sources, c + m + o AS rows, c + m + o AS materialised, c + m + o AS objects, m AS candidates, 2 * c + v + 2 * o AS property_values, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey) AS associations FROM n")
def map_report(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    ids = M.identities(MAPPING, s)
    return M.report(MAPPING, ids, M.property_values(MAPPING, s, ids), M.associations(MAPPING, s, ids))


@query("SELECT * FROM (VALUES ('source', 'crm', 'changed'), ('rule', 'maybe', 'removed'), ('version', 'version', 'changed')) t(section, id, change)")
def map_diff(spark: SparkSession, d: str) -> DataFrame:
    new = M.Mapping(MAPPING.id, "2", (MAPPING.sources[0], M.Source("crm", 9), MAPPING.sources[2]), MAPPING.rules[:3], MAPPING.associations)
    return M.diff(spark, MAPPING, new)


# projections: parties and their orders, ids shortened to table keys so that SQL can follow
def model(spark: SparkSession, d: str) -> Projector:
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    text = lambda x: F.col(x).cast("string")
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    objs = c.select(F.concat(F.lit("c"), text("c_custkey")).alias("goid"), F.lit("Party").alias("object_type"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.lit("balance"), F.col("c_acctbal").cast("decimal(15,2)").cast("string")).alias("properties")).unionByName(
        o.select(F.concat(F.lit("o"), text("o_orderkey")).alias("goid"), F.lit("Order").alias("object_type"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), price, F.lit("key"), F.lpad(text("o_orderkey"), 9, "0")).alias("properties"))
    )
    edges = o.select(F.lit("placed").alias("type"), F.concat(F.lit("c"), text("o_custkey")).alias("source_goid"), F.concat(F.lit("o"), text("o_orderkey")).alias("target_goid"), F.lpad(text("o_orderkey"), 9, "0").alias("association_goid"))
    return Projector(objs, edges)


@query("SELECT 'c' || c_custkey AS id, lower(c_name) AS name, c_mktsegment <> 'BUILDING' AS known, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS DOUBLE) AS balance FROM customer")
def proj_object(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("id", "goid"), Output("name", "lower(Party.name)"), Output("known", "exists(Party.segment)", "boolean"), Output("segment", "coalesce(Party.segment, 'none')"), Output("balance", "Party.balance", "double")], object_type="Party")


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'fine' ELSE 'debt' END AS state, CASE WHEN c_mktsegment = 'BUILDING' THEN 'no' ELSE 'yes' END AS has FROM customer")
def proj_conditional(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("id", "goid"), Output("state", "if(Party.balance >= 0, 'fine', 'debt')"), Output("has", "ifelse(Party.segment, 'yes', 'no')")], object_type="Party")


@query("SELECT 'c' || o_custkey AS source_goid, 'o' || o_orderkey AS target_goid FROM orders")
def proj_association(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("source_goid", "association.source_goid"), Output("target_goid", "association.target_goid")], grain="association")


@query("SELECT 'c' || c_custkey AS id, count(o_orderkey) AS edges, count(o_orderkey) AS n, count(DISTINCT o_orderstatus) AS kinds, round(coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE), 0.0), 2) AS total, max(o_orderstatus) AS high FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = model(spark, d).project([Output("id", "goid"), Output("edges", "count(association(placed))", "bigint"), Output("n", "count(association(placed).price)", "bigint"), Output("kinds", "distinct_count(association(placed).status)", "bigint"), Output("total", "sum(association(placed).price)", "double"), Output("high", "max(association(placed).status)")], object_type="Party")
    return out.withColumn("total", F.round("total", 2))


@query("SELECT 'c' || c_custkey AS id, o_orderstatus AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def proj_explode(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("id", "goid"), Output("status", "association(placed).status", policy="explode")], object_type="Party")


@query("SELECT 'c' || c_custkey AS id, coalesce(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_list(spark: SparkSession, d: str) -> DataFrame:
    out = model(spark, d).project([Output("id", "goid"), Output("orders", "association(placed).key", policy="list", order_by="value")], object_type="Party")
    return out.select("id", F.array_join("orders", ",").alias("orders"))


@query("SELECT 'c' || c_custkey AS id, lpad(CAST(min(o_orderkey) AS VARCHAR), 9, '0') AS first, lpad(CAST(max(o_orderkey) AS VARCHAR), 9, '0') AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_first_last(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("id", "goid"), Output("first", "association(placed).key", policy="first", order_by="value"), Output("last", "association(placed).key", policy="last", order_by="value")], object_type="Party")


@query("SELECT 'o' || o_orderkey AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def proj_reverse_role(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).project([Output("id", "goid"), Output("name", "association(placed, target).name")], object_type="Order")


def typed_model(spark: SparkSession, d: str) -> Projector:
    """Parties and orders with typed properties, and associations with roles and a property of their own."""
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    text, v = lambda x: F.col(x).cast("string"), lambda x: (F.col(x) if isinstance(x, str) else x).cast("variant")
    objs = c.select(F.concat(F.lit("c"), text("c_custkey")).alias("goid"), F.lit("Party").alias("object_type"), F.create_map(F.lit("name"), v("c_name"), F.lit("nation"), v("c_nationkey"), F.lit("code"), v(text("c_nationkey"))).alias("properties")).unionByName(
        o.select(F.concat(F.lit("o"), text("o_orderkey")).alias("goid"), F.lit("Order").alias("object_type"), F.create_map(F.lit("status"), v(F.expr("nullif(o_orderstatus, 'P')")), F.lit("price"), v("o_totalprice"), F.lit("key"), v("o_orderkey")).alias("properties"))
    )
    edges = o.select(
        F.lit("placed").alias("type"), F.concat(F.lit("c"), text("o_custkey")).alias("source_goid"), F.concat(F.lit("o"), text("o_orderkey")).alias("target_goid"), F.lpad(text("o_orderkey"), 9, "0").alias("association_goid"),
        F.lit("buyer").alias("source_role"), F.lit("purchase").alias("target_role"), F.create_map(F.lit("urgency"), v("o_orderpriority")).alias("properties"),
    )
    return Projector(objs, edges)


@query("SELECT 'c' || c_custkey AS id, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_minmax_numeric(spark: SparkSession, d: str) -> DataFrame:
    return typed_model(spark, d).project([Output("id", "goid"), Output("low", "min(association(placed).price)", "double"), Output("high", "max(association(placed).price)", "double"), Output("first", "min(association(placed).key)", "bigint")], object_type="Party")


@query("SELECT 'c' || c_custkey AS id, count(DISTINCT nullif(o_orderstatus, 'P')) AS kinds, count(nullif(o_orderstatus, 'P')) AS n, count(o_orderkey) AS edges FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_distinct_null(spark: SparkSession, d: str) -> DataFrame:
    return typed_model(spark, d).project([Output("id", "goid"), Output("kinds", "distinct_count(association(placed).status)", "bigint"), Output("n", "count(association(placed).status)", "bigint"), Output("edges", "count(association(placed))", "bigint")], object_type="Party")


@query("SELECT 'o' || o_orderkey AS id, c_name AS buyer, o_orderpriority AS urgency, CAST(0 AS BIGINT) AS none FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def proj_named_role(spark: SparkSession, d: str) -> DataFrame:
    return typed_model(spark, d).project([Output("id", "goid"), Output("buyer", "association(placed, purchase).name"), Output("urgency", "association(placed, purchase).urgency"), Output("none", "count(association(placed, buyer))", "bigint")], object_type="Order")


@query("SELECT 'c' || c_custkey AS id, c_nationkey > 9 AS number_above, CAST(c_nationkey AS VARCHAR) > '9' AS text_above, c_nationkey <> 0 AS some, true AS zero_text FROM customer")
def proj_typed_compare(spark: SparkSession, d: str) -> DataFrame:
    """Numbers compare as numbers, strings of digits as text; 0 is false and the string "0" is true."""
    columns = [Output("id", "goid"), Output("number_above", "Party.nation > 9", "boolean"), Output("text_above", "Party.code > '9'", "boolean"), Output("some", "if(Party.nation, true, false)", "boolean"), Output("zero_text", "if(Party.code, true, false)", "boolean")]
    return typed_model(spark, d).project(columns, object_type="Party")


@query("SELECT 'c' || c_custkey AS id, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def proj_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    out = typed_model(spark, d).project([Output("id", "goid"), Output("orders", "association(placed).key", policy="list", order_by="association.urgency desc, Order.price, -missing")], object_type="Party")
    return out.select("id", F.array_join("orders", ",").alias("orders"))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, 'c' || o_custkey AS source, 'buyer' AS role, o_orderpriority AS urgency FROM orders")
def proj_link_object(spark: SparkSession, d: str) -> DataFrame:
    columns = (Output("id", "association.goid"), Output("source", "association.source_goid"), Output("role", "association.source_role"), Output("urgency", "placed.urgency"))
    return typed_model(spark, d).run(Projection("links", "links", "link_object", columns, association_type="placed"))


@query("SELECT 'customer.segment' AS assertion_id, CAST(NULL AS VARCHAR) AS absent, count(*) AS n FROM customer")
def proj_evidence(spark: SparkSession, d: str) -> DataFrame:
    values = M.resolve(_merged_values(spark, d))
    objs = M.objects(stacked(spark, d)).where("false")
    e = project_evidence(M.evidence(objs, values), ["assertion_id", "absent"])
    return e.where("assertion_id = 'customer.segment'").groupBy("assertion_id", "absent").agg(F.count("*").alias("n"))
