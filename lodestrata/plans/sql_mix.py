"""The SQL surface: projections, filters, sorts, aggregates, joins, set operations.

These run as the optimizer plans them: filters and columns reach the Parquet
scan, small sides broadcast below Spark's size threshold, the rest shuffles.
"""

from __future__ import annotations

from .registry import sql_query

MONEY = "CAST(sum(CAST({} AS DECIMAL(15, 2))) AS DOUBLE)"

# scans, projection, limit
sql_query("scan_full", "SELECT * FROM nation")
sql_query("scan_projection", "SELECT o_totalprice, o_orderkey FROM orders")
sql_query("scan_empty_projection", "SELECT count(*) AS n FROM (SELECT 1 AS one FROM orders) t")
sql_query("scan_limit_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("sort_multi_key", "SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) AS BIGINT) AS place FROM customer")
sql_query("sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY nullif(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey DESC LIMIT 50")

# filters
sql_query("filter_eq_num", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
sql_query("filter_literal_first", "SELECT o_orderkey FROM orders WHERE 1000 >= o_orderkey AND 900 < o_orderkey")
sql_query("filter_eq_str", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
sql_query("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#55', NULL)")
sql_query("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
sql_query("filter_null", "SELECT count(*) AS n FROM (SELECT nullif(l_discount, 0) AS d FROM lineitem) t WHERE d IS NULL")
sql_query("filter_not_null", "SELECT count(*) AS n FROM (SELECT nullif(l_discount, 0) AS d FROM lineitem) t WHERE d IS NOT NULL")
sql_query("filter_and", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_returnflag = 'R'")
sql_query("filter_or", "SELECT p_partkey FROM part WHERE p_size = 7 OR p_retailprice > 1900")
sql_query("filter_not", "SELECT count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity > 30) AND l_linestatus <> 'F'")
sql_query("filter_not_in", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_size NOT BETWEEN 10 AND 50")
sql_query("filter_like_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
sql_query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'A')")
sql_query("filter_cast", "SELECT o_orderkey FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 100 = 7")

# operational lookups
sql_query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 777")
sql_query("small_in_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 500, 999, 1400, 14000)")
sql_query("latest_customer", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
sql_query("zero_match", "SELECT o_orderkey FROM orders WHERE o_orderkey = -1 AND o_orderstatus = 'none'")

# aggregates
sql_query("group_status", f"SELECT o_orderstatus, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_orderstatus")
sql_query("group_customer", f"SELECT o_custkey, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey")
sql_query("top_customers", f"SELECT o_custkey, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 20")
sql_query("count_distinct_customers", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
sql_query("group_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 40")
sql_query("pricing_summary", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_quantity')} AS qty, {MONEY.format('l_extendedprice')} AS price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("grouping_sets", f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql_query("group_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# joins
sql_query("join_fact_customer", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql_query("join_star", "SELECT n_name, p_brand, count(*) AS n, " + MONEY.format("l_quantity") + " AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, p_brand")
sql_query("join_selective", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' GROUP BY r_name")
sql_query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey GROUP BY c_custkey")
sql_query("join_left_filtered", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
sql_query("join_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
sql_query("join_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
sql_query("join_anti_null", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 5) FROM customer)")
sql_query("join_full", "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON n_nationkey = s_nationkey")
sql_query("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal > 8000")
sql_query("join_small_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")

# windows, set operations, casts, subqueries, functions
sql_query("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
sql_query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region UNION ALL SELECT r_name AS name FROM region")
sql_query("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
sql_query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
sql_query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'")
sql_query("casts", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS DOUBLE) AS price, CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day FROM orders WHERE o_orderkey < 500")
sql_query("scalar_functions", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, abs(c_acctbal) AS size, concat(c_name, '/', c_mktsegment) AS both FROM customer")
sql_query("subquery_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) - 500 FROM supplier)")
sql_query("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
