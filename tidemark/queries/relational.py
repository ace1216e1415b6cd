"""The inherited SQL surface: projection, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rows import asof_join, full_join, range_join, salted_join
from .common import Query, plain, sql, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: One text for both engines.
BOTH = {
    # Projection, filters, predicates.
    "sel_arithmetic_case": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 30 THEN 'bulk' WHEN l_quantity > 10 THEN 'some' ELSE 'few' END AS size FROM {lineitem}",
    "sel_comparisons": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <> 0.05 AND NOT (l_tax > 0.06 OR l_tax <= 0.01) AND l_linenumber BETWEEN 2 AND 5 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('X')",
    "sel_like": "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'z%' AND p_brand ILIKE 'brand%'",
    "sel_null_tests": "SELECT c_custkey, c_acctbal IS NULL AS missing, c_acctbal IS NOT NULL AS present, nullif(c_nationkey, 3) IS DISTINCT FROM 4 AS differs FROM {customer}",
    "sel_constant": "SELECT 1 AS ok, 'x' AS name",
    "sel_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "sel_in_subquery": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')",
    "sel_scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})",
    # Joins.
    "join_inner": "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "join_sort_merge": "SELECT o_orderkey, l_linenumber, l_quantity FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_totalprice > 50000",
    "join_left": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_right": "SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey",
    "join_full": "SELECT c_custkey, s_suppkey FROM (SELECT * FROM {customer} WHERE c_nationkey < 12) FULL JOIN (SELECT * FROM {supplier} WHERE s_nationkey > 8) ON c_nationkey = s_nationkey",
    "join_semi": "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)",
    "join_anti": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_cross": "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_using": "SELECT n_nationkey, count(*) AS n FROM (SELECT c_nationkey AS n_nationkey FROM {customer}) JOIN {nation} USING (n_nationkey) GROUP BY n_nationkey",
    "join_natural": "SELECT count(*) AS n FROM (SELECT n_nationkey, n_name FROM {nation}) a NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM {nation}) b",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_lateral": "SELECT r_name, n FROM {region}, LATERAL (SELECT count(*) AS n FROM {nation} WHERE n_regionkey = r_regionkey)",
    "join_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS best FROM {customer}",
    "join_star": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    # Aggregates.
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS taxed, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_spread": "SELECT event_type, round(stddev(value), 6) AS s, round(stddev_samp(value), 6) AS ss, round(stddev_pop(value), 6) AS sp, round(var_samp(value), 5) AS vs, round(var_pop(value), 5) AS vp FROM {events} GROUP BY event_type",
    "agg_median": "SELECT event_type, round(median(value), 6) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM {events} GROUP BY event_type",
    "agg_corr": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM {lineitem} GROUP BY l_returnflag",
    "agg_regr": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_tax, l_discount), 5) AS sxx, round(regr_syy(l_tax, l_discount), 5) AS syy, round(regr_sxy(l_tax, l_discount), 5) AS sxy FROM {lineitem} GROUP BY l_returnflag",
    "agg_bits": "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM {nation} GROUP BY n_regionkey",
    "agg_bools": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM {orders} GROUP BY o_orderstatus",
    "agg_string": "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS open_tax FROM {lineitem} GROUP BY l_returnflag",
    "agg_distinct": "SELECT l_linestatus, sum(DISTINCT l_quantity) AS q, count(DISTINCT l_partkey, l_suppkey) AS pairs FROM {lineitem} GROUP BY l_linestatus",
    "agg_expr_ordinal": "SELECT l_linenumber % 3 AS m, count(*) AS n FROM {lineitem} GROUP BY 1",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_select_distinct": "SELECT DISTINCT p_brand, p_size FROM {part}",
    # Windows.
    "win_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_distribution": "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS q FROM {customer} WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)",
    "win_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last": "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_aggregate": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey), 2) AS total, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {lineitem}",
    "win_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS m FROM {events}",
    "win_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM {orders}",
    "win_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day FROM {events}",
    # Sorts and limits.
    "sort_nulls": "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer} ORDER BY k DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 40",
    "sort_limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "topk": "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 20",
    "topk_per_group": "SELECT * FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) WHERE rn <= 3",
    # Set operations.
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier}",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "set_values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(i, s)",
    "cte": "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 100000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT * FROM n WHERE n > 3",
    "cte_recursive": "WITH RECURSIVE t(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM t WHERE i < 30) SELECT i, i * i AS sq FROM t",
}
for key, text in BOTH.items():
    QUERIES[key], ORACLE_SQL[key] = sql(text), plain(text)
ORACLE_SQL["agg_string"] = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
ORACLE_SQL["agg_distinct"] = "SELECT l_linestatus, sum(DISTINCT l_quantity) AS q, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_linestatus"
ORACLE_SQL["agg_cube"] = ORACLE_SQL["agg_cube"].replace("CAST(grouping(l_returnflag) AS INT)", "CAST(grouping(l_returnflag) AS INT)")

#: Texts that differ: (Spark, DuckDB).
APART = {
    "sel_cast": ("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS INT) AS whole, try_cast(l_returnflag AS INT) AS none, CAST(l_quantity AS STRING) AS text FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS INT) AS whole, try_cast(l_returnflag AS INT) AS none, CAST(l_quantity AS VARCHAR) AS text FROM lineitem"),
    "sel_regex": ("SELECT p_partkey FROM {part} WHERE p_type RLIKE '^[A-M].*L'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M].*L')"),
    "agg_array": ("SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey"),
    "agg_first_last": ("SELECT user_id, min_by(value, struct(ts, event_id)) AS f, max_by(value, struct(ts, event_id)) AS l FROM {events} GROUP BY user_id", "SELECT user_id, min_by(value, (ts, event_id)) AS f, max_by(value, (ts, event_id)) AS l FROM events GROUP BY user_id"),
    "agg_distinct_on": ("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM {events}) WHERE rn = 1", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id"),
    "agg_approx_percentile": ("SELECT event_type, percentile_approx(value, 0.5, 1000000) AS p50, percentile_approx(value, 0.9, 1000000) AS p90 FROM {events} GROUP BY event_type", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type"),
    "agg_approx_distinct": ("SELECT o_orderstatus, approx_count_distinct(o_orderpriority) AS priorities, approx_count_distinct(month(o_orderdate), 0.01) AS months FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT month(o_orderdate)) AS months FROM orders GROUP BY o_orderstatus"),
    "win_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM {events}", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events"),
    "win_groups_frame": (
        "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS g FROM {events})",
        "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events",
    ),
    "join_right_semi": ("SELECT n_name FROM {nation} LEFT SEMI JOIN {supplier} ON s_nationkey = n_nationkey", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "join_right_anti": ("SELECT n_name FROM {nation} LEFT ANTI JOIN {supplier} ON s_nationkey = n_nationkey", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
}
for key, (ours, theirs) in APART.items():
    QUERIES[key], ORACLE_SQL[key] = sql(ours), theirs


def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text in BOTH, whose few keys have many rows on both sides."""
    customers = table(spark, sf_dir, "customer").where("c_nationkey < 12").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").where("s_nationkey > 8").select("s_suppkey", "s_nationkey")
    return full_join(customers, suppliers, ("c_nationkey", "s_nationkey")).select("c_custkey", "s_suppkey")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'view'").groupBy("user_id", "at").agg(F.max("value").alias("seen_value"))
    return asof_join(left, right, "at", ["user_id"], ["seen_value"], bucket=86_400_000_000)


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "at")
    spans = e.where("event_type = 'purchase'").select("event_id", (F.col("at") - 3_600_000_000).alias("lo"), F.col("at").alias("hi"))
    return range_join(points, spans, "at", "lo", "hi", 3_600_000_000).select("error_id", "event_id")


def join_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    names = e.groupBy("kind").agg(F.min("event_id").alias("first_id"))
    return salted_join(e, names, ["kind"], 8).select("event_id", "kind", "first_id")


AT = "(SELECT *, epoch_us(ts) AS at_us FROM events)"
QUERIES |= {"join_full": join_full, "join_asof": join_asof, "join_interval": join_interval, "join_skewed": join_skewed}
ORACLE_SQL |= {
    "join_asof": f"SELECT l.event_id, l.user_id, l.at_us AS at, r.seen_value FROM (SELECT * FROM {AT} WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, at_us, max(value) AS seen_value FROM {AT} WHERE event_type = 'view' GROUP BY ALL) r ON l.user_id = r.user_id AND l.at_us >= r.at_us",
    "join_interval": f"SELECT e.event_id AS error_id, p.event_id FROM {AT} e JOIN {AT} p ON e.event_type = 'error' AND p.event_type = 'purchase' AND e.at_us BETWEEN p.at_us - 3600000000 AND p.at_us",
    "join_skewed": "SELECT event_id, event_type AS kind, min(event_id) OVER (PARTITION BY event_type) AS first_id FROM events",
}
