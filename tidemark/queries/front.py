"""Queries in the engine's own SQL spelling, through the SQL front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.sqlfront import QueryNode
from .common import Query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def node(spark: SparkSession, sf_dir: str) -> QueryNode:
    return QueryNode(spark, {t: (lambda t=t: table(spark, sf_dir, t)) for t in TABLES})


def add(name: str, ours: str, theirs: str | None = None, *values) -> None:
    QUERIES[name] = lambda s, d: node(s, d).query(ours, *values)
    ORACLE_SQL[name] = theirs or ours


# -- expressions ------------------------------------------------------------------

add(
    "front_division",
    "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS whole, (l_orderkey + l_partkey) / l_linenumber / 2 AS twice, l_quantity / 7 AS real, CAST(l_orderkey AS DOUBLE) / 8 AS cast_first, l_orderkey / 8.0 AS by_real FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS whole, (l_orderkey + l_partkey) // l_linenumber // 2 AS twice, l_quantity / 7 AS real, CAST(l_orderkey AS DOUBLE) / 8 AS cast_first, l_orderkey / 8.0::DOUBLE AS by_real FROM lineitem",
)
add(
    "front_numbers",
    "SELECT p_partkey, round(log(p_retailprice), 9) AS l10, round(log(2, p_retailprice), 9) AS l2, trunc(p_retailprice, 1) AS t1, trunc(-p_retailprice) AS t0, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, iszero(p_size - 7.0) AS z, to_hex(p_partkey) AS h, power(p_size, 2) AS sq FROM part",
    "SELECT p_partkey, round(log10(p_retailprice), 9) AS l10, round(log2(p_retailprice), 9) AS l2, trunc(p_retailprice * 10.0::DOUBLE) / 10.0::DOUBLE AS t1, trunc(-p_retailprice) AS t0, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, p_size = 7 AS z, lower(to_hex(p_partkey)) AS h, power(p_size, 2) AS sq FROM part",
)
add(
    "front_text",
    "SELECT p_partkey, strpos(p_name, 'e') AS at, starts_with(p_brand, 'Brand') AS s, ends_with(p_type, 'L') AS e, btrim(concat('xx', p_name, 'x'), 'x') AS b, concat(p_brand, NULL, p_size) AS c, p_brand || '-' || p_size::VARCHAR AS d, split_part(p_type, ' ', 2) AS w, sha256(p_name) AS h, encode(p_brand, 'hex') AS x FROM part",
    "SELECT p_partkey, strpos(p_name, 'e') AS at, starts_with(p_brand, 'Brand') AS s, suffix(p_type, 'L') AS e, trim(concat('xx', p_name, 'x'), 'x') AS b, concat(p_brand, NULL, p_size) AS c, p_brand || '-' || p_size::VARCHAR AS d, split_part(p_type, ' ', 2) AS w, sha256(p_name) AS h, lower(hex(p_brand)) AS x FROM part",
)
add(
    "front_regex",
    r"SELECT p_partkey, array_to_string(regexp_match(p_name, '^(\w)(\w+)'), '|') AS g, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS every, regexp_count(p_name, '[aeiou]') AS n, p_type ~ '^[A-M]' AS m, p_type !~* 'o' AS o, p_type SIMILAR TO '[A-Z ]+' AS full FROM part WHERE regexp_match(p_name, 'a') IS NOT NULL",
    r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(\w)(\w+)') THEN concat(regexp_extract(p_name, '^(\w)(\w+)', 1), '|', regexp_extract(p_name, '^(\w)(\w+)', 2)) END AS g, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS every, len(regexp_extract_all(p_name, '[aeiou]')) AS n, regexp_matches(p_type, '^[A-M]') AS m, NOT regexp_matches(p_type, 'o', 'i') AS o, regexp_full_match(p_type, '[A-Z ]+') AS full FROM part WHERE regexp_matches(p_name, 'a')",
)
add(
    "front_dates",
    "SELECT event_id, to_unixtime(date_bin(INTERVAL '15 minutes', ts)) AS b15, to_unixtime(date_bin(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01 06:00:00')) AS shifted, extract(dow FROM ts) AS dow, to_char(ts, '%Y-%m-%d %H:%M:%S') AS text, to_unixtime(date_trunc('hour', ts)) AS h, to_unixtime(ts + INTERVAL '36 hours') AS later, to_unixtime(from_unixtime(event_id)) AS u FROM events",
    "SELECT event_id, CAST(epoch(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS b15, CAST(epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01 06:00:00')) AS BIGINT) AS shifted, extract(dow FROM ts) AS dow, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h, CAST(floor(epoch(ts + INTERVAL 36 HOUR)) AS BIGINT) AS later, event_id AS u FROM events",
)
add(
    "front_casts",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS v, l_quantity::BIGINT AS b, CAST(l_orderkey AS BIGINT UNSIGNED) AS u, arrow_cast(l_linenumber, 'Float64') AS f, TRY_CAST(l_returnflag AS INT) AS none, CAST(l_orderkey AS TEXT) AS t FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS v, CAST(trunc(l_quantity) AS BIGINT) AS b, CAST(l_orderkey AS DECIMAL(20, 0)) AS u, CAST(l_linenumber AS DOUBLE) AS f, TRY_CAST(l_returnflag AS INT) AS none, CAST(l_orderkey AS VARCHAR) AS t FROM lineitem",
)
add(
    "front_arrays",
    """SELECT p_partkey, (string_to_array(p_type, ' '))[1] AS one, array_length(string_to_array(p_type, ' ')) AS n, array_to_string(array_slice([p_size, 1, p_size, 2], 2, 3), ',') AS cut, array_to_string(array_remove([p_size, 1, p_size], p_size), ',') AS gone,
  array_to_string(array_replace_all([p_size, 1, p_size], p_size, 0), ',') AS put, array_position([1, 2, 3], p_size) AS at, array_has_any([1, 2, 3], [p_size]) AS has, array_to_string(array_resize([p_size], 3, 0), ',') AS wide, array_to_string(range(1, p_size, 20), ',') AS r, array_element([p_size], 2) AS none FROM part""",
    """SELECT p_partkey, string_split(p_type, ' ')[1] AS one, len(string_split(p_type, ' ')) AS n, array_to_string([p_size, 1, p_size, 2][2:3], ',') AS cut, CASE WHEN p_size = 1 THEN '1,1' ELSE concat('1,', p_size) END AS gone,
  CASE WHEN p_size = 1 THEN '0,0,0' ELSE '0,1,0' END AS put, CASE WHEN p_size IN (1, 2, 3) THEN p_size END AS at, p_size IN (1, 2, 3) AS has, concat(p_size, ',0,0') AS wide, array_to_string(range(1, p_size, 20), ',') AS r, CAST(NULL AS INT) AS none FROM part""",
)
add(
    "front_maps",
    "SELECT p_partkey, make_map('size', p_size, 'key', p_partkey)['size'] AS s, map([1, 2], [p_name, p_brand])[2] AS b, get_field(named_struct('n', p_name), 'n') AS n, (map_extract(make_map('a', p_size), 'a'))[1] AS e FROM part",
    "SELECT p_partkey, p_size::BIGINT AS s, p_brand AS b, p_name AS n, p_size AS e FROM part",
)

# -- aggregates and clauses -------------------------------------------------------

add(
    "front_aggregates",
    """SELECT event_type, first_value(event_id ORDER BY ts, event_id) AS f, last_value(event_id ORDER BY ts, event_id) AS l, nth_value(event_id, 3 ORDER BY event_id) AS third, string_agg(event_id, ',' ORDER BY event_id DESC) FILTER (WHERE event_id < 60) AS ids,
  array_to_string(array_agg(user_id ORDER BY event_id) FILTER (WHERE event_id < 60), '-') AS users, round(var(value), 6) AS v, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90, sum(user_id) / count(*) AS per FROM events GROUP BY event_type""",
    """SELECT event_type, min_by(event_id, (ts, event_id)) AS f, max_by(event_id, (ts, event_id)) AS l, list_sort(array_agg(event_id))[3] AS third, string_agg(event_id, ',' ORDER BY event_id DESC) FILTER (WHERE event_id < 60) AS ids,
  array_to_string(array_agg(user_id ORDER BY event_id) FILTER (WHERE event_id < 60), '-') AS users, round(var_samp(value), 6) AS v, round(quantile_cont(value, 0.9), 6) AS p90, CAST(sum(user_id) AS BIGINT) // count(*) AS per FROM events GROUP BY event_type""",
)
add(
    "front_approximate",
    "SELECT event_type, approx_median(value) AS m, approx_percentile_cont(value, 0.9) AS p90, approx_percentile_cont(0.1) WITHIN GROUP (ORDER BY value) AS p10, approx_distinct(event_type) AS kinds FROM events WHERE event_id < 900 GROUP BY event_type",
    "SELECT event_type, quantile_disc(value, 0.5) AS m, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.1) AS p10, 1 AS kinds FROM events WHERE event_id < 900 GROUP BY event_type",
)
add("front_nulls_last", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY nullif(c_nationkey, 3) - 22, c_custkey LIMIT 90", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY nullif(c_nationkey, 3) - 22 ASC NULLS LAST, c_custkey LIMIT 90")
add("front_nulls_first", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC, c_custkey LIMIT 20", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 20")
add("front_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, ts DESC, event_id")
add("front_qualify", "SELECT c_mktsegment, c_custkey FROM customer WHERE c_nationkey > 2 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
add("sel_quoted_identifier", 'SELECT "n_name" AS "the name", "n"."n_regionkey" AS "r""k" FROM "nation" AS "n"')
add("set_union_by_name", "SELECT r_name, r_regionkey AS k FROM region UNION ALL BY NAME SELECT n_regionkey AS k, n_name FROM nation")
add("front_unnest", "SELECT p_partkey, unnest(string_to_array(p_name, ' ')) AS word FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")

# -- names, parameters and metadata -----------------------------------------------

add("front_shadowed", "WITH nation AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey), other AS (SELECT * FROM nation WHERE n > 0) SELECT r_name, n FROM region r, other WHERE r.r_regionkey = n_regionkey")
add("front_literals", "SELECT n_name, 'from region, nation' AS a, 'it''s \\ ' AS b /* from customer */ FROM nation -- where", "SELECT n_name, 'from region, nation' AS a, 'it''s \\ ' AS b FROM nation")
add("front_parameters", "SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2 AND o_orderpriority <> ?", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderpriority <> 'x'", 100000.0, "F", "x")
add(
    "front_information_schema",
    "SELECT table_name, column_name, ordinal_position AS place FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'orders')",
    "SELECT table_name, column_name, ordinal_position - 1 AS place FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'orders')",
)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = node(spark, sf_dir)
    handle = n.prepare("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey BETWEEN $1 AND $2 GROUP BY c_mktsegment")
    return n.execute(handle, 3, 9).unionByName(n.execute(handle, 10, 11))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node(spark, sf_dir).query("DESCRIBE orders").select("column_name", F.col("is_nullable").alias("nullable"))


QUERIES |= {"front_prepared": prepared, "front_describe": described}
ORACLE_SQL |= {
    "front_prepared": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey BETWEEN 3 AND 9 GROUP BY c_mktsegment UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_nationkey BETWEEN 10 AND 11 GROUP BY c_mktsegment",
    "front_describe": 'SELECT column_name, "null" AS nullable FROM (DESCRIBE orders)',
}
