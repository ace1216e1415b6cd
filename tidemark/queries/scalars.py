"""Scalar functions by family, each column named after its function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as fn
from .common import Query, sql, table

#: Per family: the table and key, then (name, Spark, DuckDB); None: the same text.
FAMILIES: dict[str, tuple[str, str, list[tuple[str, str, str | None]]]] = {
    "fn_math": (
        "lineitem",
        "l_orderkey, l_linenumber",
        [
            ("abs", "abs(l_discount - 0.05)", None),
            ("ceil", "ceil(l_extendedprice)", "CAST(ceil(l_extendedprice) AS BIGINT)"),
            ("floor", "floor(l_extendedprice)", "CAST(floor(l_extendedprice) AS BIGINT)"),
            ("sqrt", "round(sqrt(l_quantity), 9)", None),
            ("cbrt", "round(cbrt(l_quantity), 9)", None),
            ("exp", "round(exp(l_discount), 9)", None),
            ("ln", "round(ln(l_quantity), 9)", None),
            ("log2", "round(log2(l_quantity), 9)", None),
            ("log10", "round(log10(l_quantity), 9)", None),
            ("log", "round(log(3, l_quantity), 9)", None),
            ("power", "round(power(l_quantity, 1.5), 6)", None),
            ("sign", "CAST(signum(l_discount - 0.05) AS INT)", "CAST(sign(l_discount - 0.05) AS INT)"),
            ("round", "round(l_extendedprice, 1)", None),
            ("trunc", "CAST(l_extendedprice AS BIGINT)", "CAST(trunc(l_extendedprice) AS BIGINT)"),
            ("factorial", "factorial(l_linenumber)", "CAST(factorial(l_linenumber) AS BIGINT)"),
            ("pi", "round(pi(), 9)", None),
            ("isnan", "isnan(l_tax)", None),
            ("iszero", "l_tax = 0", None),
            ("nanvl", "nanvl(l_tax, 0D)", "CASE WHEN isnan(l_tax) THEN 0 ELSE l_tax END"),
            ("mod", "l_orderkey % 7", None),
            ("div", "l_orderkey div 7", "l_orderkey // 7"),
            ("divide", "round(try_divide(l_extendedprice, l_linenumber - 3), 6)", "round(l_extendedprice / nullif(l_linenumber - 3, 0), 6)"),
            ("greatest", "greatest(l_tax, l_discount)", None),
            ("least", "least(l_tax, l_discount)", None),
        ],
    ),
    "fn_trig": (
        "lineitem",
        "l_orderkey, l_linenumber",
        [(n, f"round({n}({x}), 9)", None) for n, x in {"sin": "l_quantity", "cos": "l_quantity", "tan": "l_discount", "cot": "l_quantity", "asin": "l_discount", "acos": "l_discount", "atan": "l_quantity", "sinh": "l_discount", "cosh": "l_discount", "tanh": "l_discount", "asinh": "l_quantity", "atanh": "l_discount", "acosh": "l_quantity", "degrees": "l_discount", "radians": "l_quantity"}.items()] + [("atan2", "round(atan2(l_quantity, l_tax), 9)", None)],
    ),
    "fn_string": (
        "part",
        "p_partkey",
        [
            ("ascii", "ascii(p_name)", None),
            ("bit_length", "bit_length(p_name)", "CAST(bit_length(p_name) AS INT)"),
            ("btrim", "btrim(concat('  ', p_name, ' '))", "trim(concat('  ', p_name, ' '))"),
            ("ltrim", "ltrim('  x')", None),
            ("rtrim", "rtrim('x  ')", None),
            ("trim", "trim('  x  ')", None),
            ("char_length", "char_length(p_name)", "CAST(length(p_name) AS INT)"),
            ("octet_length", "octet_length(p_name)", "CAST(octet_length(encode(p_name)) AS INT)"),
            ("chr", "chr(65 + p_size % 26)", None),
            ("concat_ws", "concat_ws('-', p_brand, p_type)", None),
            ("left", "left(p_name, 3)", None),
            ("right", "right(p_name, 3)", None),
            ("levenshtein", "levenshtein(p_name, p_type)", "CAST(levenshtein(p_name, p_type) AS INT)"),
            ("lower", "lower(p_type)", None),
            ("upper", "upper(p_name)", None),
            ("lpad", "lpad(p_brand, 12, '*')", None),
            ("rpad", "rpad(p_brand, 12, '*')", None),
            ("overlay", "overlay(p_brand PLACING 'XX' FROM 2 FOR 3)", "concat(substr(p_brand, 1, 1), 'XX', substr(p_brand, 5))"),
            ("repeat", "repeat(p_brand, 2)", None),
            ("replace", "replace(p_name, 'a', 'b')", None),
            ("reverse", "reverse(p_name)", None),
            ("split_part", "split_part(p_name, ' ', 1)", None),
            ("substr", "substr(p_name, 2, 4)", None),
            ("translate", "translate(p_name, 'abc', 'xyz')", None),
            ("contains", "contains(p_name, 'a')", None),
            ("concat_null", "concat_ws('', p_name, CAST(NULL AS STRING))", "concat(p_name, NULL)"),
            ("starts_with", "startswith(p_name, 'p')", "starts_with(p_name, 'p')"),
            ("ends_with", "endswith(p_name, 'e')", "ends_with(p_name, 'e')"),
            ("strpos", "instr(p_name, 'a')", "CAST(strpos(p_name, 'a') AS INT)"),
            ("to_hex", "lower(hex(p_partkey))", "lower(to_hex(p_partkey))"),
            ("substring_index", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
            ("pipes", "p_brand || '/' || p_type", None),
            ("like", "p_name LIKE '%a_%'", None),
            ("ilike", "p_type ILIKE '%a%'", None),
            ("similar", "p_type RLIKE '^(?:[A-M].*)$'", "p_type SIMILAR TO '[A-M].*'"),
        ],
    ),
    "fn_regex": (
        "part",
        "p_partkey",
        [
            ("matches", "p_name RLIKE 'a.'", "regexp_matches(p_name, 'a.')"),
            ("not_matches", "NOT p_name RLIKE 'a.'", "NOT regexp_matches(p_name, 'a.')"),
            ("extract", "regexp_extract(p_name, '([a-z]+)', 1)", None),
            ("like", "regexp_like(p_type, '^[A-Z]')", "regexp_matches(p_type, '^[A-Z]')"),
            ("count", "regexp_count(p_name, '[aeiou]')", "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INT)"),
            ("replace", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
            ("icase", "p_type RLIKE '(?i)a'", "regexp_matches(p_type, '(?i)a')"),
        ],
    ),
    "fn_date": (
        "events",
        "event_id",
        [
            ("trunc_hour", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)", "date_trunc('hour', ts)"),
            ("trunc_month", "CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ)", "CAST(date_trunc('month', ts) AS TIMESTAMP)"),
            ("bin", "CAST(timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) div 300000000) * 300000000) AS TIMESTAMP_NTZ)", "time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')"),
            ("window", "CAST(window(ts, '15 minutes').start AS TIMESTAMP_NTZ)", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"),
            ("year", "year(ts)", "CAST(year(ts) AS INT)"),
            ("part", "CAST(date_part('doy', ts) AS INT)", "CAST(date_part('doy', ts) AS INT)"),
            ("extract", "CAST(extract(HOUR FROM ts) AS INT)", None),
            ("dow", "dayofweek(ts) - 1", "CAST(dayofweek(ts) AS INT)"),
            ("make_date", "CAST(make_date(2024, month(ts), day(ts)) AS STRING)", "CAST(CAST(make_date(2024, month(ts), day(ts)) AS DATE) AS VARCHAR)"),
            ("to_date", "CAST(to_date('2024-01-05') AS STRING)", "CAST(CAST(CAST('2024-01-05' AS DATE) AS DATE) AS VARCHAR)"),
            ("to_timestamp", "CAST(to_timestamp('2024-01-05 01:02:03') AS TIMESTAMP_NTZ)", "TIMESTAMP '2024-01-05 01:02:03'"),
            ("from_seconds", "CAST(timestamp_seconds(1700000000) AS TIMESTAMP_NTZ)", "make_timestamp(1700000000000000)"),
            ("from_millis", "CAST(timestamp_millis(1700000000123) AS TIMESTAMP_NTZ)", "make_timestamp(1700000000123000)"),
            ("from_nanos", "CAST(timestamp_micros(1700000000123456789 div 1000) AS TIMESTAMP_NTZ)", "make_timestamp(1700000000123456)"),
            ("to_unix", "unix_timestamp(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)"),
            ("format", "date_format(ts, 'yyyy-MM-dd HH:mm')", "strftime(ts, '%Y-%m-%d %H:%M')"),
            ("plus", "ts + INTERVAL '90' MINUTE", "ts + INTERVAL 90 MINUTE"),
            ("minus", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT)", "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')"),
            ("epoch_ns", "unix_micros(CAST(ts AS TIMESTAMP)) * 1000", "epoch_us(ts) * 1000"),
            ("datediff", "datediff(ts, DATE '2024-01-01')", "CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT)"),
            ("last_day", "CAST(last_day(ts) AS STRING)", "CAST(CAST(last_day(ts) AS DATE) AS VARCHAR)"),
        ],
    ),
    "fn_conditional": (
        "customer",
        "c_custkey",
        [
            ("coalesce", "coalesce(nullif(c_nationkey, 3), -1)", None),
            ("nullif", "nullif(c_nationkey, 3)", None),
            ("nvl", "nvl(nullif(c_nationkey, 3), 0)", "ifnull(nullif(c_nationkey, 3), 0)"),
            ("nvl2", "nvl2(nullif(c_nationkey, 3), 1, 0)", "CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 1 ELSE 0 END"),
            ("greatest", "greatest(c_nationkey, 10)", None),
            ("least", "least(c_nationkey, 10)", None),
            ("case", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END", None),
            ("cast", "CAST(c_custkey AS STRING)", "CAST(c_custkey AS VARCHAR)"),
            ("try_cast", "try_cast(c_mktsegment AS INT)", None),
            ("distinct_from", "c_nationkey IS DISTINCT FROM NULL", None),
            ("same", "c_nationkey <=> 3", "c_nationkey IS NOT DISTINCT FROM 3"),
            ("if", "if(c_nationkey > 10, 'a', 'b')", "if(c_nationkey > 10, 'a', 'b')"),
        ],
    ),
    "fn_array": (
        "part",
        "p_partkey",
        [
            ("append", "array_join(array_append(array(p_size, 1), 2), ',')", "array_to_string(list_append([p_size, 1], 2), ',')"),
            ("prepend", "array_join(array_prepend(array(p_size, 1), 2), ',')", "array_to_string(list_prepend(2, [p_size, 1]), ',')"),
            ("concat", "array_join(concat(array(p_size), array(1, 2)), ',')", "array_to_string(list_concat([p_size], [1, 2]), ',')"),
            ("has", "array_contains(array(1, 2, 3, 4, 5), p_size)", "list_contains([1, 2, 3, 4, 5], p_size)"),
            ("has_all", "size(array_except(array(p_size, 1), array(1, 2, 3))) = 0", "list_has_all([1, 2, 3], [p_size, 1])"),
            ("has_any", "arrays_overlap(array(p_size, 1), array(2, 3))", "list_has_any([p_size, 1], [2, 3])"),
            ("distinct", "size(array_distinct(array(p_size, 1, 1)))", "CAST(len(list_distinct([p_size, 1, 1])) AS INT)"),
            ("element", "element_at(array(p_size, 1), 1)", "[p_size, 1][1]"),
            ("missing", "try_element_at(array(p_size, 1), 5)", "[p_size, 1][5]"),
            ("empty", "size(array()) = 0", "len([]) = 0"),
            ("except", "array_join(sort_array(array_except(array(p_size, 1, 2), array(1))), ',')", "array_to_string(list_sort(list_distinct(list_filter([p_size, 1, 2], lambda x: x <> 1))), ',')"),
            ("intersect", "array_join(sort_array(array_intersect(array(p_size, 1, 2), array(1, 2))), ',')", "array_to_string(list_sort(list_intersect([p_size, 1, 2], [1, 2])), ',')"),
            ("union", "array_join(sort_array(array_union(array(p_size), array(1, 2))), ',')", "array_to_string(list_sort(list_distinct([p_size, 1, 2])), ',')"),
            ("length", "size(split(p_name, ' '))", "CAST(len(string_split(p_name, ' ')) AS INT)"),
            ("position", "CAST(array_position(array(1, 2, 3), p_size) AS INT)", "coalesce(list_position([1, 2, 3], p_size), 0)"),
            ("remove", "array_join(array_remove(array(p_size, 1, 2), 1), ',')", "array_to_string(list_filter([p_size, 1, 2], lambda x: x <> 1), ',')"),
            ("repeat", "array_join(array_repeat(p_size, 3), ',')", "array_to_string([p_size, p_size, p_size], ',')"),
            ("replace", "array_join(transform(array(p_size, 1), x -> if(x = 1, 9, x)), ',')", "array_to_string(list_transform([p_size, 1], lambda x: CASE WHEN x = 1 THEN 9 ELSE x END), ',')"),
            ("reverse", "array_join(reverse(array(p_size, 1)), ',')", "array_to_string(list_reverse([p_size, 1]), ',')"),
            ("slice", "array_join(slice(array(p_size, 1, 2, 3), 2, 2), ',')", "array_to_string([p_size, 1, 2, 3][2:3], ',')"),
            ("sort", "array_join(sort_array(array(p_size, 10, 5)), ',')", "array_to_string(list_sort([p_size, 10, 5]), ',')"),
            ("string_to_array", "element_at(split(p_type, ' '), 1)", "string_split(p_type, ' ')[1]"),
            ("pop_back", "array_join(slice(array(p_size, 1, 2), 1, 2), ',')", "array_to_string([p_size, 1, 2][:2], ',')"),
            ("flatten", "array_join(flatten(array(array(p_size), array(1))), ',')", "array_to_string(flatten([[p_size], [1]]), ',')"),
            ("sequence", "array_join(sequence(1, 5), ',')", "array_to_string(generate_series(1, 5), ',')"),
        ],
    ),
    "fn_map_struct": (
        "part",
        "p_partkey",
        [
            ("map_get", "element_at(map('a', p_size, 'b', 2), 'a')", "map_extract(MAP {'a': p_size, 'b': 2}, 'a')[1]"),
            ("map_keys", "array_join(map_keys(map('a', 1, 'b', 2)), ',')", "array_to_string(map_keys(MAP {'a': 1, 'b': 2}), ',')"),
            ("map_values", "array_join(map_values(map('a', p_size, 'b', 2)), ',')", "array_to_string(map_values(MAP {'a': p_size, 'b': 2}), ',')"),
            ("map_arrays", "map_from_arrays(array('x', 'y'), array(p_size, 1))['y']", "map(['x', 'y'], [p_size, 1])['y']"),
            ("struct", "struct(p_size AS s, p_name AS n).n", "{'s': p_size, 'n': p_name}.n"),
            ("named_struct", "named_struct('s', p_size).s", "struct_pack(s := p_size).s"),
        ],
    ),
    "fn_hash": (
        "part",
        "p_partkey",
        [
            ("md5", "md5(p_name)", None),
            ("sha256", "sha2(p_name, 256)", "sha256(p_name)"),
            ("base64", "base64(CAST(p_name AS BINARY))", "base64(encode(p_name))"),
            ("unbase64", "CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING)", "decode(from_base64(base64(encode(p_name))))"),
            ("hex", "hex(CAST(p_name AS BINARY))", "hex(p_name)"),
            ("unhex", "CAST(unhex(hex(CAST(p_name AS BINARY))) AS STRING)", "decode(unhex(hex(p_name)))"),
        ],
    ),
    "fn_json": (
        "events",
        "event_id",
        [
            ("path", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
            ("typed", "from_json(props, 'k INT').k", "CAST(json_extract_string(props, '$.k') AS INT)"),
            ("variant", "variant_get(parse_json(props), '$.k', 'int')", "CAST(json_extract_string(props, '$.k') AS INT)"),
        ],
    ),
}

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for family, (source, key, columns) in FAMILIES.items():
    QUERIES[family] = sql(f"SELECT {key}, " + ", ".join(f"{ours} AS f_{name}" for name, ours, _ in columns) + f" FROM {{{source}}}")
    ORACLE_SQL[family] = f"SELECT {key}, " + ", ".join(f"{theirs or ours} AS f_{name}" for name, ours, theirs in columns) + f" FROM {source}"


def fn_shims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size, key = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    a = F.array(size, F.lit(1), size)
    return p.select(
        "p_partkey",
        fn.gcd(key, size).alias("f_gcd"),
        fn.lcm(key, size).alias("f_lcm"),
        fn.truncated(F.col("p_retailprice"), 1).alias("f_trunc"),
        fn.array_positions(a, size).cast("array<string>").alias("p"),
        F.array_join(fn.array_remove_first(a, size), ",").alias("f_remove"),
        F.array_join(fn.array_resize(a, 5, F.lit(0)), ",").alias("f_resize"),
        F.array_join(fn.array_slice(a, 2, 3), ",").alias("f_slice"),
        F.element_at(fn.string_to_array(F.col("p_type"), " "), 1).alias("f_split"),
        fn.to_hex(key).alias("f_hex"),
        fn.digest(F.col("p_name"), "sha256").alias("f_digest"),
        fn.concat_nulls(F.col("p_brand"), F.lit(None).cast("string")).alias("f_concat"),
    ).withColumn("f_positions", F.array_join("p", ",")).drop("p")


def fn_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


def fn_absent_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose results another engine cannot repeat: case by words, sets in text, other digests, uuid, random, clock."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.initcap("p_name").alias("f_initcap"), F.expr("find_in_set('b', 'a,b,c')").alias("f_find"), F.sha2("p_name", 224).alias("f_sha224"), F.sha2("p_name", 384).alias("f_sha384"), F.sha2("p_name", 512).alias("f_sha512"), (F.length(F.expr("uuid()")) == 36).alias("f_uuid"), F.rand(7).between(0, 1).alias("f_random"), (F.current_timestamp() > F.lit("2024-01-01")).alias("f_now"), F.expr("typeof(p_size)").alias("f_typeof"))


QUERIES |= {"fn_shims": fn_shims, "fn_unnest": fn_unnest, "fn_rows_only": fn_absent_elsewhere}
ORACLE_SQL |= {
    "fn_shims": """SELECT p_partkey, gcd(p_partkey, p_size) AS f_gcd, lcm(p_partkey, p_size) AS f_lcm, sign(p_retailprice) * floor(abs(p_retailprice) * 10.0::DOUBLE) / 10.0::DOUBLE AS f_trunc,
  array_to_string(CASE WHEN p_size = 1 THEN [1, 2, 3] ELSE [1, 3] END, ',') AS f_positions, concat('1,', p_size) AS f_remove, concat(p_size, ',1,', p_size, ',0,0') AS f_resize, concat('1,', p_size) AS f_slice,
  split_part(p_type, ' ', 1) AS f_split, lower(to_hex(p_partkey)) AS f_hex, sha256(p_name) AS f_digest, p_brand AS f_concat FROM part""",
    "fn_unnest": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
}
