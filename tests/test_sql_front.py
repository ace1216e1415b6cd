"""The SQL front: the dialect's own spelling, binding, pruning, statements and metadata."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import sqlfront
from tidemark.plans.dialect import Unsupported, tokens, translated
from tidemark.sources.cache import ReadCache
from tidemark.sources.catalog import HOUR, Catalog

BASE = 10**18
T = "TIMESTAMP '2024-03-05 10:37:20'"
day = lambda *x: datetime.datetime(*x)

#: Expressions in the dialect's spelling and their values.
FORMS = {
    "7 / 2": 3,
    "-7 / 2": -3,
    "7 / 2 / 2": 1,
    "(3 + 4) / 2 * 1.0": 3.0,
    "7 / 2.0": 3.5,
    "CAST(7 AS DOUBLE) / CAST(2 AS DOUBLE)": 3.5,
    "log(100.0)": 2.0,
    "log(2, 8.0)": 3.0,
    "trunc(-3.7)": -3.0,
    "trunc(3.456, 2)": 3.45,
    "iszero(0.0)": True,
    "gcd(12, 18)": 6,
    "lcm(4, 6)": 12,
    "lcm(3037000500, 3037000499)": 3037000500 * 3037000499,
    "power(2, 10)": 1024.0,
    "to_hex(255)": "ff",
    "strpos('abcd', 'c')": 3,
    "starts_with('abc', 'ab')": True,
    "ends_with('abc', 'bc')": True,
    "btrim('  x ')": "x",
    "btrim('xxaxx', 'x')": "a",
    "concat('a', NULL, 1)": "a1",
    "sha256('a')": "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb",
    "digest('a', 'md5')": "0cc175b9c0f1b6a831c399e269772661",
    "encode('hi', 'hex')": "6869",
    "encode('hi', 'base64')": "aGk",
    "decode('6869', 'hex')": bytearray(b"hi"),
    "'a.b' ~ '^a\\.b$'": True,
    "'axb' ~ '^a\\.b$'": False,
    "'ABC' ~* 'b'": True,
    "'ABC' !~ 'b'": True,
    "'ABC' !~* 'b'": False,
    "'abc' SIMILAR TO 'a(b|c)+'": True,
    "'xabc' SIMILAR TO 'a(b|c)+'": False,
    "regexp_match('cpu-7', '([a-z]+)-(\\d)')": ["cpu", "7"],
    "regexp_match('cpu', 'p')": ["p"],
    "regexp_match('cpu', 'x') IS NULL": True,
    "regexp_match('cpu', 'p') IS NOT NULL": True,
    "regexp_like('CPU', 'p', 'i')": True,
    "regexp_count('banana', 'an')": 2,
    "regexp_replace('banana', 'an', 'x')": "bxana",
    "regexp_replace('banana', '(a)n', '<\\1>', 'g')": "b<a><a>a",
    f"date_bin(INTERVAL '15 minutes', {T})": day(2024, 3, 5, 10, 30),
    f"date_bin(INTERVAL '1 hour', {T}, TIMESTAMP '2024-01-01 00:10:00')": day(2024, 3, 5, 10, 10),
    f"date_bin(INTERVAL '3 months', {T})": day(2024, 1, 1),
    f"date_trunc('hour', {T})": day(2024, 3, 5, 10),
    f"extract(dow FROM {T})": 2,
    f"date_part('year', {T})": 2024,
    f"date_part('epoch', {T})": 1709635040.0,
    f"to_char({T}, '%Y-%m-%d at %H:%M')": "2024-03-05 at 10:37",
    f"to_unixtime({T})": 1709635040,
    "from_unixtime(1709635040)": day(2024, 3, 5, 10, 37, 20),
    "to_timestamp_nanos(1709635040000001999)": day(2024, 3, 5, 10, 37, 20, 1),
    "to_timestamp_micros(1709635040000001)": day(2024, 3, 5, 10, 37, 20, 1),
    f"to_local_time({T})": day(2024, 3, 5, 10, 37, 20),
    f"{T} + INTERVAL '1 day 2 hours'": day(2024, 3, 6, 12, 37, 20),
    f"{T} - INTERVAL '1' MONTH": day(2024, 2, 5, 10, 37, 20),
    "CAST(5 AS VARCHAR)": "5",
    "'5'::BIGINT + 1": 6,
    "CAST(5 AS BIGINT UNSIGNED)": 5,
    "arrow_cast('5', 'Int64')": 5,
    "arrow_typeof(1.5)": "double",
    "TRY_CAST('x' AS INT)": None,
    "[1, 2, 3][1]": 1,
    "make_array(1, 2)[-1]": 2,
    "(ARRAY[1, 2, 3, 4])[2:3]": [2, 3],
    "array_element([1, 2], 5)": None,
    "array_slice([1, 2, 3, 4], -2, -1)": [3, 4],
    "array_has_all([1, 2], [2])": True,
    "array_has_any([1, 2], [3])": False,
    "array_empty([1])": False,
    "array_length([1, 2])": 2,
    "array_ndims([[1], [2]])": 2,
    "array_position([5, 6], 6)": 2,
    "array_position([5, 6], 7)": None,
    "array_positions([1, 2, 1], 1)": [1, 3],
    "array_remove([1, 2, 1], 1)": [2, 1],
    "array_remove_n([1, 1, 1], 1, 2)": [1],
    "array_remove_all([1, 2, 1], 1)": [2],
    "array_replace([1, 2, 1], 1, 9)": [9, 2, 1],
    "array_replace_n([1, 1, 1], 1, 9, 2)": [9, 9, 1],
    "array_replace_all([1, 2, 1], 1, 9)": [9, 2, 9],
    "array_resize([1], 3, 0)": [1, 0, 0],
    "array_reverse([1, 2])": [2, 1],
    "array_concat([1], [2])": [1, 2],
    "array_pop_back([1, 2])": [1],
    "array_pop_front([1, 2])": [2],
    "array_sort([3, 1, 2], 'DESC')": [3, 2, 1],
    "array_to_string([1, 2], '-')": "1-2",
    "string_to_array('a.b', '.')": ["a", "b"],
    "range(3)": [0, 1, 2],
    "range(5, 1, -2)": [5, 3],
    "range(4, 2)": [],
    "generate_series(1, 3)": [1, 2, 3],
    "make_map('a', 1)['a']": 1,
    "map([1, 2], ['x', 'y'])[2]": "y",
    "map_extract(make_map('a', 1), 'a')": [1],
    "get_field(named_struct('f', 4), 'f')": 4,
    "'it''s' || ' \\n'": "it's \\n",
    "nullif(1, 1) IS DISTINCT FROM 1": True,
    "CASE WHEN 1 IN (1, 2) AND NOT (2 BETWEEN 3 AND 4) THEN 'y' END": "y",
}


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(BASE + i * HOUR // 10, ("cpu", "mem")[i % 2], f"h{i % 3}" if i % 7 else None, float(i)) for i in range(120)]
    return spark.createDataFrame(rows, "timestamp_ns long, metric_name string, host string, value_f64 double")


@pytest.fixture(scope="module")
def node(spark, metrics):
    few = spark.createDataFrame([(1, "a", 3), (2, "a", None), (3, "b", 1)], "id long, k string, v long")
    return sqlfront.QueryNode(spark, {"metrics": metrics, "few": few})


def column(df):
    return [r[0] for r in df.collect()]


def test_forms(node):
    got = node.query("SELECT " + ", ".join(f"{text} AS c{i}" for i, text in enumerate(FORMS))).first()
    plain = lambda v: v if not hasattr(v, "as_tuple") else int(v)
    wrong = {t: got[i] for i, (t, want) in enumerate(FORMS.items()) if (abs(got[i] - want) > 1e-9 if isinstance(want, float) else plain(got[i]) != want)}
    assert not wrong


def test_aggregates(node):
    one = lambda text: node.query(f"SELECT {text} FROM few").first()[0]
    assert one("array_agg(v ORDER BY id DESC)") == [1, None, 3]
    assert sorted(one("array_agg(v)"), key=str) == sorted([1, None, 3], key=str)
    assert one("array_agg(id) FILTER (WHERE k = 'a')") == [1, 2]
    assert one("string_agg(k, '-' ORDER BY id DESC)") == "b-a-a"
    assert one("first_value(v ORDER BY id DESC)") == 1 and one("last_value(k ORDER BY id)") == "b"
    assert one("nth_value(id, 2 ORDER BY id)") == 2
    assert one("approx_median(id)") == 2 and one("approx_percentile_cont(id, 0.99)") == 3
    assert one("approx_percentile_cont(0.99) WITHIN GROUP (ORDER BY id DESC)") == 1
    assert one("approx_percentile_cont_with_weight(id, id, 1.0)") == 3 and one("approx_distinct(k)") == 2
    assert one("var(id)") == 1.0 and one("mean(id)") == 2.0 and one("percentile_cont(0.5) WITHIN GROUP (ORDER BY id)") == 2.0
    assert one("sum(v) / count(*)") == 1
    assert column(node.query("SELECT first_value(id) OVER (PARTITION BY k ORDER BY id DESC) FROM few ORDER BY id")) == [2, 2, 3]


def test_order_and_clauses(node):
    assert column(node.query("SELECT v FROM few ORDER BY v")) == [1, 3, None]
    assert column(node.query("SELECT v FROM few ORDER BY v DESC")) == [None, 3, 1]
    assert column(node.query("SELECT v FROM few ORDER BY v DESC NULLS LAST, id LIMIT 2")) == [3, 1]
    assert column(node.query("SELECT DISTINCT ON (k) id FROM few ORDER BY k, id DESC")) == [2, 3]
    assert column(node.query("SELECT id FROM few QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1 ORDER BY id")) == [2, 3]
    assert sorted(column(node.query("SELECT unnest([1, 2]) AS x"))) == [1, 2]
    rows = node.query("SELECT k, id FROM few UNION ALL BY NAME SELECT id, 'z' AS k, 9 AS w FROM few WHERE id = 1")
    assert rows.columns == ["k", "id", "w"] and rows.count() == 4
    assert node.query("VALUES (1, 'a'), (2, 'b')").count() == 2 and node.query("SELECT 1 AS ok").first().ok == 1


def test_regexp_match_keeps_the_matching_rows_only(node, metrics):
    n = lambda text: node.query(f"SELECT count(*) AS n FROM metrics WHERE {text}").first().n
    one = metrics.where("host = 'h1'").count()
    assert n("regexp_match(host, '1') IS NOT NULL") == one
    assert n("regexp_match(host, '1') IS NULL") == 120 - one
    assert n("host ~ '1'") == one and n("host !~ '1'") == metrics.where("host <> 'h1'").count()


def test_binding(node, metrics):
    n = lambda text: node.query(text).first()[0]
    assert n("WITH metrics AS (SELECT 1 AS a) SELECT a FROM metrics") == 1
    assert n("WITH metrics AS (SELECT * FROM metrics WHERE metric_name = 'cpu') SELECT count(*) FROM metrics") == 60
    assert n("WITH a AS (SELECT * FROM metrics), b AS (SELECT * FROM a) SELECT count(*) FROM a, b WHERE a.timestamp_ns = b.timestamp_ns") == 120
    assert n("SELECT count(*) FROM metrics a, few b WHERE b.id = 1") == 120
    assert n('SELECT count(*) FROM "metrics"') == 120 and n("SELECT count(*) FROM METRICS") == 120
    assert n("SELECT count(metrics.value_f64) FROM metrics WHERE metrics.metric_name = 'cpu'") == 60
    assert n("SELECT count(*) FROM few f JOIN metrics AS m ON f.id = m.value_f64") == 3
    assert n("SELECT count(*) FROM (SELECT * FROM metrics) AS metrics") == 120
    assert n("SELECT (SELECT max(id) FROM few)") == 3
    assert n("SELECT 'from metrics' AS s FROM metrics LIMIT 1 -- from nowhere") == "from metrics"
    assert n("SELECT count(*) FROM few WHERE k IN (SELECT k FROM few WHERE id = 3)") == 1
    assert n("WITH RECURSIVE t(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM t WHERE i < 5) SELECT sum(i) FROM t") == 15
    assert n("SELECT extract(year FROM TIMESTAMP '2024-01-01 00:00:00') FROM few, LATERAL (SELECT id AS x) LIMIT 1") == 2024


def test_parameters(node):
    h = node.prepare("SELECT count(*) AS n FROM few WHERE id > $1 AND k = $2")
    assert node.execute(h, 1, "a").first().n == 1 and node.execute(h, 0, "a").first().n == 2
    assert node.query("SELECT ? + ? AS x", 1, 2).first().x == 3 and node.query("SELECT :a AS x", a="q'").first().x == "q'"
    with pytest.raises(ValueError):
        node.execute(h, 1)
    node.close(h)
    with pytest.raises(KeyError):
        node.execute(h, 1, "a")


def test_statements_and_metadata(node, spark, tmp_path):
    assert {r.table_name for r in node.query("SHOW TABLES").collect()} == {"metrics", "few"}
    assert [r.column_name for r in node.query("DESCRIBE few").collect()] == ["id", "k", "v"]
    assert [r.data_type for r in node.query("SHOW COLUMNS FROM few").collect()] == ["bigint", "string", "bigint"]
    assert column(node.query("SELECT column_name FROM information_schema.columns WHERE table_name = 'few' ORDER BY ordinal_position")) == ["id", "k", "v"]
    assert node.query("SELECT count(*) FROM information_schema.tables t").first()[0] == 2
    plans = {r.plan_type: r.plan for r in node.query("EXPLAIN SELECT id FROM few WHERE id > 1").collect()}
    assert "Filter" in plans["logical_plan"] and plans["physical_plan"]
    assert node.query(f"COPY (SELECT * FROM few WHERE id < 3) TO '{tmp_path}/out' STORED AS CSV").first()[0] == 2
    node.query(f"CREATE EXTERNAL TABLE back STORED AS CSV LOCATION '{tmp_path}/out'")
    assert node.query("SELECT sum(id) FROM back").first()[0] == 3
    node.query("CREATE VIEW large AS SELECT * FROM few WHERE id > 1")
    assert node.query("SELECT count(*) FROM large").first()[0] == 2
    with pytest.raises(ValueError):
        node.query("CREATE VIEW large AS SELECT 1")
    node.query("DROP VIEW large")
    node.query("DROP TABLE back")
    with pytest.raises(ValueError):
        node.query("DROP TABLE back")
    for text in ("SELECT", "DELETE FROM few", "SELECT to_char(id, k) FROM few", "SELECT date_bin(INTERVAL '1 blink', now())"):
        with pytest.raises(Exception):
            node.query(text).collect()
    assert node.list_catalogs().count() == node.list_schemas().count() == 1 and node.list_table_types().count() == 2
    assert [r.type_name for r in node.type_info().collect()] == ["VARCHAR", "DOUBLE", "BIGINT"] and node.sql_info().where("info = 'read_only'").first().value == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("q_")]


def test_translation_leaves_text_alone():
    assert translated("SELECT 'a \"b\" -- c' AS \"x\"\"y\" -- d") == "SELECT 'a \"b\" -- c' AS `x\"y`"
    assert [t.text for t in tokens("a/*b*/c::d")] == ["a", "c", "::", "d"]
    with pytest.raises(Unsupported):
        translated("SELECT digest(x, 'blake3') FROM t")


@pytest.fixture(scope="module")
def stored(spark, metrics, tmp_path_factory):
    c = Catalog(spark, str(tmp_path_factory.mktemp("c")))
    for h in range(12):  # a chunk each hour
        rows = metrics.where(F.floor((F.col("timestamp_ns") - BASE) / HOUR) == h)
        c.append(rows.withColumn("zone", F.lit("z")) if h > 5 else rows, stats=("metric_name", "value_f64", "host"), files=1)
    return c


def test_chunks_are_pruned_by_the_query(spark, stored, metrics):
    node = sqlfront.QueryNode(spark, {"metrics": stored, "plain": metrics})

    def read(text):
        want = node.query(text.replace(" metrics", " plain")).collect()
        assert sorted(map(str, node.query(text).collect())) == sorted(map(str, want))
        return node.chunks["metrics"]

    at = lambda h: BASE + h * HOUR
    assert read("SELECT count(*) FROM metrics") == (12, 12)
    assert read(f"SELECT sum(value_f64) FROM metrics WHERE timestamp_ns >= {at(9)}")[0] == 3
    assert read(f"SELECT DISTINCT host FROM metrics WHERE timestamp_ns BETWEEN {at(2)} AND {at(3)}")[0] == 2
    assert read("SELECT count(*) FROM metrics WHERE value_f64 > 100 AND host LIKE 'h%'")[0] == 2
    assert read("SELECT count(*) FROM metrics WHERE metric_name = 'none'")[0] == 0
    assert read("SELECT count(*) FROM metrics WHERE value_f64 IN (5.0, 65.0)")[0] == 2
    assert read(f"SELECT count(*) FROM metrics WHERE value_f64 < 10 OR timestamp_ns > {at(11)}")[0] == 2
    assert read("SELECT count(*) FROM metrics WHERE value_f64 < 10 OR upper(host) = 'H1'")[0] == 12
    assert read("SELECT count(*) FROM metrics WHERE NOT (value_f64 < 10)")[0] == 11
    assert read("SELECT count(*) FROM (SELECT * FROM metrics WHERE value_f64 < 10) a JOIN (SELECT * FROM metrics WHERE value_f64 > 110) b ON a.host = b.host")[0] == 2
    assert read("WITH a AS (SELECT * FROM metrics WHERE value_f64 < 10) SELECT count(*) FROM a")[0] == 1
    assert read("SELECT count(*) FROM metrics WHERE timestamp_ns < to_unixtime(now()) * 1000000000 - 9000000000000000000")[0] == 0
    assert node.query("SELECT count(zone) FROM metrics").first()[0] == 60  # a column that only later chunks have


def test_read_cache_serves_queries(spark, stored):
    cache = ReadCache(stored, limit_bytes=1 << 30)
    node = sqlfront.QueryNode(spark, {"metrics": stored}, {"metrics": cache})
    for _ in range(2):
        assert node.query("SELECT count(*) FROM metrics WHERE value_f64 < 10").first()[0] == 10
    assert (cache.hits, cache.misses) == (1, 1)
    cache.clear()


def test_results_and_log(spark, metrics, tmp_path):
    df = spark.sql("SELECT 1 AS i, double('NaN') AS d, 'a,b' AS s")
    assert json.loads(sqlfront.result(df))["rows"] == [{"i": 1, "d": None, "s": "a,b"}]
    with pytest.raises(ValueError):
        sqlfront.result(metrics, most=100)
    log = sqlfront.QueryLog(path=str(tmp_path / "log"), most=2)
    for _ in range(2):
        log.record("t", metrics.where("host = 'h1'").groupBy("metric_name").count())
    assert not log.rows and log.frame(spark).where("column = 'host' AND kind = 'filter'").count() == 2
    assert log.frame(spark).where("column = 'metric_name' AND kind = 'group'").count() == 2
