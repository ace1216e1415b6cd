import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.model import SECOND, bucket_start, cardinality_class, empty_metrics, series_labels
from tidemark.plans import promql
from tidemark.plans.promql import Matcher, Query, parse


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cpu", Query("cpu")),
        ("  job:cpu:rate  ", Query("job:cpu:rate")),
        ('cpu{host="a",env!="b", az=~"c.*",x!~"d"}', Query("cpu", (Matcher("host", "=", "a"), Matcher("env", "!=", "b"), Matcher("az", "=~", "c.*"), Matcher("x", "!~", "d")))),
        ("cpu{}", Query("cpu")),
        ('cpu{ a = "b" , c=~ "d,e=\\"f" }', Query("cpu", (Matcher("a", "=", "b"), Matcher("c", "=~", "d,e=\\")))),
        ('cpu{a=="b",c!"d",e="f"}', Query("cpu", (Matcher("e", "=", "f"),))),
        ("sum(cpu)", Query("cpu", aggregate="sum")),
        ("sum by (a, b) (cpu)", Query("cpu", aggregate="sum", by=("a", "b"))),
        ("max by(a)(cpu)", Query("cpu", aggregate="max", by=("a",))),
        ("rate(cpu[5m])", Query("cpu", function="rate", range_seconds=300.0)),
        ("irate(cpu[2h])", Query("cpu", function="irate", range_seconds=7200.0)),
        ('increase(cpu{a="b"}[1d])', Query("cpu", (Matcher("a", "=", "b"),), function="increase", range_seconds=86400.0)),
        ("sum by (a) (rate(cpu[30s]))", Query("cpu", aggregate="sum", by=("a",), function="rate", range_seconds=30.0)),
        ("topk(3, cpu)", Query("3, cpu", aggregate="topk")),
        ("sum(cpu) by (a)", Query("cpu) by (a", aggregate="sum")),
        ("cpu offset 5m", Query("cpu offset 5m")),
        ("a + b", Query("a + b")),
        ("histogram_quantile(0.9, x)", Query("histogram_quantile(0.9, x)")),
        ("rate(cpu[5x])", Query("rate(cpu[5x])")),
        ("summary", Query("summary")),
        ("", Query("")),
    ],
)
def test_parse(text, want):
    assert parse(text) == want


def test_strict_parameter():
    q = promql.parse_strict("topk(3, cpu)")
    assert (q.metric, q.aggregate, q.parameter) == ("cpu", "topk", 3)


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(10, "cpu", "a", None, 1.0), (20, "cpu", "a", None, 3.0), (30, "cpu", "b", "x", 7.0), (40, "cpu", None, "x", 2.0), (20, "mem", "a", None, 9.0), (50, "cpu", "a", None, 2.0)]
    return spark.createDataFrame([(t * SECOND, m, h, z, v) for t, m, h, z, v in rows], "timestamp_ns long, metric_name string, host string, zone string, value_f64 double")


def values(df, *keys):
    return sorted((tuple(r[k] for k in (*keys, "value")) for r in df.collect()), key=str)


def test_null_labels_under_matchers(metrics):
    count = lambda text: promql.scoped(metrics, parse(text), None, None).count()
    assert count('cpu{host!="a"}') == 1  # a missing label is dropped
    assert count('cpu{host!~"a"}') == 2  # and kept here
    assert count('cpu{host=~"a"}') == 3
    assert count('cpu{nolabel="a"}') == 0
    assert count("cpu{host=\"x' OR 1=1\"}") == 0


def test_instant_compat(metrics):
    assert values(promql.instant(metrics, "cpu")) == [(2.0,)]
    assert values(promql.instant(metrics, "sum(cpu)", 30)) == [(11.0,)]
    assert values(promql.instant(metrics, "sum by (host) (cpu)"), "host") == sorted([("a", 6.0), ("b", 7.0), (None, 2.0)], key=str)
    assert values(promql.instant(metrics, "stdvar(cpu)")) == [(3.0,)]


def test_instant_series(metrics):
    assert values(promql.instant(metrics, "cpu", 45, compat=False), "host") == sorted([("a", 3.0), ("b", 7.0), (None, 2.0)], key=str)
    assert values(promql.instant(metrics, "sum(cpu)", 45, compat=False)) == [(12.0,)]
    assert values(promql.instant(metrics, "topk(1, cpu)", 45, compat=False), "host") == [("b", 7.0)]
    got = values(promql.instant(metrics, "increase(cpu[1h])", 50, compat=False), "host")
    assert ("a", 4.0) in got  # 1 -> 3, then a reset to 2


def test_series_functions_depend_on_their_window_alone(spark):
    rows = [(t * SECOND, "c", float(t // 6)) for t in range(0, 601, 60)] + [(700 * SECOND, "lonely", 1.0)]
    c = spark.createDataFrame(rows, "timestamp_ns long, metric_name string, value_f64 double")
    for fn in ("increase", "rate", "irate", "delta", "idelta", "deriv"):
        at = lambda df: {r.time_bucket // SECOND: r.value for r in df.collect()}  # noqa: E731, B023
        (instant,) = [r.value for r in promql.instant(c, f"{fn}(c[2m])", 600, compat=False).collect()]
        for start in (0, 300, 600):
            got = at(promql.range_query(c, f"{fn}(c[2m])", start, 600, 60, compat=False))
            assert abs(got[600] - instant) < 1e-9, (fn, start)
        assert 0 not in at(promql.range_query(c, f"{fn}(c[2m])", 0, 600, 60, compat=False))  # one sample has no pair
        assert promql.instant(c, f"{fn}(lonely[2m])", 700, compat=False).count() == 0
    assert promql.instant(c, "increase(c[2m])", 600, compat=False).first().value == 10.0


def test_range_function_hides_aggregate(metrics):
    a = values(promql.range_query(metrics, "sum(rate(cpu[10s]))", 0, 60, 30), "time_bucket")
    assert a == values(promql.range_query(metrics, "rate(cpu[10s])", 0, 60, 30), "time_bucket")
    assert a == [(0, 0.2), (30 * SECOND, 0.5)]


def test_vector_and_matrix(metrics):
    v = promql.vector(promql.instant(metrics, "sum by (host) (cpu)")).collect()
    assert {"__name__": "cpu"} in [r.metric for r in v]
    m = promql.matrix(promql.range_query(metrics, "cpu", 0, 60, 30)).collect()
    assert [[p.time for p in r["values"]] for r in m] == [[0.0, 30.0]]


def test_discovery(metrics):
    names = lambda df: [r[0] for r in df.collect()]
    assert names(L.label_names(metrics)) == ["__name__", "host", "zone"]
    assert names(L.label_names(metrics, ["nothing"])) == []
    assert names(L.label_names(metrics, ["mem"], compat=False)) == ["__name__", "host"]
    assert names(L.label_values(metrics, "host")) == ["a", "b"]
    assert names(L.label_values(metrics, "__name__")) == []
    assert names(L.label_values(metrics, "__name__", compat=False)) == ["cpu", "mem"]
    assert L.series(metrics).count() == 0
    assert L.series(metrics, ["cpu"]).count() == 3
    assert L.series(metrics, ["cpu", "mem"]).count() == 0  # asked for all at once
    assert L.series(metrics, ["cpu", "mem"], compat=False).count() == 4


def test_unknown_labels_are_null(metrics):
    assert L.series(metrics, ['cpu{nolabel="a"}']).count() == 0 and L.series(metrics, ['cpu{nolabel!~"a"}']).count() == 3
    assert [r[0] for r in L.label_values(metrics, "host", ['cpu{nolabel!="a"}']).collect()] == []
    assert promql.instant(metrics, 'sum by (host) (cpu{nolabel!~"x"})').count() == 3


def test_envelope(spark, metrics):
    assert promql.respond(lambda: 1) == {"status": "success", "data": 1}
    assert promql.respond(lambda: spark.table("no_such_table").collect())["status"] == "success"
    assert promql.respond(lambda: 1 / 0)["status"] == "error"


def test_model(spark):
    assert empty_metrics(spark).count() == 0
    rows = spark.createDataFrame([(-7,), (7,), (10,)], "n long")
    assert [r[0] for r in rows.select(bucket_start(F.col("n"), 5)).collect()] == [-5, 5, 10]
    rows = spark.createDataFrame([(n,) for n in (1000, 1001, 100000, 100001)], "n long")
    assert [r[0] for r in rows.select(cardinality_class(F.col("n"))).collect()] == ["low", "medium", "medium", "high"]
    assert spark.createDataFrame([("m", None)], "metric_name string, a string").select(series_labels(["a"])).first()[0] == {"__name__": "m"}
