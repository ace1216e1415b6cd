"""Payloads to metric rows: remote write, OTLP, Arrow, and a synthetic workload.

Decoders turn one payload into nested rows; everything after that is DataFrame
operations, so a column of payloads decodes on the executors.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import DEFAULT_LABELS, metric_schema

#: Bytes that a byte of the block format stands for at most, about: copies of 64 bytes take 3.
LARGEST_RATIO = 24
SERIES = "array<struct<labels:array<struct<name:string,value:string>>,samples:array<struct<timestamp_ms:long,value:double>>>>"


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated number")
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out & (1 << 64) - 1, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of the fields of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            n = 8 if kind == 1 else 4 if kind == 5 else None
            if n is None:
                if kind != 2:
                    raise ValueError(f"unknown wire type {kind}")
                n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("truncated field")
            value, at = data[at : at + n], at + n
        yield tag >> 3, kind, value


def unsnappy(data: bytes) -> bytes:
    """Snappy's block format."""
    import pyarrow as pa

    size, _ = varint(data, 0)
    if size > len(data) * LARGEST_RATIO:
        raise ValueError("a size that no such body has")
    try:
        return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
    except OSError as e:
        raise ValueError(str(e)) from None


def decode_remote_write(body: bytes, compressed: bool = True) -> list[dict]:
    """The time series of a remote-write request."""
    series = []
    for number, kind, value in fields(unsnappy(body) if compressed else body):
        if (number, kind) != (1, 2):
            continue
        labels, samples = [], []
        for number, kind, part in fields(value):
            if kind != 2:
                continue
            got = {n: v for n, _, v in fields(part)}
            if number == 1:
                labels.append({"name": got.get(1, b"").decode(), "value": got.get(2, b"").decode()})
            elif number == 2:
                ms = got.get(2, 0)
                samples.append({"timestamp_ms": ms - (1 << 64) if ms >> 63 else ms, "value": struct.unpack("<d", got[1])[0] if 1 in got else 0.0})
        series.append({"labels": labels, "samples": samples})
    return series


def remote_write(payloads: DataFrame, column: str = "body") -> DataFrame:
    """The series of each remote-write body of a binary column, and the error of a body that is none, decoded in Arrow batches.

    A bad body costs its own series only.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("labels", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("samples", pa.list_(pa.struct([("timestamp_ms", pa.int64()), ("value", pa.float64())])))]))

    def run(batches):
        for b in batches:
            got = [attempted(decode_remote_write, x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], kind), pa.array([e for _, e in got], pa.string())], ["series", "error"])

    return payloads.select(column).where(F.col(column).isNotNull()).mapInArrow(run, f"series {SERIES}, error string")


def attempted(decode, body) -> tuple[list, str | None]:
    """What a body decodes to, or nothing and why."""
    try:
        return decode(body), None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError, struct.error) as e:
        return [], f"{type(e).__name__}: {e}"


def routed(v: Column) -> list[Column]:
    """A value in one of three columns: whole numbers unsigned if not negative, else signed; all others as doubles."""
    whole = ~F.isnan(v) & (F.abs(v) != float("inf")) & (v == F.floor(v))
    unsigned = whole & (v >= 0) & (v < float(1 << 64))
    signed = whole & (v < 0) & (v >= float(-(1 << 63)))
    return [
        F.when(~(unsigned | signed), v).alias("value_f64"),
        F.when(signed, v.try_cast("bigint")).alias("value_i64"),
        F.when(unsigned, v.try_cast("decimal(20,0)")).alias("value_u64"),
    ]


def series_rows(series: DataFrame) -> DataFrame:
    """One row a sample (timestamp_ns, metric_name, labels, value columns); a series without a name has the empty one."""
    one = series.select(F.explode("series").alias("s")).select("s.labels", F.explode("s.samples").alias("p"))
    pairs = F.transform("labels", lambda x: F.struct(x["name"], x["value"]))
    every = F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["name"]), F.create_map(x["name"], x["value"])))
    rows = one.select((F.col("p.timestamp_ms") * 1_000_000).alias("timestamp_ns"), every.alias("every"), F.col("p.value").alias("v"))
    labels = F.map_filter("every", lambda k, _: k != "__name__")
    return rows.select("timestamp_ns", F.coalesce(F.try_element_at("every", F.lit("__name__")), F.lit("")).alias("metric_name"), labels.alias("labels"), *routed(F.col("v")))


def widened(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The label map as columns; by default every key in the data, found by one distinct aggregation."""
    if labels is None:
        labels = sorted(r[0] for r in rows.select(F.explode(F.map_keys("labels"))).distinct().collect())
    rest = [c for c in rows.columns if c not in ("timestamp_ns", "metric_name", "labels")]
    return rows.select("timestamp_ns", "metric_name", *[F.try_element_at("labels", F.lit(k)).alias(k) for k in labels], *rest)


def any_value(value: dict | None) -> str | None:
    """An OTLP attribute value as text; bytes in base64."""
    if not value:
        return None
    kind, v = next(iter(value.items()))
    if kind == "bytesValue":
        return base64.b64encode(v).decode() if isinstance(v, bytes) else str(v)
    if kind == "boolValue":
        return "true" if v else "false"
    if kind == "arrayValue":
        return "[" + ",".join(any_value(x) or "" for x in v.get("values", [])) + "]"
    if kind == "kvlistValue":
        return "{" + ",".join(f"{x['key']}:{any_value(x.get('value')) or ''}" for x in v.get("values", [])) + "}"
    return str(v)


def attributes(listed: list[dict] | None) -> dict[str, str]:
    return {a["key"]: any_value(a.get("value")) or "" for a in listed or []}


def otlp_points(request: dict) -> list[dict]:
    """Points of an OTLP/JSON export request.

    Gauges and sums give their number, NaN if none; histograms their sum, else
    their count; summaries their sum.  A point's attribute hides the resource's.
    """
    out = []
    for resource in request.get("resourceMetrics", []):
        shared = attributes(resource.get("resource", {}).get("attributes"))
        for scope in resource.get("scopeMetrics", []):
            for metric in scope.get("metrics", []):
                for kind in ("gauge", "sum", "histogram", "exponentialHistogram", "summary"):
                    for p in metric.get(kind, {}).get("dataPoints", []):
                        if kind in ("gauge", "sum"):
                            v = p.get("asDouble", p.get("asInt", float("nan")))
                        elif kind == "summary":
                            v = p.get("sum", 0.0)
                        else:
                            v = p.get("sum", p.get("count", 0))
                        out.append({"timestamp_ns": int(p.get("timeUnixNano", 0)), "metric_name": metric.get("name", ""), "value": float(v), "labels": shared | attributes(p.get("attributes"))})
    return out


def otlp_rows(spark: SparkSession, requests: list[dict]) -> DataFrame:
    """Points as rows (timestamp_ns, metric_name, labels, value_f64); an export without points is an error."""
    points = [p for r in requests for p in otlp_points(r)]
    if not points:
        raise ValueError("no data points")
    rows = spark.createDataFrame(points, "timestamp_ns long, metric_name string, value double, labels map<string,string>")
    return rows.withColumnRenamed("value", "value_f64")


#: fixed values: field numbers of the export request and of what it holds, with the names of the same in JSON.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "request": {1: ("resourceMetrics", "*resource_metrics")},
    "resource_metrics": {1: ("resource", "resource"), 2: ("scopeMetrics", "*scope_metrics")},
    "resource": {1: ("attributes", "*pair")},
    "scope_metrics": {2: ("metrics", "*metric")},
    "metric": {1: ("name", "text"), 5: ("gauge", "numbers"), 7: ("sum", "numbers"), 9: ("histogram", "histograms"), 10: ("exponentialHistogram", "wide_histograms"), 11: ("summary", "summaries")},
    "numbers": {1: ("dataPoints", "*number")},
    "histograms": {1: ("dataPoints", "*histogram")},
    "wide_histograms": {1: ("dataPoints", "*wide_histogram")},
    "summaries": {1: ("dataPoints", "*summary")},
    "number": {3: ("timeUnixNano", "fixed"), 4: ("asDouble", "double"), 6: ("asInt", "signed"), 7: ("attributes", "*pair")},
    "histogram": {3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 9: ("attributes", "*pair")},
    "wide_histogram": {1: ("attributes", "*pair"), 3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double")},
    "summary": {3: ("timeUnixNano", "fixed"), 4: ("count", "fixed"), 5: ("sum", "double"), 7: ("attributes", "*pair")},
    "pair": {1: ("key", "text"), 2: ("value", "any")},
    "any": {1: ("stringValue", "text"), 2: ("boolValue", "flag"), 3: ("intValue", "whole"), 4: ("doubleValue", "double"), 5: ("arrayValue", "list"), 6: ("kvlistValue", "pairs"), 7: ("bytesValue", "raw")},
    "list": {1: ("values", "*any")},
    "pairs": {1: ("values", "*pair")},
}
SCALARS = {
    "text": lambda v: v.decode(),
    "raw": bytes,
    "flag": bool,
    "fixed": lambda v: int.from_bytes(v, "little"),
    "signed": lambda v: int.from_bytes(v, "little", signed=True),
    "double": lambda v: struct.unpack("<d", v)[0],
    "whole": lambda v: v - (1 << 64) if v >> 63 else v,
}


def message(data: bytes, kind: str = "request") -> dict:
    """An OTLP message as its JSON form; fields that points do not need are passed over."""
    out: dict = {}
    for number, _, value in fields(data):
        if number not in MESSAGES[kind]:
            continue
        name, inner = MESSAGES[kind][number]
        plain = inner.removeprefix("*")
        got = SCALARS[plain](value) if plain in SCALARS else message(value, plain)
        if inner != plain:
            out.setdefault(name, []).append(got)
        else:
            out[name] = got
    return out


def otlp_decoded(payloads: DataFrame, column: str = "body") -> DataFrame:
    """The points of each OTLP body, and the error of a body that is none: protobuf in a binary column, JSON in a string one."""
    import json

    import pyarrow as pa

    kind = pa.list_(pa.struct([("timestamp_ns", pa.int64()), ("metric_name", pa.string()), ("value", pa.float64()), ("labels", pa.map_(pa.string(), pa.string()))]))

    def points(body: str | bytes) -> list[dict]:
        found = otlp_points(json.loads(body) if isinstance(body, str) else message(body))
        return [p | {"labels": list(p["labels"].items())} for p in found]

    def run(batches):
        for b in batches:
            got = [attempted(points, x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], kind), pa.array([e for _, e in got], pa.string())], ["points", "error"])

    return payloads.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "points array<struct<timestamp_ns:long,metric_name:string,value:double,labels:map<string,string>>>, error string")


def otlp(payloads: DataFrame, column: str = "body") -> DataFrame:
    """As ``otlp_rows`` for a column of OTLP bodies, decoded on the executors; bad bodies give no rows (``otlp_decoded`` names them)."""
    return otlp_decoded(payloads, column).select(F.explode("points").alias("p")).select("p.timestamp_ns", "p.metric_name", F.col("p.value").alias("value_f64"), "p.labels")


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table as metric rows; ``timestamp`` may be 64-bit nanoseconds or any Arrow timestamp."""
    import pyarrow as pa

    if "timestamp" in table.column_names:
        at = table.schema.get_field_index("timestamp")
        kind = table.schema.field(at).type
        if pa.types.is_timestamp(kind):
            ns = table.column(at).cast(pa.timestamp("ns", kind.tz)).cast(pa.int64())
        elif pa.types.is_int64(kind):
            ns = table.column(at)
        else:
            raise ValueError(f"timestamp must be int64 or a timestamp, not {kind}")
        table = table.set_column(at, "timestamp_ns", ns)
    for i, f in enumerate(table.schema):
        if pa.types.is_dictionary(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(f.type.value_type))
        elif pa.types.is_uint64(f.type):
            table = table.set_column(i, f.name, table.column(i).cast(pa.decimal128(20, 0)))
    return spark.createDataFrame(table)


def conform(rows: DataFrame, labels: tuple[str, ...] = DEFAULT_LABELS) -> DataFrame:
    """Rows under the declared schema: missing columns are null, extra ones go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in metric_schema(labels).fields])


def promoted(rows: DataFrame, label: str) -> DataFrame:
    """A key of the label map as a column of its own."""
    return rows.withColumn(label, F.try_element_at("labels", F.lit(label))).withColumn("labels", F.map_filter("labels", lambda k, _: k != label))


def generated(spark: SparkSession, samples: int, hosts: int = 3, start_ns: int = 1_700_000_000_000_000_000, step_ns: int = 1_000_000_000, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """A synthetic workload: a sine, a random walk, a counter and a constant with jitter for each host.

    Walks and counters are sums of hashed steps inside one series, so rows do not depend on the partitioning.
    """
    from pyspark.sql import Window

    shapes = ["cpu_usage", "memory_bytes", "requests_total", "gc_pause"]
    base = spark.range(0, samples * hosts * len(shapes), 1, partitions) if partitions else spark.range(samples * hosts * len(shapes))
    rows = base.select((F.col("id") % samples).alias("i"), (F.floor(F.col("id") / samples) % hosts).alias("h"), F.floor(F.col("id") / (samples * hosts)).cast("int").alias("shape"))
    noise = F.shiftrightunsigned(F.xxhash64("i", "h", "shape", F.lit(seed)), 11) / F.lit(float(1 << 53))
    rows = rows.withColumn("noise", noise)
    total = Window.partitionBy("h", "shape").orderBy("i")
    walk = F.lit(4e9) + F.sum((F.col("noise") - 0.5) * 1e7).over(total)
    count = F.sum(F.floor(F.col("noise") * 100)).over(total).cast("double")
    value = F.when(F.col("shape") == 0, F.lit(52.5) + 42.5 * F.sin(F.col("i") * (2 * 3.141592653589793 / 300))).when(F.col("shape") == 1, walk).when(F.col("shape") == 2, count).otherwise(F.lit(5.0) + F.col("noise"))
    return rows.select(
        (F.lit(start_ns) + F.col("i") * step_ns).alias("timestamp_ns"),
        F.get(F.array(*[F.lit(s) for s in shapes]), F.col("shape")).alias("metric_name"),
        F.concat(F.lit("host-"), F.col("h").cast("string")).alias("host"),
        F.get(F.array(F.lit("east"), F.lit("west")), F.pmod("h", F.lit(2)).cast("int")).alias("region"),
        value.alias("value_f64"),
    )
