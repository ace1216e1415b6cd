"""SQL front: tables bound for one query, statements beside queries, chunk pruning, results as JSON, Arrow or CSV."""

from __future__ import annotations

import io
import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.predicates import Any_
from ..sources.cache import ReadCache
from ..sources.catalog import Catalog
from .dialect import Token, Translator, Unsupported, closing, find, literal, name_of, split, tokens
from .filters import each, kind_of, scans

Table = DataFrame | Catalog | Callable[[], DataFrame]
#: fixed values: names of the catalog and of its one schema.
CATALOG, SCHEMA = "tidemark", "default"
#: Words that end the list of tables after FROM.
AFTER_TABLES = {"where", "group", "having", "order", "limit", "offset", "union", "except", "intersect", "qualify", "window", "on", "using", "select", "set", "fetch"}
#: Words that follow a table without being its alias.
NO_ALIAS = AFTER_TABLES | {"join", "inner", "left", "right", "full", "cross", "natural", "semi", "anti", "lateral", "tablesample", "as", "by"}
#: fixed values: types that clients are told of: name, ODBC code, size and quoting.
CLIENT_TYPES = (("VARCHAR", 12, 2147483647, "'"), ("DOUBLE", 8, 15, None), ("BIGINT", -5, 19, None))
#: Rounds of whole-number division inside whole-number division.
DIVISIONS = 16


def bound(ts: list[Token], views: dict[str, str], shadow: frozenset[str] = frozenset()) -> list[Token]:
    """The statement with its tables named as ``views`` has them, under their own names as aliases.

    A name that a WITH clause defines is that clause's, from where its scope begins.
    """
    out: list[Token] = []
    i = 0
    if ts and ts[0].word == "with":
        recursive = len(ts) > 1 and ts[1].word == "recursive"
        i = 1 + recursive
        out += ts[:i]
        while i < len(ts):
            name = name_of(ts[i]).lower()
            while ts[i].word != "as":
                end = closing(ts, i) + 1 if ts[i].text == "(" else i + 1
                out += ts[i:end]
                i = end
            body = next(k for k in range(i, len(ts)) if ts[k].text == "(")
            end = closing(ts, body)
            out += [*ts[i : body + 1], *bound(ts[body + 1 : end], views, shadow | {name} if recursive else shadow), ts[end]]
            shadow |= {name}
            i = end + 1
            if i >= len(ts) or ts[i].text != ",":
                break
            out.append(ts[i])
            i += 1
    tables, expected = False, False  # inside a list of tables, and at a place where one is named
    while i < len(ts):
        t = ts[i]
        if t.kind == "op" and t.text in ("(", "[", "{"):
            end = closing(ts, i)
            inside = ts[i + 1 : end]
            if tables and expected and inside and inside[0].word not in ("select", "with", "values"):
                inside = bound([Token("word", "FROM"), *inside], views, shadow)[1:]
            else:
                inside = bound(inside, views, shadow)
            out += [t, *inside, ts[end]]
            i, expected = end + 1, False
            continue
        if t.word in ("from", "join"):
            tables = expected = True
        elif t.kind == "op" and t.text == "," and tables:
            expected = True
        elif t.word in AFTER_TABLES:
            tables = expected = False
        elif expected and t.word != "lateral" and t.kind in ("word", "quoted"):
            expected, after = False, ts[i + 1] if i + 1 < len(ts) else Token("op", "")
            if t.word == "information_schema" and after.text == "." and i + 2 < len(ts):
                name, i = f"information_schema.{name_of(ts[i + 2]).lower()}", i + 2
            else:
                while after.text == "." and i + 2 < len(ts) and name_of(ts[i]).lower() in (CATALOG, SCHEMA):
                    i += 2
                    after = ts[i + 1] if i + 1 < len(ts) else Token("op", "")
                name = name_of(ts[i]).lower()
            after = ts[i + 1] if i + 1 < len(ts) else Token("op", "")
            if name in views and name not in shadow and after.text != "(":
                out.append(Token("word", views[name]))
                alias = after.kind == "quoted" or (after.kind == "word" and after.word not in NO_ALIAS)
                if after.word != "as" and not alias:
                    out += [Token("word", "AS"), Token("quoted", f'"{name.rpartition(".")[2]}"')]
                i += 1
                continue
            t = ts[i]
        out.append(t)
        i += 1
    return out


@dataclass
class Telemetry:
    """Queries by outcome, and the seconds that planning took."""

    queries: int = 0
    errors: int = 0
    seconds: list[float] = field(default_factory=list)

    def __getitem__(self, name: str) -> int:
        return getattr(self, name)


class QueryNode:
    """Runs the dialect's SQL over tables given as frames, as functions that make one, or as catalogs of chunks.

    Each query binds its tables under names of its own, so concurrent queries
    never see each other's.  Of a catalog only those chunks are read that the
    query's own filters, as the optimizer left them, do not rule out.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, Table], caches: dict[str, ReadCache] | None = None):
        self.spark = spark
        #: Read caches of catalogs, by table: chunk sets that are asked for again come from memory.
        self.caches = caches or {}
        self.tables: dict[str, Table] = {n.lower(): t for n, t in tables.items()}
        self.prepared: dict[str, tuple[str, int]] = {}
        self.counts = Telemetry()
        #: Chunks read and chunks there, by table, of the last query over catalogs.
        self.chunks: dict[str, tuple[int, int]] = {}

    # -- tables ------------------------------------------------------------------

    def frame(self, name: str) -> DataFrame:
        t = self.tables[name]
        return t.read() if isinstance(t, Catalog) else t() if callable(t) else t

    def schema_of(self, name: str) -> StructType:
        t = self.tables[name]
        return t.schema() if isinstance(t, Catalog) else self.frame(name).schema

    def information(self, name: str) -> DataFrame | None:
        """A view of the information schema."""
        name = name.removeprefix("information_schema.")
        if name == "tables":
            rows, kind = [(CATALOG, SCHEMA, n, "BASE TABLE") for n in sorted(self.tables)], "table_catalog string, table_schema string, table_name string, table_type string"
        elif name == "schemata":
            rows, kind = [(CATALOG, SCHEMA)], "catalog_name string, schema_name string"
        elif name == "columns":
            rows = [(CATALOG, SCHEMA, n, f.name, k, "YES" if f.nullable else "NO", f.dataType.simpleString()) for n in sorted(self.tables) for k, f in enumerate(self.schema_of(n).fields)]
            kind = "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string"
        else:
            return None
        return self.spark.createDataFrame(rows, kind)

    # -- queries -----------------------------------------------------------------

    def query(self, sql: str, *values, **named) -> DataFrame:
        """The rows of a statement; ``values`` are its placeholders ``$1`` or ``?``, ``named`` those like ``:name``."""
        began = time.perf_counter()
        self.counts.queries += 1
        try:
            ts = tokens(sql)
            while ts and ts[-1].text == ";":
                ts.pop()
            return self.statement(ts, {f"p{i}": v for i, v in enumerate(values, 1)} | named)
        except Exception:
            self.counts.errors += 1
            raise
        finally:
            self.counts.seconds.append(time.perf_counter() - began)
            del self.counts.seconds[:-10_000]

    def statement(self, ts: list[Token], args: dict) -> DataFrame:
        words = [t.word for t in ts[:4]] + [""] * 4
        if words[0] == "explain":
            return self.explained([t for k, t in enumerate(ts) if k and not (k < 3 and t.word in ("analyze", "verbose"))], args)
        if words[:2] == ["show", "tables"]:
            return self.information("tables")
        if words[0] in ("describe", "desc") or words[:2] == ["show", "columns"]:
            name = name_of(ts[-1]).lower()
            if name not in self.tables:
                raise ValueError(f"TABLE_OR_VIEW_NOT_FOUND: {name}")
            return self.information("columns").where(F.col("table_name") == name).orderBy("ordinal_position").select("column_name", "data_type", "is_nullable")
        if words[0] == "copy":
            return self.copied(ts, args)
        if words[0] in ("create", "drop"):
            return self.defined(ts, args)
        if words[0] not in ("select", "with", "values", "") or (words[0] == "" and ts[:1] and ts[0].text != "("):
            raise Unsupported(f"no statement: {words[0]}")
        at = find(ts, {"union"})
        while at < len(ts):  # UNION BY NAME, which Spark has for frames only
            every = ts[at + 1].word == "all"
            if [t.word for t in ts[at + 1 + every : at + 3 + every]] == ["by", "name"]:
                out = self.statement(ts[:at], args).unionByName(self.statement(ts[at + 3 + every :], args), allowMissingColumns=True)
                return out if every else out.distinct()
            at = find(ts, {"union"}, at + 1)
        return self.selected(ts, args)

    def selected(self, ts: list[Token], args: dict) -> DataFrame:
        spoken = {name_of(t).lower() for t in ts if t.kind in ("word", "quoted")}
        frames = {n: self.probe(n) for n in self.tables if n in spoken}
        frames |= {f"information_schema.{n}": f for n in ("tables", "columns", "schemata") if "information_schema" in spoken and n in spoken and (f := self.information(n)) is not None}
        catalogs = {n: self.tables[n] for n in frames if isinstance(self.tables.get(n), Catalog)}
        if catalogs:
            probe = self.analysed(ts, frames, args)
            found = scans(probe)
            self.chunks = {}
            for n, c in catalogs.items():
                now = c.snapshot()
                conditions = found.get(c.probe_path(now))
                predicate = None if conditions is None or None in conditions else Any_(tuple(conditions))
                read = now.prune(predicate) if conditions is not None else []
                self.chunks[n] = (len(read), len(now.chunks))
                frames[n] = self.caches[n].get(read) if n in self.caches and read else c.rows_of(read, now)
        return self.analysed(ts, frames, args)

    def probe(self, name: str) -> DataFrame:
        t = self.tables[name]
        return t.probe() if isinstance(t, Catalog) else self.frame(name)

    def analysed(self, ts: list[Token], frames: dict[str, DataFrame], args: dict) -> DataFrame:
        """The analysed query: translated, its tables bound, and whole numbers divided as such."""
        views = {n: f"q_{uuid.uuid4().hex}" for n in frames}
        try:
            for n, f in frames.items():
                f.createTempView(views[n])
            text = Translator().text(bound(ts, views))
            run = lambda: self.spark.sql(text, args=args or None)
            out = run()
            for _ in range(DIVISIONS):
                if "/" not in text or not (places := whole_divisions(out, text)):
                    return out
                for at in sorted(places, reverse=True):
                    text = f"{text[:at]} DIV {text[at + 1 :]}"
                out = run()
            return out
        finally:
            for v in views.values():
                self.spark.catalog.dropTempView(v)

    def schema(self, sql: str, *values, **named) -> StructType:
        """The result's schema; nothing runs."""
        return self.query(sql, *values, **named).schema

    # -- prepared statements -------------------------------------------------------

    def prepare(self, sql: str) -> str:
        """A handle of a statement that has been analysed, its placeholders as nulls; it is planned anew at each execution."""
        translator = Translator()
        translator.text(tokens(sql))
        self.schema(sql, *[None] * translator.parameters)
        handle = uuid.uuid4().hex
        self.prepared[handle] = (sql, translator.parameters)
        return handle

    def execute(self, handle: str, *values) -> DataFrame:
        sql, n = self.prepared[handle]
        if len(values) != n:
            raise ValueError(f"the statement has {n} parameters, {len(values)} were given")
        return self.query(sql, *values)

    def close(self, handle: str) -> None:
        self.prepared.pop(handle, None)

    # -- other statements ------------------------------------------------------------

    def explain(self, sql: str) -> str:
        return self.query(sql)._jdf.queryExecution().toString()

    def explained(self, ts: list[Token], args: dict) -> DataFrame:
        run = self.statement(ts, args)._jdf.queryExecution()
        return self.spark.createDataFrame([("logical_plan", run.optimizedPlan().toString()), ("physical_plan", run.executedPlan().toString())], "plan_type string, plan string")

    def copied(self, ts: list[Token], args: dict) -> DataFrame:
        """COPY (query | table) TO 'path' [STORED AS format]: writes the rows; the result is their number."""
        at = find(ts, {"to"}, 1)
        stored = find(ts, {"as"}, at)
        path = literal(ts[at + 1].text)
        form = name_of(ts[stored + 1]).lower() if stored < len(ts) else path.rpartition(".")[2].lower()
        if form not in ("parquet", "csv", "json"):
            raise Unsupported(f"no format {form}")
        rows = self.statement(ts[2:][: closing(ts, 1) - 2], args) if ts[1].text == "(" else self.frame(name_of(ts[1]).lower())
        rows.write.format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)
        return self.spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).schema(rows.schema).load(path).agg(F.count("*").alias("count"))

    def defined(self, ts: list[Token], args: dict) -> DataFrame:
        """CREATE [OR REPLACE] VIEW | TABLE ... AS query, CREATE EXTERNAL TABLE ... STORED AS ... LOCATION, and DROP."""
        words = [t.word for t in ts]
        lenient = "exists" in words
        if words[0] == "drop":
            name = name_of(ts[-1]).lower()
            if self.tables.pop(name, None) is None and not lenient:
                raise ValueError(f"TABLE_OR_VIEW_NOT_FOUND: {name}")
            return self.information("tables")
        kind = find(ts, {"view", "table"})
        at = kind + 1 + (3 if words[kind + 1 : kind + 4] == ["if", "not", "exists"] else 0)
        name = name_of(ts[at]).lower()
        if name in self.tables and "replace" not in words[:3]:
            if lenient:
                return self.information("tables")
            raise ValueError(f"TABLE_OR_VIEW_ALREADY_EXISTS: {name}")
        if "external" in words[:4]:
            form, place = name_of(ts[find(ts, {"as"}) + 1]).lower(), literal(ts[find(ts, {"location"}) + 1].text)
            self.tables[name] = self.spark.read.options(**({"header": "true", "inferSchema": "true"} if form == "csv" else {})).format(form).load(place)
        else:
            self.tables[name] = self.statement(ts[find(ts, {"as"}, at) + 1 :], args)
        return self.information("tables")

    # -- metadata --------------------------------------------------------------------

    def list_catalogs(self) -> DataFrame:
        return self.spark.createDataFrame([(CATALOG,)], "catalog_name string")

    def list_schemas(self) -> DataFrame:
        return self.spark.createDataFrame([(CATALOG, SCHEMA)], "catalog_name string, db_schema_name string")

    def list_table_types(self) -> DataFrame:
        return self.spark.createDataFrame([("TABLE",), ("VIEW",)], "table_type string")

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(CATALOG, SCHEMA, n, "TABLE") for n in sorted(self.tables)], "catalog string, schema string, table string, type string")

    def list_columns(self) -> DataFrame:
        rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n in sorted(self.tables) for f in self.schema_of(n).fields]
        return self.spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")

    def sql_info(self) -> DataFrame:
        """What clients ask of a server before they speak to it."""
        rows = [("server_name", CATALOG), ("server_version", self.spark.version), ("read_only", "true"), ("identifier_quote", '"'), ("substrait", "false"), ("transactions", "none")]
        return self.spark.createDataFrame(rows, "info string, value string")

    def type_info(self) -> DataFrame:
        return self.spark.createDataFrame([*CLIENT_TYPES], "type_name string, data_type int, column_size int, literal_prefix string")


def whole_divisions(df: DataFrame, text: str) -> set[int]:
    """Places of the signs that divide whole numbers by whole numbers in an analysed query's text.

    The analyzer has cast both sides to doubles there; casts of the text itself bear a tag.
    """
    whole, found = ("tinyint", "smallint", "int", "bigint"), set()
    tag = df.sparkSession._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    plans, expressions = [df._jdf.queryExecution().analyzed()], []
    while plans or expressions:
        if plans:
            plan = plans.pop()
            plans += each(plan.children()) + each(plan.subqueries())
            expressions += each(plan.expressions())
            continue
        node = expressions.pop()
        expressions += each(node.children())
        if kind_of(node) != "Divide":
            continue
        sides = [node.left(), node.right()]
        if all(kind_of(x) == "Cast" and not x.getTagValue(tag).isDefined() and x.child().dataType().simpleString() in whole for x in sides):
            stop = sides[0].child().origin().stopIndex()
            at = text.find("/", stop.get() + 1) if stop.isDefined() else -1
            if at >= 0:
                found.add(at)
    return found


def json_ready(df: DataFrame) -> DataFrame:
    """Times as whole nanoseconds; numbers that JSON lacks as null."""
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp")) * 1000
        elif kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def result(df: DataFrame, form: str = "json", most: int = 1_000_000) -> str | bytes:
    """A result for a client; one of more than ``most`` rows is refused: write it with ``df.write`` instead."""
    if form not in ("json", "arrow", "csv"):
        raise ValueError(f"unknown format {form}")
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write them to storage")
    if form == "json":
        names = df.columns
        rows = [{n: plain(v) for n, v in zip(names, r)} for r in json_ready(df).toLocalIterator()]
        return json.dumps({"columns": names, "rows": rows})
    if form == "arrow":
        import pyarrow as pa

        sink, table = io.BytesIO(), df.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue()
    import csv

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows([["" if v is None else v for v in r] for r in df.toLocalIterator()])
    return out.getvalue()


def plain(v):
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    return v if v is None or isinstance(v, (bool, int, str, list, dict)) else str(v)


@dataclass
class QueryLog:
    """Columns that queries filter and group by, for the advisor; ``flush`` moves what has been gathered to storage."""

    rows: list[tuple] = field(default_factory=list)
    path: str | None = None
    most: int = 10_000

    def record(self, tenant: str, df: DataFrame) -> None:
        todo = [df._jdf.queryExecution().analyzed()]
        names = lambda e: {x.name() for x in each(e.references().toSeq())}
        while todo:
            node = todo.pop()
            kind = kind_of(node)
            held = [node.condition()] if kind == "Filter" else each(node.groupingExpressions()) if kind == "Aggregate" else []
            used = sorted(set().union(*map(names, held)))
            self.rows += [(tenant, c, "filter" if kind == "Filter" else "group") for c in used]
            todo += each(node.children())
        if self.path and len(self.rows) >= self.most:
            self.flush(df.sparkSession)

    def frame(self, spark: SparkSession) -> DataFrame:
        """What has been recorded: the rows in storage and those not yet flushed."""
        kind = "tenant string, column string, kind string"
        here = spark.createDataFrame(self.rows, kind)
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path) if self.path else None
        there = p is not None and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        return spark.read.schema(kind).parquet(self.path).unionByName(here) if there else here

    def flush(self, spark: SparkSession) -> None:
        if self.path and self.rows:
            spark.createDataFrame(self.rows, "tenant string, column string, kind string").coalesce(1).write.mode("append").parquet(self.path)
            self.rows.clear()
