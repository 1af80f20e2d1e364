"""Queries over tables of events: event trees, segments, histograms, property values, customers and batches."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.errors import AnalysisError, ConfigError, ParseError, QueryError
from cohortlake.operators import histogram as hist
from cohortlake.operators import render, rows, segments
from cohortlake.operators.tally import compare, tally
from cohortlake.plans.interpreter import Interpreter
from cohortlake.plans.lowering import Grouped, Lowering, Unsupported, needs, needs_places, per_value
from cohortlake.plans.syntax import Script, parse, walk
from cohortlake.sources import events as source
from cohortlake.spec import Catalog, Property, TableSpec
from cohortlake.store import written


#: Scripts that foreach cannot aggregate by value run once per customer and value: so many values at a time.
FOREACH_VALUES = 10_000


@dataclass
class Result:
    """frame: (d, groups.., aggregates); plan says how the script ran and why."""

    frame: DataFrame
    groups: list[str]
    plan: str
    warnings: list[str] = field(default_factory=list)
    sort: tuple[str | None, str] = (None, "desc")
    trim: int | None = None

    def tree(self) -> dict:
        return render.tree(self.frame, self.groups, sort=self.sort[0], order=self.sort[1], trim=self.trim)

    def explain(self) -> None:
        print(self.plan)
        self.frame.explain("formatted")


@dataclass
class Bound:
    spec: TableSpec
    events: DataFrame
    customers: DataFrame
    next_seq: int | None = None


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog()
        self.tables: dict[str, Bound] = {}
        self.segments: dict[str, dict[str, tuple[segments.SegmentSpec, DataFrame]]] = {}

    # tables

    def create_table(self, spec: TableSpec) -> None:
        self.catalog.create(spec)
        self.bind(spec, self.spark.createDataFrame([], T.StructType([*spec.events_schema().fields, T.StructField("z", T.IntegerType()), T.StructField("seq", T.LongType())])), self.spark.createDataFrame([], spec.customers_schema()))

    def bind(self, spec: TableSpec, events: DataFrame, customers: DataFrame | None = None) -> None:
        """A table over existing DataFrames of engine events and customer properties."""
        if spec.name not in self.catalog.list():
            self.catalog.create(spec)
        self.tables[spec.name] = Bound(spec, events, customers if customers is not None else events.select("id").distinct())
        self.segments.setdefault(spec.name, {})

    def table(self, name: str) -> Bound:
        self.catalog.describe(name)
        return self.tables[name]

    def drop_table(self, name: str) -> None:
        self.catalog.drop(name)
        self.tables.pop(name, None)
        self.segments.pop(name, None)

    def add_property(self, name: str, p: Property) -> None:
        b = self.table(name)
        b.spec = self.catalog.alter(b.spec.with_property(p))
        if p.is_customer:
            b.customers = b.customers.withColumn(p.name, F.lit(None).cast(p.spark_type))
        else:
            b.events = b.events.withColumn(p.name, F.lit(None).cast(p.spark_type))

    def drop_property(self, name: str, prop: str) -> None:
        b = self.table(name)
        b.spec = self.catalog.alter(b.spec.without_property(prop))
        b.events, b.customers = b.events.drop(prop), b.customers.drop(prop)

    def set_settings(self, name: str, **changes: int) -> None:
        b = self.table(name)
        b.spec = self.catalog.alter(b.spec.with_settings(**changes))

    def insert(self, name: str, raw: DataFrame, *, now: int | None = None) -> None:
        """Raw events (columns of JSON fields) merged into the table by the ingest rules.

        Only customers that the new events touch are merged anew; the table is written, so its plan does not grow."""
        b = self.table(name)
        if b.next_seq is None:
            b.next_seq = b.events.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]
        fresh = written(source.coerce(raw, b.spec).withColumn("seq", F.monotonically_increasing_id() + b.next_seq), "fresh")
        touched = fresh.select("id").distinct()
        names = ["id", "stamp", "event", *[p.name for p in b.spec.event_properties]]
        olds = b.events.join(touched, "id", "left_semi").select(*names, "seq")
        merged = source.merged(olds.unionByName(fresh.select(*names, "seq")), b.spec, now=now)
        rest = b.events.join(touched, "id", "left_anti")
        if now is not None:
            rest = rest.where(F.col("stamp") > now - b.spec.setting("event_ttl"))
        own = [p.name for p in b.spec.customer_properties]
        kept = b.customers.select("id", *[F.col(p).alias(f"_{p}") for p in own])
        told = source.customers(fresh, b.spec).join(kept, "id", "full_outer")
        b.events = written(rest.select(*names, "z", "seq").unionByName(merged.select(*names, "z", "seq")), "events")
        b.customers = written(told.select("id", *[F.coalesce(p, f"_{p}").alias(p) for p in own]), "customers")
        b.next_seq = max(b.next_seq, fresh.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"])

    def members(self, name: str) -> DataFrame:
        """(segment, id) of all stored segments."""
        b = self.table(name)
        out = self.spark.createDataFrame([], T.StructType([T.StructField("segment", T.StringType()), T.StructField("id", b.events.schema["id"].dataType)]))
        for _, m in self.segments[name].values():
            out = out.unionByName(m)
        return out

    # scripts

    def parsed(self, b: Bound, script: str, precedence: str, params: dict | None) -> Script:
        return parse(script, {p.name for p in b.spec.properties} | set(b.events.columns), precedence=precedence, params=params)

    def frame(self, b: Bound, script: Script, session_ms: int | None, only: list[str] | None = None, extra: set[str] = frozenset(), places: bool = True) -> DataFrame:
        """Ordered rows with the columns the script mentions; session and metadata only where it does."""
        own = {c for c in b.events.columns if c not in ("id", "stamp", "event", "z", "seq")}
        used = needs(script, own) | (extra & own)
        events = b.events if not only or "*" in only else segments.restrict(b.events, self.members(b.spec.name), *only)
        out = events.select("id", "stamp", "event", "z", "seq", *sorted(used))
        out = rows.number(out) if places else out.withColumn("rn", F.col("seq"))
        said = {n.value for n in walk(script.body) if n.kind in ("name", "call", "filter")} | {a.prop for a in script.select} | set(extra)
        if {"session", "session_count"} & said:
            out = rows.with_session(out, session_ms or b.spec.setting("session_time"))
        out = rows.with_metadata(out, *[m for m in ("row_count", "first_stamp", "last_stamp", "session_count") if m in said])
        props = [p.name for p in b.spec.customer_properties if p.name in said]
        if props:
            out = rows.attach(out, b.customers.select("id", *[F.col(p).alias(f"_customer_{p}") for p in props]))
        return out

    def interpret(self, b: Bound, script: Script, frame: DataFrame, *, now: int, depth: int, session_ms: int, compat: bool, returned: T.DataType | None = None, each: str | None = None) -> DataFrame:
        """The script on each customer by the interpreter: a row per push (g1..), or one per customer that returned.

        A customer's rows are one group, which event_max bounds when events are ingested.
        """
        props = [c for c in frame.columns if c.startswith("_customer_")]
        data = [c for c in frame.columns if c not in props]
        aggs = [c for c in dict.fromkeys(a.prop for a in script.select) if c in data and c not in ("id", "rn", "stamp", "event", "session")]
        keys = [c for c in dict.fromkeys(a.key for a in script.select if a.key) if c in data and c not in ("id", "rn", "stamp", "event", "session", *aggs)]
        carried = ["id", "rn", "stamp", "event", *(["session"] if "session" in data else []), *aggs, *keys]
        if returned is None:
            schema = T.StructType([*[T.StructField(c, frame.schema[c].dataType) for c in carried], *[T.StructField(f"g{k + 1}", T.StringType()) for k in range(depth)]])
        else:
            schema = T.StructType([T.StructField("id", frame.schema["id"].dataType), T.StructField("value", returned)])
        columns, customer = set(data), {c.removeprefix("_customer_") for c in props}

        def text(x) -> str:
            return str(x).lower() if isinstance(x, bool) else str(x)

        made_once: list[Interpreter] = []

        def run(table: list[dict], held: dict) -> list[tuple]:
            if not made_once:
                made_once.append(Interpreter(script, columns=columns, customer_columns=customer, now=now, session_ms=session_ms, compat_nil_order=compat))
            out = made_once[0].run(table, {k.removeprefix("_customer_"): v for k, v in held.items()})
            if returned is not None:
                value = out.returned
                return [] if value is None else [(table[0]["id"], bool(value) if isinstance(returned, T.BooleanType) else float(value))]
            return [(*[table[k].get(c) for c in carried], *[text(x) for x in path], *[None] * (depth - len(path))) for k, path in out.pushes]

        return self.by_group(frame, ["id"], data, props, run, schema)

    def by_group(self, frame: DataFrame, keys: list[str], data: list[str], held: list[str], run, schema: T.StructType) -> DataFrame:
        """run(rows, held values) for the rows of each key, in order of rn.

        Partitions are sorted by key and streamed, so a task holds one group at a time. Their number is given:
        adaptive plans would merge small partitions of slow groups into one task.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)

        def stream(batches):
            now, table, props, made = None, [], {}, []

            def batch(rows_: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows_, strict=True), out, strict=True)], schema=out)

            for b in batches:
                columns = {c: b.column(c).to_pylist() for c in dict.fromkeys([*keys, *data, *held])}
                key_rows = zip(*[columns[k] for k in keys], strict=True)
                for i, (key, values) in enumerate(zip(key_rows, zip(*[columns[c] for c in data], strict=True), strict=True)):
                    if key != now:
                        if table:
                            made += run(table, props)
                        now, table, props = key, [], {c: columns[c][i] for c in held}
                        if len(made) > 10_000:
                            yield batch(made)
                            made = []
                    table.append(dict(zip(data, values, strict=True)))
            if table:
                made += run(table, props)
            if made:
                yield batch(made)

        return frame.repartition(self.tasks(), *keys).sortWithinPartitions(*keys, "rn").mapInArrow(stream, schema)

    def tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def event(self, name: str, script: str, *, segments: list[str] | None = None, sort: str | None = None, order: str | None = None, trim: int | None = None, session_time: int | None = None, stamp_counts: bool = False, now: int | None = None, precedence: str = "usual", params: dict | None = None, compat_nil_order: bool = False, path: str = "auto") -> Result:
        """An event query. path: 'auto', or 'expressions' or 'interpreter' to force one. Two or more
        segments are compared column by column."""
        b = self.table(name)
        s = self.parsed(b, script, precedence, params)
        tallies = [n for n in walk(s.body) if n.kind == "tally"]
        if not tallies:
            raise AnalysisError("an event query needs <<", "no_tally")
        depth = max(len(n.parts) for n in tallies)
        groups = [f"g{k + 1}" for k in range(depth)]
        now = now or int(time.time() * 1000)
        used = {a.prop for a in s.select} | {a.key for a in s.select if a.key}
        only = None if not segments or len(segments) > 1 else segments
        pushes, plan, single = None, "", False
        if path != "interpreter":
            try:
                frame = self.frame(b, s, session_time, only, used, needs_places(s))
                low = Lowering(s, frame, now=now, compat_nil_order=compat_nil_order).run()
                if low.returns:
                    raise Unsupported("return in an event query")
                pushes, plan, single = self.pushed(low, groups), "expressions", len(low.pushes) == 1 and not low.joined and not any(n.kind == "for" for n in walk(s.body))
            except Unsupported as e:
                if path == "expressions":
                    raise QueryError(str(e), "no_expression_form") from e
                plan = f"interpreter, one customer per group: {e}"
        if pushes is None:
            frame = self.frame(b, s, session_time, only, used)
            pushes = self.interpret(b, s, frame, now=now, depth=depth, session_ms=session_time or b.spec.setting("session_time"), compat=compat_nil_order)
            plan = plan or "interpreter, one customer per group"
        options = {"by_stamp": stamp_counts, "distinct_rows": single}
        if segments and len(segments) > 1:
            out = compare(pushes, self.members(name), segments, groups, s.select, **options)
        else:
            out = tally(pushes, groups, s.select, **options)
        key, turn = s.sort or (None, "desc")
        return Result(out, groups, plan, s.warnings, (sort or key, order or turn), trim)

    @staticmethod
    def pushed(low: Lowering, groups: list[str]) -> DataFrame:
        """The pushes of a lowered script in one frame; keys of one type per level keep it, others are text."""
        kinds = [{p.frame.select(p.keys[k].alias("x")).schema["x"].dataType.simpleString() for p in low.pushes if len(p.keys) > k} - {"void"} for k in range(len(groups))]
        out = None
        for p in low.pushes:
            keys = []
            for k, g in enumerate(groups):
                one = next(iter(kinds[k])) if len(kinds[k]) == 1 else "string"
                keys.append((p.keys[k].cast(one) if len(p.keys) > k else F.lit(None).cast(one)).alias(g))
            part = p.frame.select(*[c for c in p.frame.columns if not c.startswith(("_w", "_v", "_on", "_rn"))], *keys)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def per_customer(self, name: str, script: str, kind: T.DataType, *, segments_: list[str] | None = None, now: int | None = None, session_time: int | None = None, path: str = "auto", params: dict | None = None) -> tuple[DataFrame, str]:
        """(id, value) of what a script returns for each customer; nil is left out."""
        b = self.table(name)
        s = self.parsed(b, script, "usual", params)
        if any(n.kind == "tally" for n in walk(s.body)):
            raise AnalysisError("<< belongs to event queries", "tally_not_allowed")
        now = now or int(time.time() * 1000)
        if path == "auto":
            try:
                low = Grouped(s, self.frame(b, s, session_time, segments_, places=_says_row(s)), now=now).run()
                value = low.value(kind)
                return low.grouped().select("id", value.alias("value")).where("value IS NOT NULL"), "aggregates by customer"
            except Unsupported:
                pass
        frame = self.frame(b, s, session_time, segments_)
        if path != "interpreter":
            try:
                low = Lowering(s, frame, now=now).run()
                value: Column = F.lit(None)
                for given, v in reversed(low.returns):
                    value = F.when(given, v).otherwise(value)
                if not low.returns:
                    raise Unsupported("no return")
                one = low.frame.where("rn = 0").select("id", value.cast(kind).alias("value"))
                return one.where("value IS NOT NULL"), "expressions"
            except Unsupported as e:
                why = str(e)
        else:
            why = "asked for"
        out = self.interpret(b, s, frame, now=now, depth=0, session_ms=session_time or b.spec.setting("session_time"), compat=False, returned=kind)
        return out, f"interpreter: {why}"

    def apply(self, name: str, script: str, *, now: int | None = None) -> DataFrame:
        """Runs a script for what it assigns to customer properties; nil unsets one. Returns the new customers table."""
        b = self.table(name)
        s = self.parsed(b, script, "usual", None)
        known = {p.name: p for p in b.spec.customer_properties}
        targets = sorted({n.parts[0].value for n in walk(s.body) if n.kind == "assign" and n.parts[0].kind == "name"} & set(known))
        if not targets:
            raise AnalysisError("the script assigns no customer property", "no_assignment")
        now = now or int(time.time() * 1000)
        frame = self.frame(b, s, None)
        for p in known:
            if f"_customer_{p}" not in frame.columns and p in targets:
                frame = rows.attach(frame, b.customers.select("id", F.col(p).alias(f"_customer_{p}")))
        held = [c for c in frame.columns if c.startswith("_customer_")]
        data, session_ms = [c for c in frame.columns if c not in held], b.spec.setting("session_time")
        cast = {"int": int, "double": float, "bool": bool, "text": str}
        made_once: list[Interpreter] = []

        def plain(p: Property, v):
            if v is None:
                return None
            return sorted(cast[p.type](x) for x in v) if p.is_set else cast[p.type](v)

        def run(table: list[dict], own: dict) -> list[tuple]:
            if not made_once:
                made_once.append(Interpreter(s, columns=set(data), customer_columns=set(known), now=now, session_ms=session_ms))
            # a set that is nil is one to add to
            before = {k: set(v or ()) if known[k].is_set else v for k, v in ((k.removeprefix("_customer_"), v) for k, v in own.items())}
            got = made_once[0].run(table, before).props
            return [(table[0]["id"], *[x for t in targets for x in (t in got, plain(known[t], got.get(t)))])] if got else []

        fields = [f for t in targets for f in (T.StructField(f"_set_{t}", T.BooleanType()), T.StructField(f"_new_{t}", known[t].spark_type))]
        news = self.by_group(frame, ["id"], data, held, run, T.StructType([frame.schema["id"], *fields]))
        joined = b.customers.join(news, "id", "full_outer")
        b.customers = joined.select("id", *[(F.when(F.coalesce(f"_set_{p}", F.lit(False)), F.col(f"_new_{p}")).otherwise(F.col(p)) if p in targets else F.col(p)).alias(p) for p in known if p in b.customers.columns])
        return b.customers

    # segments

    def segment(self, name: str, text: str, *, now: int | None = None) -> DataFrame:
        """(segment, customers) of the @segment sections in text; memberships are stored."""
        now = now or int(time.time() * 1000)
        specs = segments.in_order([_segment_spec(h, body) for k, h, body in sections(text) if k == "segment"])
        if not specs:
            raise ParseError("no @segment section", "syntax_error")
        ready = self.evaluated(name, [s for s in specs if not self.cached(name, s, now)], now)
        for s in specs:
            self.refresh_segment(name, s, now, ready.get(s.name))
        table = self.members(name).where(F.col("segment").isin(*[s.name for s in specs]))
        asked = self.spark.createDataFrame([(s.name,) for s in specs], "segment string")
        return asked.join(segments.counts(table), "segment", "left").select("segment", F.coalesce("customers", F.lit(0)).alias("customers"))

    def cached(self, name: str, s: segments.SegmentSpec, now: int) -> bool:
        old = self.segments[name].get(s.name)
        return bool(old and s.use_cached and not old[0].due(now))

    def evaluated(self, name: str, specs: list[segments.SegmentSpec], now: int) -> dict[str, DataFrame]:
        """(segment, id) of all segments whose scripts are aggregates of a customer, from one pass over the events."""
        b, made, frame, value = self.table(name), {}, None, {}
        scripts = [self.parsed(b, s.script, "usual", None) for s in specs if not _CALL.fullmatch(s.script)]
        if len(scripts) > 1:
            whole = Script((), [n for s in scripts for n in s.body])
            frame = self.frame(b, whole, None, places=_says_row(whole))
        for k, s in enumerate(specs if frame is not None else []):
            if not _CALL.fullmatch(s.script):
                try:
                    low = Grouped(self.parsed(b, s.script, "usual", None), frame, now=now, prefix=f"_a{k}_").run()
                    value[s.name] = F.coalesce(low.value(T.BooleanType()), F.lit(False))
                    made |= low.aggregates
                except Unsupported:
                    continue
        if not made:
            return {}
        one = frame.groupBy("id").agg(*[c.alias(n) for n, c in made.items()])
        held = F.filter(F.array(*[F.when(v, F.lit(n)) for n, v in value.items()]), lambda x: x.isNotNull())
        table = written(one.select(F.explode(held).alias("segment"), "id"), "segments")
        return {n: table.where(F.col("segment") == n) for n in value}

    def refresh_segment(self, name: str, s: segments.SegmentSpec, now: int, ready: DataFrame | None = None) -> DataFrame:
        """Evaluates one segment, unless a cached one is not due; returns its changes (segment, id, state). Members
        are written, so what is stored are rows, not a plan to find them. ready: members evaluated before."""
        stored = self.segments[name]
        old = stored.get(s.name)
        if self.cached(name, s, now):
            return self.members(name).limit(0).withColumn("state", F.lit(""))
        call = _CALL.fullmatch(s.script)
        if ready is not None:
            now_in = ready
        elif call:
            args = [a.strip().strip("'\"") for a in call[2].split(",")]
            missing = [a for a in args if a not in stored]
            if missing:
                raise QueryError(f"no segment {missing[0]}", "segment_missing")
            table = self.members(name)
            made = {"population": segments.population, "intersection": segments.intersection, "union": segments.union, "difference": segments.difference}
            ids = segments.complement(self.tables[name].events, table, args[0]) if call[1].startswith("compl") else made[call[1]](table, *args)
            now_in = written(ids.select(F.lit(s.name).alias("segment"), "id"), "segment")
        else:
            value, _ = self.per_customer(name, s.script, T.BooleanType(), now=now)
            now_in = written(segments.members(value, s.name, F.col("value")), "segment")
        before = old[1] if old else now_in.limit(0)
        s.refreshed_at = now
        stored[s.name] = (s, now_in)
        return segments.changes(before, now_in)

    def refresh_due(self, name: str, *, now: int | None = None) -> DataFrame | None:
        """Re-evaluates every segment that is due; the changes of all."""
        now = now or int(time.time() * 1000)
        out = None
        for s in segments.in_order([s for s, _ in self.segments[name].values()]):
            if s.due(now):
                part = self.refresh_segment(name, s, now)
                out = part if out is None else out.unionByName(part)
        return out

    # other queries

    def histogram(self, name: str, script: str, *, bucket: float | None = None, min: float | None = None, max: float | None = None, foreach: str | None = None, segments: list[str] | None = None, now: int | None = None) -> DataFrame:  # noqa: A002
        """(bucket, customers) of what the script returns, in the order of buckets; foreach evaluates it per value of
        a property."""
        if foreach is None:
            value, _ = self.per_customer(name, script, T.DoubleType(), segments_=segments, now=now)
            return hist.histogram(value, bucket=bucket, low=min, high=max).orderBy("bucket")
        b = self.table(name)
        s = self.parsed(b, script, "usual", None)
        now = now or int(time.time() * 1000)
        if per_value(s, foreach):
            try:
                frame = self.frame(b, s, None, segments, {foreach}, places=False).where(F.col(foreach).isNotNull()).withColumn("each_value", F.col(foreach))
                low = Grouped(s, frame, now=now, keys=("id", "each_value")).run()
                value = low.value(T.DoubleType())
                return hist.histogram(low.grouped().select("id", "each_value", value.alias("value")), bucket=bucket, low=min, high=max, by=["each_value"]).orderBy("each_value", "bucket")
            except Unsupported:
                pass
        frame = self.frame(b, s, None, segments, {foreach})
        values = written(b.events.where(F.col(foreach).isNotNull()).select(F.col(foreach).alias("each_value")).distinct(), "values")
        parts = -(-values.count() // (FOREACH_VALUES // 2)) or 1
        outs = None
        for k in range(parts):
            # a bounded list travels to the tasks: customers are never joined with values
            listed = [r[0] for r in values.where(F.pmod(F.xxhash64("each_value"), F.lit(parts)) == k).collect()]
            part = self.interpret_values(b, s, frame, listed, values.schema["each_value"].dataType, now)
            outs = part if outs is None else outs.unionByName(part)
        return hist.histogram(outs, bucket=bucket, low=min, high=max, by=["each_value"]).orderBy("each_value", "bucket")

    def interpret_values(self, b: Bound, script: Script, frame: DataFrame, values: list, kind: T.DataType, now: int) -> DataFrame:
        """The script on each customer once per value: rows are not copied, and few values travel to the tasks."""
        data = [c for c in frame.columns if not c.startswith("_customer_")]
        session_ms = b.spec.setting("session_time")
        made_once: list[Interpreter] = []

        def run(table: list[dict], _: dict) -> list[tuple]:
            if not made_once:
                made_once.append(Interpreter(script, columns=set(data), now=now, session_ms=session_ms))
            got = ((v, made_once[0].run(table, {}, v).returned) for v in values)
            return [(table[0]["id"], v, float(x)) for v, x in got if x is not None]

        schema = T.StructType([frame.schema["id"], T.StructField("each_value", kind), T.StructField("value", T.DoubleType())])
        return self.by_group(frame, ["id"], data, [], run, schema)

    def property(self, name: str, prop: str, *, bucket: float | None = None, segments: list[str] | None = None, **filters) -> DataFrame:
        """(value, customers), the most common first; the null value counts all who have the property."""
        b = self.table(name)
        p = b.spec.get(prop)
        side = b.customers if p and p.is_customer else b.events
        if prop not in side.columns:
            raise QueryError(f"no property {prop}", "property_missing")
        from cohortlake.operators import segments as algebra

        members = None if not segments or "*" in segments else algebra.union(self.members(name), *segments)
        return hist.property_values(side, prop, bucket=bucket, members=members, is_set=bool(p and p.is_set), **filters).orderBy(F.desc("customers"), F.asc_nulls_first("value"))

    def customer(self, name: str, customer_id) -> DataFrame:
        """(id, json) of one customer; the filter reaches the scan."""
        b = self.table(name)
        own = [p.name for p in b.spec.event_properties if p.name in b.events.columns]
        held = [p.name for p in b.spec.customer_properties if p.name in b.customers.columns]
        return render.customer_json(b.events.where(F.col("id") == customer_id), b.customers.where(F.col("id") == customer_id) if held else None, own, held)

    def batch(self, name: str, text: str, *, now: int | None = None) -> list[dict]:
        """Sections in one text: @segment first, then @use (segments for what follows), @property, @histogram, @event."""
        found = sections(text)
        if any(k == "segment" for k, _, _ in found):
            self.segment(name, "\n".join(f"@segment {h}\n{body}" for k, h, body in found if k == "segment"), now=now)
        use, out = ["*"], []
        for kind, head, body in found:
            words, opts = _head(head)
            if kind == "use":
                use = [w.strip() for w in head.replace(",", " ").split()]
            elif kind == "property":
                out.append({"property": words[0], "frame": self.property(name, words[0], segments=use, **{k: float(v) if k in ("bucket", "gt", "gte", "lt", "lte") else v for k, v in opts.items()})})
            elif kind == "histogram":
                out.append({"histogram": words[0], "frame": self.histogram(name, body, segments=use, now=now, **{k: v if k == "foreach" else float(v) for k, v in opts.items()})})
            elif kind == "event":
                out.append({"event": words[0] if words else "", "result": self.event(name, body, segments=use, now=now)})
            elif kind != "segment":
                raise ParseError(f"unknown section @{kind}", "syntax_error")
        return out


_CALL = re.compile(r"\s*(?:return\s*)?\(?\s*(population|intersection|union|compliment|complement|difference)\s*\(([^)]*)\)\s*\)?\s*")


def _says_row(s: Script) -> bool:
    """Whether a script without each_row asks for places of rows."""
    return any(n.kind == "inline" and n.value == "row" or n.kind in ("name", "call") and n.value in ("cursor", "get_row") for n in walk(s.body))


def sections(text: str) -> list[tuple[str, str, str]]:
    """(kind, head, body) of the sections that begin with @kind."""
    parts = re.split(r"^[ \t]*@(\w+)[ \t]*([^\n]*)$", text, flags=re.M)
    return [(parts[k], parts[k + 1].strip(), parts[k + 2].strip("\n")) for k in range(1, len(parts), 3)]


def _head(head: str) -> tuple[list[str], dict[str, str]]:
    words = head.split()
    return [w for w in words if "=" not in w], dict(w.split("=", 1) for w in words if "=" in w)


def _duration(v: str) -> int:
    """Bare numbers and 30s are seconds; 5_minutes is exact."""
    if m := re.fullmatch(r"(\d+)s?", v):
        return int(m[1]) * 1000
    if m := re.fullmatch(r"(\d+)_([a-z]+)", v):
        from cohortlake.functions.scalars import SPANS_MS

        return int(m[1]) * SPANS_MS[m[2]]
    raise ConfigError(f"bad duration {v!r}", "duration")


def _segment_spec(head: str, body: str) -> segments.SegmentSpec:
    words, opts = _head(head)
    if not words:
        raise ParseError("@segment needs a name", "syntax_error")
    flags = {*words[1:], *[k for k, v in opts.items() if v.lower() == "true"]}
    return segments.SegmentSpec(words[0], body, _duration(opts["refresh"]) if "refresh" in opts else 300_000, _duration(opts["ttl"]) if "ttl" in opts else 0, "use_cached" in flags, "on_insert" in flags, int(opts.get("z_index", 100)))
