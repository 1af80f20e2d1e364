"""Segments kept up to date as events arrive: a keyed state per customer emits entering and leaving.

State holds the customer's retained rows and memberships. Late events may change the past, so a customer's
segments are evaluated anew over all retained rows; event_max and event_ttl bound both state and work.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortlake.operators.segments import SegmentSpec, in_order
from cohortlake.plans.interpreter import Interpreter
from cohortlake.plans.syntax import parse
from cohortlake.spec import TableSpec

MESSAGES = T.StructType([T.StructField("segment", T.StringType()), T.StructField("id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("stamp", T.LongType())])
_STATE = T.StructType([T.StructField("rows", T.StringType()), T.StructField("members", T.StringType()), T.StructField("props", T.StringType())])


def merge(rows: list[dict], new: list[dict], spec: TableSpec, now: int) -> list[dict]:
    """Rows in order, equal ones once (the later arrival), the newest event_max of the last event_ttl."""
    ranks = {e: k for k, e in enumerate(spec.event_order)}
    own = lambda r: json.dumps([r[k] for k in sorted(r) if k != "seq"])
    once: dict[str, dict] = {}
    for r in [*rows, *new]:
        if own(r) not in once or once[own(r)]["seq"] <= r["seq"]:
            once[own(r)] = r
    kept = [r for r in once.values() if r["stamp"] > now - spec.setting("event_ttl")]
    kept.sort(key=lambda r: (r["stamp"], ranks.get(r["event"], 99), r["seq"]))
    return kept[-spec.setting("event_max") :]


def ready(specs: list[SegmentSpec], spec: TableSpec) -> list[tuple[str, Interpreter]]:
    """The segments in their order, parsed once for all customers and batches."""
    names, own, held = ({p.name for p in x} for x in (spec.properties, spec.event_properties, spec.customer_properties))
    return [(s.name, Interpreter(parse(s.script, names), columns=own, customer_columns=held, session_ms=spec.setting("session_time"))) for s in in_order(specs)]


def evaluate(made: list[tuple[str, Interpreter]], rows: list[dict], props: dict, now: int) -> list[str]:
    out = []
    for name, script in made:
        script.now = now
        if script.run([dict(r) for r in rows], props).returned:
            out.append(name)
    return out


def live_segments(events: DataFrame, spec: TableSpec, specs: list[SegmentSpec], *, now: int | None = None, timers: bool = False) -> DataFrame:
    """A stream of (segment, id, state, stamp): 'enter' and 'exit' as events (id, stamp, event, seq,
    properties) arrive; customer properties among their columns hold until a later event brings another value.
    stamp is when the change was seen: now, or the newest event of the batch. timers: customers without new
    events are evaluated again when the soonest refresh of the segments is due, at the clock's time."""
    columns = set(events.columns)
    data = ["stamp", "event", "seq", *[p.name for p in spec.event_properties]]
    held = [p.name for p in spec.customer_properties if p.name in columns]
    active = [s for s in specs if s.on_insert]
    wait = max(1_000, min((s.refresh for s in active), default=60_000))
    made: list[list[tuple[str, Interpreter]]] = []

    def plain(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        return v.tolist() if hasattr(v, "tolist") else v

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(ready(active, spec))
        rows, members, props = (json.loads(x) for x in state.get) if state.exists else ([], [], {})
        due = timers and state.hasTimedOut
        new = [] if due else [{k: plain(v) for k, v in r.items()} for pdf in batches for r in pdf[[*data, *held]].to_dict("records")]
        for r in sorted(new, key=lambda r: (r["stamp"], r["seq"])):
            for p in held:
                if (v := r.pop(p)) is not None and [r["stamp"], r["seq"]] >= props.get(p, [0, [-1, -1]])[1]:
                    props[p] = [v, [r["stamp"], r["seq"]]]
        at = now if now is not None else state.getCurrentProcessingTimeMs() if due else max([r["stamp"] for r in new], default=0)
        rows = merge(rows, new, spec, at)
        own = {p.name: props[p.name][0] if p.name in props else None for p in spec.customer_properties}
        found = evaluate(made[0], [{"id": key[0], **r} for r in rows], own, at)
        state.update((json.dumps(rows), json.dumps(found), json.dumps(props)))
        if timers:
            state.setTimeoutDuration(wait)
        moves = [(s, str(key[0]), "enter", at) for s in found if s not in members] + [(s, str(key[0]), "exit", at) for s in members if s not in found]
        yield pd.DataFrame(moves, columns=MESSAGES.names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return events.groupBy("id").applyInPandasWithState(run, MESSAGES, _STATE, "append", timeout)
