"""Tables, ingestion, segments, histograms, rendering, batches and streams on small tables."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.engine import Engine
from cohortlake.errors import AnalysisError, ConfigError, QueryError
from cohortlake.operators.segments import SegmentSpec
from cohortlake.operators.tally import Aggregator, tally
from cohortlake.sources import events as source
from cohortlake.spec import Catalog, Property, TableSpec
from cohortlake.streaming import ingest as streaming
from cohortlake.streaming import messages
from cohortlake.streaming.segments import live_segments

SPEC = TableSpec("visits", "textual", (Property("page", "text"), Property("words", "text", is_set=True), Property("price", "double"), Property("tags", "text", is_set=True, is_customer=True), Property("total", "double", is_customer=True)), ("purchase", "cart"))
# The stamps and counts are the goldens listed in FIXTURES.md, A5.
EVENTS = [
    {"id": "User1", "stamp": 1458820830, "event": "view", "page": "home", "words": "a"},
    {"id": "user1", "stamp": 1458820840, "event": "view", "page": "home", "words": ["a", "b", None], "price": "12"},
    {"id": "user1", "stamp": "2016-03-24T12:00:41Z", "event": "cart", "page": "shop", "price": 3.5},
    {"id": "user1", "stamp": 1458820841, "event": "purchase", "page": "shop", "price": 7, "tags": ["x"], "total": 1},
    {"id": "user1", "stamp": 1458820841, "event": "purchase", "page": "shop", "price": 7, "total": 2, "unknown": 1},
    {"id": "user2", "stamp": 1458820900, "event": "view", "page": "home"},
    {"id": None, "stamp": 1, "event": "view", "page": "x"},
    {"id": "u3", "stamp": 5, "page": "x"},
    {"id": "u3", "stamp": 5, "event": "empty"},
    {"id": "u3", "stamp": -5, "event": "view", "page": "x"},
]


def raw(spark, spec=SPEC, events=EVENTS):
    lines = spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(events)], "n long, value string")
    return lines.select(F.from_json("value", source.json_schema(spec)).alias("e")).select("e.*")


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.create_table(SPEC)
    e.insert("visits", raw(spark))
    return e


def test_ingest(engine):
    rows = engine.tables["visits"].events.orderBy("id", "stamp", "z", "seq").collect()
    assert [(r["id"], r["event"], r["stamp"]) for r in rows] == [("user1", "view", 1458820830000), ("user1", "view", 1458820840000), ("user1", "purchase", 1458820841000), ("user1", "cart", 1458820841000), ("user2", "view", 1458820900000)]
    assert rows[1]["words"] == ["a", "b"] and rows[0]["words"] == ["a"] and rows[1]["price"] is None
    customers = {r["id"]: r for r in engine.tables["visits"].customers.collect()}
    assert customers["user1"]["total"] == 2.0 and customers["user1"]["tags"] == ["x"] and customers["user2"]["total"] is None


def test_insert_again_changes_nothing_and_late_events_find_their_place(spark, engine):
    engine.insert("visits", raw(spark))
    assert engine.tables["visits"].events.count() == 5
    engine.insert("visits", raw(spark, events=[{"id": "user1", "stamp": 1458820835, "event": "view", "page": "late"}]))
    pages = [r["page"] for r in engine.tables["visits"].events.where("id = 'user1'").orderBy("stamp", "z", "seq").collect()]
    assert pages == ["home", "late", "home", "shop", "shop"]


def test_retention(spark):
    spec = TableSpec("r", "numeric", (Property("value", "double"),), settings={"event_max": 2, "event_ttl": 86_400_000})
    rows = [{"id": 1, "stamp": 1704067200 + 3600 * k, "event": "e", "value": k} for k in range(30)]
    events, _ = source.ingest(source.coerce(raw(spark, spec, rows), spec), spec, now=(1704067200 + 3600 * 30) * 1000)
    assert sorted(r["value"] for r in events.collect()) == [28.0, 29.0]


def test_catalog_and_specs():
    c = Catalog()
    c.create(SPEC)
    assert TableSpec.from_json("visits", SPEC.to_json()) == SPEC and c.list() == ["visits"]
    with pytest.raises(ConfigError):
        c.create(SPEC)
    for bad in (("a", "text"), ("9x", "text"), ("stamp", "int"), ("fine", "blob")):
        with pytest.raises(ConfigError):
            Property(*bad)
    assert SPEC.with_settings(event_max=0).setting("event_max") == 1


def test_properties_come_and_go(engine):
    engine.add_property("visits", Property("extra", "int"))
    assert engine.event("visits", "each_row where extra == nil\n << event\nend").frame.count() == 3
    engine.drop_property("visits", "extra")
    with pytest.raises(ConfigError):
        engine.drop_property("visits", "extra")


def test_set_iteration_counts_each_row_once_in_parents(engine):
    r = engine.event("visits", "select\n count id\n count session\n count page\nend\neach_row where page.is(!= nil)\n for w in words\n  << id, page, w\n end\nend")
    root = r.tree()["_"]
    assert [n["c"] for n in root] == [[1, 1, 2]] and root[0]["_"][0]["c"] == [1, 1, 2] and sorted(n["g"] for n in root[0]["_"][0]["_"]) == ["a", "b"]


def test_within_and_reverse(engine):
    script = "select\n count id\n count page\nend\n" + "".join(
        f"each_row.reverse().limit(1) where page == 'home'\n at = stamp\n each_row.continue().next().reverse().within({s}_seconds, at) where event != nil\n  << 't{s}', page\n end\nend\n" for s in (5, 100)
    )
    assert {n["g"]: n["c"] for n in engine.event("visits", script).tree()["_"]} == {"t100": [1, 1]}


def test_counts_golden(spark):
    rows = [(1, 0, 1458800000, 100, "rabbit", c) for c in ("orange", "purple")] + [(1, 0, 1458801000, 200, "goat", c) for c in ("green", "golden", "cyan")]
    frame = spark.createDataFrame([(i, k, s, v, t, c) for k, (i, _, s, v, t, c) in enumerate(rows)], "id long, rn int, stamp long, some_val long, some_thing string, some_color string")
    aggs = (Aggregator("count", "id"), Aggregator("count", "some_thing", "things"), Aggregator("count", "some_color", "colors"), Aggregator("sum", "some_val", "total"))
    pushes = frame.withColumns({"g1": F.col("some_thing"), "g2": F.col("some_color")})
    top = lambda **o: {r["g1"]: [r["id"], r["things"], r["colors"], r["total"]] for r in tally(pushes, ["g1", "g2"], aggs, **o).where("d = 1").collect()}
    assert top() == {"goat": [1, 3, 3, 600], "rabbit": [1, 2, 2, 200]}
    assert top(by_stamp=True) == {"goat": [1, 1, 3, 200], "rabbit": [1, 1, 2, 100]}


def test_segments_refresh_and_batch(engine):
    t = 1458830000000
    got = {r["segment"]: r["customers"] for r in engine.segment("visits", "@segment homers refresh=60s use_cached\nreturn(page.ever(== 'home'))\n@segment shoppers\nif page.ever(== 'shop')\n return(true)\nend\n@segment none z_index=300\ndifference(shoppers, homers)", now=t).collect()}
    assert got == {"homers": 2, "shoppers": 1, "none": 0}
    assert engine.segments["visits"]["homers"][0].refresh == 60_000
    assert not engine.segments["visits"]["homers"][0].due(t + 59_000) and engine.segments["visits"]["homers"][0].due(t + 60_000)
    assert engine.refresh_due("visits", now=t + 400_000).count() == 0
    out = engine.batch("visits", "@segment shoppers\nreturn(page.ever(== 'shop'))\n@use shoppers\n@property page\n@histogram spend bucket=5\nreturn(sum(price) where price > 0)\n@event\neach_row where page != nil\n << page\nend")
    assert {r["value"]: r["customers"] for r in out[0]["frame"].collect()} == {None: 1, "home": 1, "shop": 1}
    assert [(r["bucket"], r["customers"]) for r in out[1]["frame"].collect()] == [(10.0, 1)]
    with pytest.raises(QueryError):
        engine.segment("visits", "@segment x\nunion(homers, missing)")
    with pytest.raises(AnalysisError):
        engine.histogram("visits", "<< page")


def test_customer_json(engine):
    made = json.loads(engine.customer("visits", "user1").first()["json"])
    assert made["properties"] == {"tags": ["x"], "total": 2.0} and len(made["events"]) == 4
    assert made["events"][0]["stamp_iso"] == "2016-03-24T12:00:30.000Z" and made["events"][0]["_"] == {"page": "home", "words": ["a"]}


def test_customer_properties_persist(engine):
    engine.apply("visits", "tags = tags + 'hello'\ntags = tags - 'x'\ntotal = sum(price) where price > 0")
    rows = {r["id"]: r for r in engine.tables["visits"].customers.collect()}
    assert rows["user1"]["tags"] == ["hello"] and rows["user1"]["total"] == 10.5
    engine.apply("visits", "total = nil")
    assert {r["total"] for r in engine.tables["visits"].customers.collect()} == {None}
    assert engine.segment("visits", "@segment tagged\nif 'hello' in tags\n return(true)\nend").first()["customers"] == 2


def test_bucketed_table_needs_no_exchange(spark, engine):
    from cohortlake.operators.rows import number
    from cohortlake.sources import tables

    tables.save(engine.tables["visits"].events, "visits_stored", 4)
    plan = number(tables.load(spark, "visits_stored"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert tables.ever_prefilter(tables.load(spark, "visits_stored"), F.col("page") == "shop").count() == 4


def test_empty_table(spark):
    e = Engine(spark)
    e.create_table(SPEC)
    assert e.event("visits", "each_row where page != nil\n << page\nend").frame.count() == 0
    assert e.histogram("visits", "return(sum(price) where price > 0)", bucket=5).count() == 0


def test_repartition_invariance(spark, sf_dir):
    outs = []
    for n in (1, 8):
        e = Engine(spark)
        e.bind(source.FIXTURE, source.fixture_events(spark, sf_dir).repartition(n))
        r = e.event("events", "select\n min value as low\n max value as high\n value value as last\nend\neach_row where value > 1\n << event\nend")
        outs.append(sorted(map(tuple, r.frame.collect())))
    assert outs[0] == outs[1]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(0, len(EVENTS), 3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in EVENTS[k : k + 3]))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), SPEC, files_per_batch=1)
    q = streaming.into(stream, streaming.parquet_sink(str(tmp_path / "out")), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    events, customers = streaming.stored(spark, str(tmp_path / "out"), SPEC)
    assert events.count() == 5 and customers.count() == 2


def test_live_segments_enter_and_exit(spark, tmp_path):
    spec = TableSpec("live", "textual", (Property("price", "double"),))
    (tmp_path / "in").mkdir()
    specs = [SegmentSpec("rich", "if (sum(price) where price != nil) > 10\n return(true)\nend", on_insert=True), SegmentSpec("recent_cheap", "each_row.reverse().limit(1) where price != nil\n if price < 5\n  return(true)\n end\nend", on_insert=True)]
    stream = streaming.read_stream(spark, str(tmp_path / "in"), spec, files_per_batch=1).withColumn("seq", F.col("stamp"))
    q = live_segments(stream, spec, specs, now=1704153600000).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k, price in enumerate((4, 8, 1)):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": "a", "stamp": 1704067200 + k, "event": "buy", "price": price}))
        q.processAllAvailable()
    q.stop()
    assert sorted((r["segment"], r["state"]) for r in spark.table("moves").collect()) == [("recent_cheap", "enter"), ("recent_cheap", "enter"), ("recent_cheap", "exit"), ("rich", "enter")]


def test_broker_keeps_what_is_not_taken():
    got, up = [], [True]
    b = messages.Broker({"s"})
    b.subscribe(messages.Subscription("s", "one", lambda m: up[0] and (got.extend(m) or True)))
    with pytest.raises(ConfigError):
        b.subscribe(messages.Subscription("other", "x", lambda m: True))
    up[0] = False
    b.push([{"segment": "s", "id": 1, "stamp": 1000}, {"segment": "t", "id": 2, "stamp": 1000}], 1000)
    assert b.deliver(1000) == 0 and b.deliver(1100) == 0
    up[0] = True
    assert b.deliver(1300) == 1 and got[0]["id"] == 1
    b.push([{"segment": "s", "id": 3, "stamp": 0}], 1)
    b.push([], 4 * 3_600_000)
    assert b.deliver(4 * 3_600_000) == 0


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_customer_scripts_are_one_aggregation_with_partial_sums(spark, sf_dir):
    from cohortlake import queries

    spend = plan_of(queries.engine(spark, sf_dir).per_customer("events", "return(sum(value) where event.is(== 'purchase'))", T.DoubleType())[0])
    assert "partial_sum" in spend and "Window" not in spend
    e = queries.engine(spark, sf_dir)
    e.segment("events", queries.SEGMENTS, now=queries.NOW)
    # members are rows of a table, whatever made them
    members = plan_of(e.members("events"))
    assert "Window" not in members and "events.parquet" not in members and "Python" not in members
    assert "Python" not in plan_of(queries.QUERIES["jn_next_purchase_script"](spark, sf_dir)) and "MapInArrow" not in plan_of(queries.QUERIES["jn_next_purchase_script"](spark, sf_dir))
    each = plan_of(queries.QUERIES["hi_foreach_script"](spark, sf_dir))
    assert "NestedLoop" not in each and "Cartesian" not in each and "MapInArrow" not in each


SAME = ["return(sum(value) where event.is(== 'purchase') && kk.is(!= 3))", "n = count(event) where value > 50\nif event.ever(== 'error') && n > 3\n return(n)\nend\nreturn(0 - row_count)", "a = avg(value) where event == 'click'\nb = dcount(event) where value > 10\nreturn(a + b)", "return(last_stamp - first_stamp)", "if value.never(> 490)\n return(min(value) where event == 'view')\nend"]


@pytest.mark.parametrize("script", SAME)
def test_grouped_scripts_give_what_the_interpreter_gives(spark, sf_dir, script):
    from cohortlake import queries

    outs = []
    for path in ("auto", "interpreter"):
        frame, why = queries.engine(spark, sf_dir).per_customer("events", script, T.DoubleType(), now=queries.NOW, path=path)
        outs.append(sorted((r["id"], round(r["value"], 6)) for r in frame.collect()))
        assert why.startswith("aggregates") == (path == "auto")
    assert outs[0] == outs[1] and outs[0]


@pytest.mark.parametrize("script", ["return(count(event) where event.is(== each_value) && value > 50)", "return(count(event) where event.is(!= each_value))"])
def test_foreach_by_value_and_by_customer(spark, sf_dir, monkeypatch, script):
    from cohortlake import engine as module
    from cohortlake import queries

    rows = source.fixture_events(spark, sf_dir).collect()
    want = {}
    for v in {r["event"] for r in rows}:
        per = {}
        for r in rows:
            if (r["event"] == v and r["value"] > 50) if "value > 50" in script else r["event"] != v:
                per[r["id"]] = per.get(r["id"], 0) + 1
        for n in per.values():
            want[v, float(n)] = want.get((v, float(n)), 0) + 1
    monkeypatch.setattr(module, "FOREACH_VALUES", 4)
    got = queries.engine(spark, sf_dir).histogram("events", script, foreach="event", now=queries.NOW)
    assert {(r["each_value"], r["bucket"]): r["customers"] for r in got.collect()} == want


def test_plans_do_not_grow_with_inserts(spark, engine):
    sizes = []
    for k in range(4):
        engine.insert("visits", raw(spark, events=[{"id": "user2", "stamp": 1458821000 + k, "event": "view", "page": f"p{k}"}]))
        sizes.append(len(plan_of(engine.tables["visits"].events).splitlines()))
    assert len(set(sizes)) == 1 and engine.tables["visits"].events.count() == 9
    assert len({r["seq"] for r in engine.tables["visits"].events.collect()}) == 9


def test_cached_segments_are_rows(spark, engine):
    t = 1458830000000
    engine.segment("visits", "@segment homers refresh=60s use_cached\nreturn(page.ever(== 'home'))", now=t)
    engine.insert("visits", raw(spark, events=[{"id": "user9", "stamp": 1458821000, "event": "view", "page": "home"}]))
    count = lambda now: engine.segment("visits", "@segment homers refresh=60s use_cached\nreturn(page.ever(== 'home'))", now=now).first()["customers"]
    assert count(t + 1000) == 2 and count(t + 61_000) == 3


NESTED = [
    "select\n count id\n count event as n\nend\neach_row where event == 'view'\n seen = kk\n each_row.continue().next().limit(2) where event == 'click' && kk != seen\n  << 'then', event\n end\nend",
    "select\n sum value as v\nend\neach_row.limit(3) where event == 'purchase'\n at = stamp\n each_row.within(2_days, at) where value > 100\n  << event, bucket(kk, 10)\n end\nend",
    "each_row where event == 'error'\n each_row.continue() where event.is(in ['click', 'error'])\n  if value > 200\n   << 'high', event\n  else\n   << 'low'\n  end\n end\nend",
]


@pytest.mark.parametrize("script", NESTED)
def test_nested_iteration_lowered_gives_what_the_interpreter_gives(spark, sf_dir, script):
    from cohortlake import queries

    outs = []
    for path in ("expressions", "interpreter"):
        r = queries.engine(spark, sf_dir).event("events", script, now=queries.NOW, path=path)
        outs.append(sorted(tuple(str(x) if c in r.groups else round(x, 4) if isinstance(x, float) else x for c, x in zip(r.frame.columns, row, strict=True)) for row in r.frame.collect()))
    assert [tuple(map(str, x)) for x in outs[0]] == [tuple(map(str, x)) for x in outs[1]] and outs[0]


def test_logged_messages_outlive_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"u{k}", "enter", 10_000_000_000_000 + k) for k in range(1200)] + [("other", "x", "enter", 10_000_000_000_000)], "segment string, id string, state string, stamp long").coalesce(1)
    log = messages.MessageLog(spark, f"file://{tmp_path}/log")
    got, up = [], [True]
    send = lambda part: up[0] and (got.extend(part) or len(got) <= 500 or up.__setitem__(0, False) or True)
    first = messages.Broker({"s"}, log)
    first.subscribe(messages.Subscription("s", "hook", send))
    # two batches are taken, then the receiver is gone, and so is the driver
    first.batch_sink()(rows, 0)
    assert len(got) == 1000
    up[0], later = True, []
    second = messages.Broker({"s"}, log)
    second.subscribe(messages.Subscription("s", "hook", lambda part: later.extend(part) or True))
    second.batch_sink()(rows.limit(0), 1)
    assert sorted(m["id"] for m in got + later) == sorted(f"u{k}" for k in range(1200)) and "seq" not in later[0]
    assert second.deliver(10_000_000_000_000) == 0


def test_live_segments_know_customer_properties_and_the_clock(spark, tmp_path):
    spec = TableSpec("timed", "textual", (Property("price", "double"), Property("plan", "text", is_customer=True)))
    (tmp_path / "in").mkdir()
    specs = [SegmentSpec("gold", "if plan == 'gold'\n return(true)\nend", on_insert=True, refresh=1_000), SegmentSpec("fresh", "return(price.within(4_seconds, now).ever(> 0))", on_insert=True, refresh=1_000)]
    stream = streaming.read_stream(spark, str(tmp_path / "in"), spec).withColumn("seq", F.col("stamp"))
    q = live_segments(stream, spec, specs, timers=True).writeStream.format("memory").queryName("clocked").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "cp")).start()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"id": "a", "stamp": int(time.time()) + k, "event": "buy", "price": 5, "plan": p}) for k, p in enumerate(("gold", None))))
    seen, until = set(), time.time() + 60
    while time.time() < until and ("fresh", "exit") not in seen:
        time.sleep(1)
        seen = {(r["segment"], r["state"]) for r in spark.table("clocked").collect()}
    q.stop()
    assert seen == {("gold", "enter"), ("fresh", "enter"), ("fresh", "exit")}


def test_neighbouring_baskets_are_dealt_out_by_customer_only(spark, sf_dir):
    from cohortlake import queries

    plan = plan_of(queries.QUERIES["jn_next_purchase_script"](spark, sf_dir)).splitlines()
    sent = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan if "Exchange hashpartitioning(" in x]
    by_customer = [x for x in sent if x.startswith("id#") and x.count("#") == 1]
    # nothing is sent for pairs of items, whose number is that of all further rows, but their counts by group
    assert len(by_customer) == 3 and [x for x in sent if x.startswith("d#")] == [x for x in sent if x.count("#") > 1]


MEETING = [
    "select\n count id\n count event\n sum value\nend\neach_row where event == 'a'\n mine = kk\n each_row where kk.is(== mine) && event.is(!= 'a') && value != nil\n  << event, kk\n end\nend",
    "select\n count id\n count event\n sum value\nend\neach_row where event == 'a'\n mine = kk\n was = value\n each_row where kk == mine && value.is(!= was)\n  << was, event, value\n end\nend",
    "select\n count id\n count event\n sum value\nend\neach_row where event == 'a'\n was = value\n each_row.continue().next().limit(1) where event == 'b'\n  got = kk\n  each_row where kk.is(== got) && value.is(!= was)\n   << event, was\n  end\n end\nend",
    "select\n count id\n count session\n sum value key kk\n max value as most all\nend\neach_row where event == 'a'\n mine = kk\n each_row where kk.is(== mine)\n  << event, value\n  << 'all', kk\n end\nend",
]


@pytest.mark.parametrize("script", MEETING)
def test_rows_that_meet_by_a_property_with_nil_and_ties(spark, script):
    made = [(k % 5 // 2, 1000 * (k % 7), "abc"[k * 7 % 11 % 3], None if k % 4 == 0 else k % 2, None if k % 5 == 0 else float(k % 6), 99, k) for k in range(90)]
    rows = spark.createDataFrame(made, "id long, stamp long, event string, kk long, value double, z int, seq long")
    e = Engine(spark)
    e.bind(TableSpec("events", "numeric", (Property("value", "double"), Property("kk", "int"))), rows)
    outs = [e.event("events", script, now=0, path=p) for p in ("expressions", "interpreter")]
    got = [sorted(repr([None if v is None else float(v) if isinstance(v, float) or str(v).replace(".", "", 1).isdigit() else v for v in r]) for r in o.frame.collect()) for o in outs]
    assert got[0] == got[1] and len(got[0]) > 3
