"""The registered queries of the event engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.engine import Engine
from cohortlake.functions import scalars
from cohortlake.operators import histogram, inline, render, rows, segments, sequence
from cohortlake.plans.session import prepare
from cohortlake.sources import events as source
from cohortlake.spec import Property, TableSpec
from cohortlake.streaming import ingest as streaming

#: Queries that ask for now take the end of the fixture month.
NOW = 1_706_745_600_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.bind(source.FIXTURE, source.fixture_events(spark, sf_dir))
    return e


def baskets(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    e.bind(source.BASKETS, source.fixture_baskets(spark, sf_dir), source.fixture_customers(spark, sf_dir))
    return e


def scripted(name: str, script: str, sql: str, *, columns: dict[str, str] | None = None, on=engine, table: str = "events", round_to: dict[str, int] | None = None, **options) -> None:
    """Registers an event script; columns casts group columns, round_to rounds sums of doubles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = on(spark, sf_dir).event(table, script, now=NOW, **options).frame
        for c, k in (columns or {}).items():
            out = out.withColumn(c, F.col(c).cast(k))
        for c, k in (round_to or {}).items():
            out = out.withColumn(c, F.round(c, k))
        return out.withColumn("d", F.col("d").cast("long"))

    query(name, sql)(run)


EV = "SELECT user_id AS id, epoch_us(ts) // 1000 AS stamp, ts, event_type AS event, value, CAST(json_extract(props, '$.k') AS BIGINT) AS kk, event_id AS seq FROM events"
ROWS = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp, seq) - 1 AS rn FROM ({EV})"
DOW = "dayofweek(ts) + 1"


def two_levels(source_sql: str, k1: str, k2: str, aggs: str) -> str:
    return f"""WITH f AS ({source_sql})
SELECT CAST(1 AS BIGINT) AS d, {k1} AS g1, NULL AS g2, {aggs} FROM f GROUP BY {k1}
UNION ALL SELECT 2, {k1}, {k2}, {aggs} FROM f GROUP BY {k1}, {k2}"""


scripted(
    "ag_weekday_event",
    """
select
  count id
  count event as n
  sum value as total
end
each_row where event.is(in ['purchase', 'click'])
  << get_day_of_week(stamp), event
end
""",
    two_levels(f"SELECT * FROM ({EV}) WHERE event IN ('purchase', 'click')", DOW, "event", "count(DISTINCT id) AS id, count(*) AS n, round(sum(value), 2) AS total"),
    round_to={"total": 2},
)
scripted(
    "ag_min_max_avg_value",
    """
select
  min value as low
  max value as high
  avg value as mean
  value value as last_value
  dist_count_person kk as people_k
  count session as sessions
end
each_row where value > 20
  << event
end
""",
    f"""WITH s AS (SELECT *, sum(CASE WHEN stamp - prev > 1800000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY stamp, seq) AS session
  FROM (SELECT *, lag(stamp) OVER (PARTITION BY id ORDER BY stamp, seq) AS prev FROM ({ROWS})))
SELECT CAST(1 AS BIGINT) AS d, event AS g1, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean,
  arg_max(value, stamp * 100000 + rn) AS last_value, count(DISTINCT (id, kk)) AS people_k, count(DISTINCT (id, session)) AS sessions
FROM s WHERE value > 20 GROUP BY event""",
    round_to={"mean": 6},
)
scripted(
    "ag_key_and_all",
    """
select
  count id as person_days key kk
  sum value as every all
end
each_row where event == 'view' || event == 'click'
  << event
end
""",
    f"SELECT CAST(1 AS BIGINT) AS d, event AS g1, count(DISTINCT (id, kk)) AS person_days, round(sum(value), 2) AS every FROM ({EV}) WHERE event IN ('view', 'click') GROUP BY event",
    round_to={"every": 2},
)
scripted(
    "ag_stamp_counts",
    """
select
  count event as n
  sum kk as total
end
each_row where kk != nil
  << event, kk
end
""",
    two_levels(f"SELECT * FROM ({EV}) WHERE kk IS NOT NULL", "event", "kk", "count(DISTINCT (id, stamp, event)) AS n, CAST(sum(kk) FILTER (once) AS BIGINT) AS total").replace("WITH f AS (", "WITH f0 AS (").replace(")\nSELECT", f"), f AS (SELECT *, row_number() OVER (PARTITION BY id, stamp, event, kk) = 1 AS once FROM f0)\nSELECT", 1),
    stamp_counts=True,
)
scripted(
    "ag_nil_key_cuts_path",
    """
select
  count id
  count event as n
end
each_row where event.is(!= 'error')
  if kk > 20
    << event, kk
  else
    << event, nil
  end
end
""",
    f"""WITH f AS (SELECT * FROM ({EV}) WHERE event <> 'error')
SELECT CAST(1 AS BIGINT) AS d, event AS g1, NULL AS g2, count(DISTINCT id) AS id, count(*) AS n FROM f GROUP BY event
UNION ALL SELECT 2, event, kk, count(DISTINCT id), count(*) FROM f WHERE kk > 20 GROUP BY event, kk""",
)
scripted(
    "pr_ever_never",
    """
select
  count id
  count event as n
end
each_row where event.is(== 'purchase') && event.ever(== 'error') && value.never(> 400)
  << event, get_hour(stamp)
end
""",
    two_levels(f"SELECT * FROM (SELECT *, bool_or(event = 'error') OVER (PARTITION BY id) AS e, bool_or(value > 400) OVER (PARTITION BY id) AS v FROM ({EV})) WHERE event = 'purchase' AND e AND NOT v", "event", "hour(ts)", "count(DISTINCT id) AS id, count(*) AS n"),
)
scripted(
    "pr_dates",
    """
select
  count id
  count event as n
end
each_row.range("2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z") where event.is_not(== 'view') && event.within(3_days, 1705000000000).ever(== 'signup') && value >= 10
  << date_day(stamp), event
end
""",
    two_levels(f"SELECT * FROM (SELECT *, bool_or(event = 'signup' AND stamp BETWEEN 1705000000000 - 259200000 AND 1705000000000 + 259200000 AND stamp BETWEEN 1704412800000 AND 1705708800000) OVER (PARTITION BY id) AS e FROM ({EV})) WHERE stamp BETWEEN 1704412800000 AND 1705708800000 AND event <> 'view' AND e AND value >= 10", "epoch_ms(date_trunc('day', ts))", "event", "count(DISTINCT id) AS id, count(*) AS n"),
)
scripted(
    "wi_limit_reverse",
    """
select
  count id
  sum value as total
  count event as n
end
each_row.reverse().limit(3) where event == 'click'
  << 'last', event
end
each_row.limit(2) where event.is(== 'purchase')
  << 'first', event
end
""",
    f"""WITH a AS (SELECT 'last' AS k, * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn DESC) AS p FROM ({ROWS}) WHERE event = 'click') WHERE p <= 3
  UNION ALL SELECT 'first', * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS p FROM ({ROWS}) WHERE event = 'purchase') WHERE p <= 2)
SELECT CAST(1 AS BIGINT) AS d, k AS g1, NULL AS g2, count(DISTINCT id) AS id, round(sum(value), 2) AS total, count(*) AS n FROM a GROUP BY k
UNION ALL SELECT 2, k, event, count(DISTINCT id), round(sum(value), 2), count(*) FROM a GROUP BY k, event""",
    round_to={"total": 2},
)
scripted(
    "wi_sessions",
    """
select
  count id
  count session
  count event as n
end
each_row where session > 0
  << bucket(row_count, 25), session
end
""",
    two_levels(f"SELECT *, sum(CASE WHEN stamp - prev > 86400000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY stamp, seq) AS session, (count(*) OVER (PARTITION BY id)) // 25 * 25 AS b FROM (SELECT *, lag(stamp) OVER (PARTITION BY id ORDER BY stamp, seq) AS prev FROM ({ROWS}))", "b", "CAST(session AS BIGINT)", "count(DISTINCT id) AS id, count(DISTINCT (id, session)) AS session, count(*) AS n"),
    session_time=86_400_000,
)
scripted(
    "ag_inline",
    """
select
  count id
end
spent = sum(value) where event.is(== 'purchase')
views = count(event) where event.is(== 'view')
kinds = dcount(event).range("2024-01-01", "2024-01-15") where value > 50
mean = avg(value) where event.is(== 'nothing')
first_buy = row where event.is(== 'purchase')
each_row.limit(1) where event != nil
  << bucket(spent, 1000), views, kinds, mean, first_buy, test where event.is(== 'error')
end
""",
    f"""WITH c AS (SELECT id, sum(value) FILTER (event = 'purchase') AS spent, nullif(count(*) FILTER (event = 'view'), 0) AS views,
  nullif(count(DISTINCT event) FILTER (value > 50 AND stamp BETWEEN 1704067200000 AND 1705276800000), 0) AS kinds, 0.0 AS mean, min(rn) FILTER (event = 'purchase') AS fb, bool_or(event = 'error') AS t FROM ({ROWS}) GROUP BY id),
k AS (SELECT id, CAST(CAST(trunc(spent * 100) AS BIGINT) // 100000 * 1000 AS BIGINT) AS g1, views AS g2, kinds AS g3, CAST(mean AS DOUBLE) AS g4, fb AS g5, t AS g6 FROM c)
SELECT CAST(1 AS BIGINT) AS d, g1, NULL AS g2, NULL AS g3, NULL AS g4, NULL AS g5, NULL AS g6, count(DISTINCT id) AS id FROM k WHERE g1 IS NOT NULL GROUP BY g1
UNION ALL SELECT 2, g1, g2, NULL, NULL, NULL, NULL, count(DISTINCT id) FROM k WHERE g1 IS NOT NULL AND g2 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 3, g1, g2, g3, NULL, NULL, NULL, count(DISTINCT id) FROM k WHERE g1 IS NOT NULL AND g2 IS NOT NULL AND g3 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 4, g1, g2, g3, g4, NULL, NULL, count(DISTINCT id) FROM k WHERE g1 IS NOT NULL AND g2 IS NOT NULL AND g3 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 5, g1, g2, g3, g4, g5, NULL, count(DISTINCT id) FROM k WHERE g1 IS NOT NULL AND g2 IS NOT NULL AND g3 IS NOT NULL AND g5 IS NOT NULL GROUP BY ALL
UNION ALL SELECT 6, g1, g2, g3, g4, g5, g6, count(DISTINCT id) FROM k WHERE g1 IS NOT NULL AND g2 IS NOT NULL AND g3 IS NOT NULL AND g5 IS NOT NULL GROUP BY ALL""",
)

#: Neighbouring orders of a customer, and each pair of different products from the one and the other.
NEXT_PURCHASE = """
select
  count id
  count product as bought
  sum price as revenue
end
each_row where event == 'order'
  first = order_id
  each_row.continue().next().limit(1) where event == 'order'
    second = order_id
    each_row where event.is(== 'item') && order_id.is(== first)
      had = product
      each_row where event.is(== 'item') && order_id.is(== second) && product.is(!= had)
        << bucket(had, 50), bucket(product, 50)
      end
    end
  end
end
"""
scripted(
    "jn_next_purchase_script",
    NEXT_PURCHASE,
    """WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, epoch_ms(o_orderdate) AS stamp, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k2 FROM orders),
p AS (SELECT DISTINCT o.id, k, k2, l_partkey AS p FROM o JOIN lineitem ON l_orderkey = k WHERE k2 IS NOT NULL),
x AS (SELECT DISTINCT p.id, k2, l_linenumber AS ln, l_partkey AS product, l_extendedprice AS price, p // 50 * 50 AS g1, l_partkey // 50 * 50 AS g2 FROM p JOIN lineitem ON l_orderkey = k2 WHERE p <> l_partkey),
y AS (SELECT DISTINCT id, k2, ln, product, price, g1 FROM x)
SELECT CAST(1 AS BIGINT) AS d, g1, NULL AS g2, count(DISTINCT id) AS id, count(*) AS bought, round(sum(price), 2) AS revenue FROM y GROUP BY ALL
UNION ALL SELECT 2, g1, g2, count(DISTINCT id), count(*), round(sum(price), 2) FROM x GROUP BY ALL""",
    on=baskets,
    table="baskets",
    round_to={"revenue": 2},
)


@query(
    "jn_next_baskets",
    """WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k0 FROM orders),
p AS (SELECT DISTINCT o.id, k, l_partkey AS product_before FROM o JOIN lineitem ON l_orderkey = k0)
SELECT product_before % 100 AS before_group, count(DISTINCT p.id) AS customers, count(*) AS pairs, round(sum(l_extendedprice), 2) AS revenue
FROM p JOIN lineitem ON l_orderkey = k WHERE l_partkey <> product_before GROUP BY 1""",
)
def _(spark, sf_dir):
    items = sequence.next_baskets(source.fixture_baskets(spark, sf_dir), head="order", item="item", basket="order_id", product="product")
    return items.groupBy((F.col("product_before") % 100).alias("before_group")).agg(F.count_distinct("id").alias("customers"), F.count("*").alias("pairs"), F.round(F.sum("price"), 2).alias("revenue"))


@query(
    "jn_then_within_hour",
    f"""WITH r AS ({ROWS}) SELECT a.event AS first_event, b.event AS then_event, count(*) AS pairs, count(DISTINCT a.id) AS customers
FROM r a JOIN r b ON a.id = b.id AND b.rn > a.rn AND b.stamp BETWEEN a.stamp AND a.stamp + 3600000 GROUP BY ALL""",
)
def _(spark, sf_dir):
    r = rows.number(source.fixture_events(spark, sf_dir)).select("id", "rn", "stamp", "event")
    pairs = sequence.then(r, r, span=3_600_000)
    return pairs.groupBy(F.col("event").alias("first_event"), F.col("b_event").alias("then_event")).agg(F.count("*").alias("pairs"), F.count_distinct("id").alias("customers"))


@query(
    "jn_next_and_previous_match",
    f"""WITH r AS ({ROWS}), m AS (SELECT *, first(CASE WHEN event = 'purchase' THEN stamp END IGNORE NULLS) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n,
  last(CASE WHEN event = 'error' THEN rn END IGNORE NULLS) OVER (PARTITION BY id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT seq AS event_id, n AS next_stamp, p AS prev_rn FROM m WHERE event = 'view'""",
)
def _(spark, sf_dir):
    r = rows.number(source.fixture_events(spark, sf_dir))
    r = sequence.nearest(r, F.col("event") == "purchase", ["stamp"])
    r = sequence.nearest(r, F.col("event") == "error", ["rn"], back=True, prefix="prev_")
    return r.where(F.col("event") == "view").select(F.col("seq").alias("event_id"), "next_stamp", F.col("prev_rn").cast("long").alias("prev_rn"))


@query(
    "jn_count_within",
    f"SELECT seq AS event_id, count(*) FILTER (event = 'click') OVER (PARTITION BY id ORDER BY stamp RANGE BETWEEN 7200000 PRECEDING AND 3600000 FOLLOWING) AS clicks FROM ({EV})",
)
def _(spark, sf_dir):
    out = sequence.count_within(source.fixture_events(spark, sf_dir), F.col("event") == "click", 7_200_000, 3_600_000, "clicks")
    return out.select(F.col("seq").alias("event_id"), "clicks")


@query(
    "jn_customer_dimension",
    "SELECT c_mktsegment AS segment, count(DISTINCT o_custkey) AS customers, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)
def _(spark, sf_dir):
    e = rows.attach(source.fixture_baskets(spark, sf_dir).where(F.col("event") == "order"), source.fixture_customers(spark, sf_dir))
    return e.groupBy("segment").agg(F.count_distinct("id").alias("customers"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(
    "wi_row_metadata",
    f"""SELECT seq AS event_id, rn AS cursor, count(*) OVER w AS row_count, min(stamp) OVER w AS first_stamp, max(stamp) OVER w AS last_stamp, CAST(session AS BIGINT) AS session, CAST(max(session) OVER w AS BIGINT) AS session_count
FROM (SELECT *, sum(CASE WHEN stamp - prev > 1800000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY stamp, seq) AS session FROM (SELECT *, lag(stamp) OVER (PARTITION BY id ORDER BY stamp, seq) AS prev FROM ({ROWS}))) WINDOW w AS (PARTITION BY id)""",
)
def _(spark, sf_dir):
    r = rows.with_metadata(rows.with_session(rows.number(source.fixture_events(spark, sf_dir))), "row_count", "first_stamp", "last_stamp", "session_count")
    return r.select(F.col("seq").alias("event_id"), F.col("rn").cast("long").alias("cursor"), "row_count", "first_stamp", "last_stamp", "session", "session_count")


@query(
    "ag_inline_grouped",
    f"""SELECT id, round(sum(value) FILTER (event = 'purchase'), 2) AS spent, round(coalesce(avg(value) FILTER (event = 'click'), 0), 6) AS mean_click, min(value) FILTER (event = 'view') AS low, max(value) FILTER (event = 'view') AS high,
nullif(count(*) FILTER (event = 'error'), 0) AS errors, nullif(count(DISTINCT kk) FILTER (event = 'view'), 0) AS kinds, bool_or(event = 'signup') AS signed, min(rn) FILTER (event = 'purchase') AS first_row FROM ({ROWS}) GROUP BY id""",
)
def _(spark, sf_dir):
    r = rows.number(source.fixture_events(spark, sf_dir))
    is_ = lambda x: F.col("event") == x
    a = lambda kind, v, w: inline.aggregate(kind, F.col(v) if v else None, w)
    return r.groupBy("id").agg(F.round(a("sum", "value", is_("purchase")), 2).alias("spent"), F.round(a("avg", "value", is_("click")), 6).alias("mean_click"), a("min", "value", is_("view")).alias("low"), a("max", "value", is_("view")).alias("high"), a("count", "event", is_("error")).alias("errors"), a("dcount", "kk", is_("view")).alias("kinds"), a("test", None, is_("signup")).alias("signed"), a("row", None, is_("purchase")).cast("long").alias("first_row"))


@query(
    "hi_spend",
    f"""WITH v AS (SELECT id, sum(value) FILTER (event = 'purchase') AS v FROM ({EV}) GROUP BY id),
b AS (SELECT least(CAST(trunc(v / 250) * 250 AS DOUBLE), 3000.0) AS bucket, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 3001, 250)) AS DOUBLE) AS bucket)
SELECT bucket, coalesce(n, 0) AS customers FROM g LEFT JOIN b USING (bucket)""",
)
def _(spark, sf_dir):
    return engine(spark, sf_dir).histogram("events", "return(sum(value) where event.is(== 'purchase'))", bucket=250, min=0, max=3000, now=NOW)


@query(
    "hi_foreach_event",
    f"""WITH v AS (SELECT id, event AS each_value, count(*) AS v FROM ({EV}) GROUP BY ALL), b AS (SELECT each_value, CAST(v // 5 * 5 AS DOUBLE) AS bucket, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT each_value, CAST(unnest(range(CAST(min(bucket) AS BIGINT), CAST(max(bucket) AS BIGINT) + 1, 5)) AS DOUBLE) AS bucket FROM b GROUP BY each_value)
SELECT each_value, bucket, coalesce(n, 0) AS customers FROM g LEFT JOIN b USING (each_value, bucket)""",
)
def _(spark, sf_dir):
    return histogram.foreach(source.fixture_events(spark, sf_dir), "event", F.count("*"), bucket=5)


@query(
    "hi_foreach_script",
    f"SELECT event AS each_value, CAST(c AS DOUBLE) AS bucket, count(*) AS customers FROM (SELECT id, event, count(*) AS c FROM ({EV}) GROUP BY ALL) GROUP BY ALL",
)
def _(spark, sf_dir):
    return engine(spark, sf_dir).histogram("events", "return(count(event) where event.is(== each_value))", foreach="event", now=NOW)


@query(
    "hi_property_bucket",
    f"SELECT bucket AS value, count(DISTINCT id) AS customers FROM (SELECT id, CAST(trunc(round(value * 10000) / 500000) * 50 AS DOUBLE) AS bucket FROM ({EV})) GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT id) FROM ({EV}) WHERE value IS NOT NULL",
)
def _(spark, sf_dir):
    return engine(spark, sf_dir).property("events", "value", bucket=50)


@query(
    "pr_property_filters",
    f"""SELECT 'rx' AS filter, event AS value, count(DISTINCT id) AS customers FROM ({EV}) WHERE regexp_full_match(event, 'c.*|view') GROUP BY ALL
UNION ALL SELECT 'sub', event, count(DISTINCT id) FROM ({EV}) WHERE contains(event, 'r') GROUP BY ALL UNION ALL SELECT 'eq', event, count(DISTINCT id) FROM ({EV}) WHERE event = 'signup' GROUP BY ALL
UNION ALL SELECT 'between', CAST(kk AS VARCHAR), count(DISTINCT id) FROM ({EV}) WHERE kk >= 3 AND kk < 7 GROUP BY ALL UNION ALL SELECT 'lte', CAST(kk AS VARCHAR), count(DISTINCT id) FROM ({EV}) WHERE kk <= 2 GROUP BY ALL""",
)
def _(spark, sf_dir):
    e = source.fixture_events(spark, sf_dir)
    made = {"rx": ("event", {"rx": "c.*|view"}), "sub": ("event", {"sub": "r"}), "eq": ("event", {"eq": "signup"}), "between": ("kk", {"between": (3, 7)}), "lte": ("kk", {"lte": 2})}
    out = None
    for name, (prop, options) in made.items():
        part = histogram.property_values(e, prop, **options).where("value IS NOT NULL").select(F.lit(name).alias("filter"), F.col("value").cast("string").alias("value"), "customers")
        out = part if out is None else out.unionByName(part)
    return out


SEGMENTS = """
@segment buyers ttl=300s refresh=60s
if event.ever(== 'purchase')
  return(true)
end
@segment big_spenders refresh=5_minutes z_index=10
total = sum(value) where event.is(== 'purchase')
return(total > 1500)
@segment error_free
return(event.never(== 'error'))
@segment both z_index=200
intersection(buyers, error_free)
@segment either z_index=200
union(big_spenders, error_free)
@segment not_buyers z_index=200
compliment(buyers)
@segment buyers_only z_index=200
difference(buyers, big_spenders)
"""
SEGMENT_SQL = f"""c AS (SELECT id, bool_or(event = 'purchase') AS b, coalesce(sum(value) FILTER (event = 'purchase') > 1500, false) AS s, NOT bool_or(event = 'error') AS e FROM ({EV}) GROUP BY id),
m AS (SELECT 'buyers' AS segment, id FROM c WHERE b UNION ALL SELECT 'big_spenders', id FROM c WHERE s UNION ALL SELECT 'error_free', id FROM c WHERE e UNION ALL SELECT 'both', id FROM c WHERE b AND e
 UNION ALL SELECT 'either', id FROM c WHERE s OR e UNION ALL SELECT 'not_buyers', id FROM c WHERE NOT b UNION ALL SELECT 'buyers_only', id FROM c WHERE b AND NOT s)"""


@query("sg_counts", f"WITH {SEGMENT_SQL}, n AS (SELECT unnest(['buyers', 'big_spenders', 'error_free', 'both', 'either', 'not_buyers', 'buyers_only']) AS segment) SELECT segment, count(id) AS customers FROM n LEFT JOIN m USING (segment) GROUP BY 1")
def _(spark, sf_dir):
    return engine(spark, sf_dir).segment("events", SEGMENTS, now=NOW)


@query("sg_members", f"WITH {SEGMENT_SQL} SELECT segment, id FROM m")
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.segment("events", SEGMENTS, now=NOW)
    return e.members("events")


@query(
    "sg_compare",
    f"""WITH {SEGMENT_SQL}, a AS (SELECT event AS g1, count(DISTINCT id) AS id, count(*) AS n FROM ({EV}) GROUP BY 1), b AS (SELECT event AS g1, count(DISTINCT id) AS id_2, count(*) AS n_2 FROM ({EV}) WHERE id IN (SELECT id FROM m WHERE segment = 'big_spenders') GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS d, g1, id, n, id_2, n_2 FROM a FULL JOIN b USING (g1)""",
)
def _(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.segment("events", SEGMENTS, now=NOW)
    out = e.event("events", "select\n count id\n count event as n\nend\neach_row where event != nil\n << event\nend", segments=["*", "big_spenders"], now=NOW).frame
    return out.withColumn("d", F.col("d").cast("long"))


@query(
    "sg_changes",
    f"""WITH o AS (SELECT DISTINCT id FROM ({EV}) WHERE value > 350 AND stamp < 1705276800000), n AS (SELECT DISTINCT id FROM ({EV}) WHERE value > 350 AND stamp >= 1705276800000)
SELECT 'high' AS segment, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'enter' ELSE 'exit' END AS state FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL""",
)
def _(spark, sf_dir):
    high = source.fixture_events(spark, sf_dir).where("value > 350")
    old, new = (high.where(w).select(F.lit("high").alias("segment"), "id") for w in ("stamp < 1705276800000", "stamp >= 1705276800000"))
    return segments.changes(old, new)


@query(
    "so_trim",
    f"""WITH f AS (SELECT event AS g1, kk AS g2, count(DISTINCT id) AS id, count(*) AS n FROM ({EV}) GROUP BY ALL), p AS (SELECT event AS g1, count(DISTINCT id) AS id, count(*) AS n FROM ({EV}) GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (ORDER BY n DESC, g1) AS place FROM p), tf AS (SELECT *, row_number() OVER (PARTITION BY g1 ORDER BY n DESC, CAST(g2 AS VARCHAR)) AS place FROM f)
SELECT CAST(1 AS BIGINT) AS d, g1, NULL AS g2, id, n, place FROM tp WHERE place <= 3 UNION ALL SELECT 2, tf.g1, tf.g2, tf.id, tf.n, tf.place FROM tf JOIN tp USING (g1) WHERE tf.place <= 3 AND tp.place <= 3""",
)
def _(spark, sf_dir):
    r = engine(spark, sf_dir).event("events", "select\n count id\n count event as n\nend\neach_row where event != nil\n << event, kk\nend", now=NOW)
    return render.arrange(r.frame, r.groups, sort="n", trim=3).withColumn("d", F.col("d").cast("long")).withColumn("place", F.col("place").cast("long"))


@query(
    "so_group_order",
    f"""SELECT CAST(1 AS BIGINT) AS d, event AS g1, count(DISTINCT id) AS id, row_number() OVER (ORDER BY lower(event)) AS place FROM ({EV}) GROUP BY event""",
)
def _(spark, sf_dir):
    r = engine(spark, sf_dir).event("events", "each_row where event != nil\n << event\nend", now=NOW)
    return render.arrange(r.frame, r.groups, sort="group", order="asc").withColumn("d", F.col("d").cast("long")).withColumn("place", F.col("place").cast("long"))


@query(
    "fd_dates",
    """SELECT event_id, second(ts) AS second, minute(ts) AS minute, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week, day(ts) AS day_of_month, dayofyear(ts) AS day_of_year, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year,
epoch_ms(date_trunc('second', ts)) AS start_second, epoch_ms(date_trunc('minute', ts)) AS start_minute, epoch_ms(date_trunc('hour', ts)) AS start_hour, epoch_ms(date_trunc('day', ts)) AS start_day,
epoch_ms(CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP)) AS start_week, epoch_ms(CAST(date_trunc('month', ts) AS TIMESTAMP)) AS start_month, epoch_ms(CAST(date_trunc('quarter', ts) AS TIMESTAMP)) AS start_quarter, epoch_ms(CAST(date_trunc('year', ts) AS TIMESTAMP)) AS start_year,
epoch_us(ts) // 3600000000 AS hours, epoch_us(ts) // 604800000000 AS weeks, epoch_us(ts) // 86400000000 AS days, epoch_us(ts) // 60000000 AS minutes, epoch_us(ts) // 1000000 AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
FROM (SELECT event_id, ts + to_days(CAST(event_id % 2500 AS INTEGER)) AS ts FROM events)""",
)
def _(spark, sf_dir):
    s = F.col("stamp") + (F.col("seq") % 2500) * 86_400_000
    parts = [scalars.date_part(p, s).alias(p) for p in ("second", "minute", "hour", "day_of_week", "day_of_month", "day_of_year", "month", "quarter", "year")]
    starts = [scalars.start_of(u, s).alias(f"start_{u}") for u in ("second", "minute", "hour", "day", "week", "month", "quarter", "year")]
    return source.fixture_events(spark, sf_dir).select(F.col("seq").alias("event_id"), *parts, *starts, scalars.to_span("hours", s).alias("hours"), *[scalars.to_span(u, s).alias(u) for u in ("weeks", "days", "minutes", "seconds")], scalars.iso8601(s).alias("iso"))


@query(
    "fm_numbers",
    """SELECT event_id, CASE WHEN k = 0 THEN 0 ELSE event_id // k END AS quotient, CAST(trunc(trunc(value * 100) / 2500) AS BIGINT) * 25 AS bucket_25, CAST(trunc(value) AS BIGINT) AS whole,
CASE WHEN event_id % 4 = 0 OR k IS NULL THEN 0 WHEN event_id % 4 = 1 THEN -k ELSE k END AS text_int, CASE WHEN event_id % 4 = 0 OR k IS NULL THEN 0.0 ELSE CAST(k + 0.25 AS DOUBLE) END AS text_float,
CAST(round(CAST(value AS DECIMAL(18, 6)), 1) AS DOUBLE) AS rounded, CAST(CAST(round(CAST(value AS DECIMAL(18, 6)), 1) AS DECIMAL(18, 1)) AS VARCHAR) AS fixed, CAST(k AS VARCHAR) AS k_text, length(event_type) AS text_length
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def _(spark, sf_dir):
    e = source.fixture_events(spark, sf_dir)
    which = F.col("seq") % 4
    whole = F.when(which == 0, F.col("event")).otherwise(F.concat(F.when(which == 1, " -").otherwise("  "), "kk", F.lit("th")))
    broken = F.when(which == 0, F.col("event")).otherwise(F.concat(F.lit(" "), "kk", F.lit(".25 EUR")))
    return e.select(F.col("seq").alias("event_id"), scalars.divide(F.col("seq"), F.col("kk"), True).alias("quotient"), scalars.bucket(F.col("value"), 25).alias("bucket_25"), scalars.trunc(F.col("value")).alias("whole"), scalars.to_int(whole).alias("text_int"), scalars.to_float(broken).alias("text_float"), scalars.round_(F.col("value"), 1).alias("rounded"), scalars.fix(F.col("value"), 1).alias("fixed"), F.col("kk").cast("string").alias("k_text"), F.length("event").cast("long").alias("text_length"))


@query(
    "fs_urls",
    """SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query,
nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, replace(url, 'example', '') AS without, strpos(url, 'example') - 1 AS found FROM pages""",
)
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").withColumn("u", scalars.url_decode(F.col("url")))
    return p.select("page_id", "u.host", "u.path", "u.query", F.try_element_at("u.params", F.lit("page")).alias("page"), scalars.remove(F.col("url"), F.lit("example")).alias("without"), scalars.find(F.col("url"), F.lit("example")).alias("found"))


@query(
    "fc_containers",
    f"""WITH c AS (SELECT id, list_sort(list_distinct(list(event))) AS l, list_sort(list_distinct(list(kk) FILTER (kk < 5))) AS k FROM ({EV}) GROUP BY id)
SELECT id, array_to_string(l, ',') AS kinds, len(l) AS n_kinds, list_contains(l, 'error') AS has_error, list_has_any(l, ['signup', 'nothing']) AS any_of, list_has_all(l, ['view', 'click']) AS all_of, array_to_string(list_filter(l, lambda x: x NOT IN ('view', 'click')), ',') AS others, l[1] AS first_kind FROM c""",
)
def _(spark, sf_dir):
    from cohortlake.functions import nil

    c = source.fixture_events(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_set("event")).alias("l"))
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    return c.select("id", F.array_join("l", ",").alias("kinds"), F.size("l").cast("long").alias("n_kinds"), nil.contains(F.col("l"), F.lit("error"), False).alias("has_error"), nil.overlaps(F.col("l"), lits("signup", "nothing")).alias("any_of"), nil.contains(F.col("l"), lits("view", "click"), True).alias("all_of"), F.array_join(scalars.list_minus(F.col("l"), lits("view", "click")), ",").alias("others"), scalars.at(F.col("l"), F.lit(0)).alias("first_kind"))


@query(
    "sc_ingest",
    f"""WITH e AS (SELECT DISTINCT ON (id, stamp, event, value, kk) id, stamp, event, value, kk, seq FROM ({EV}) ORDER BY seq DESC),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stamp DESC, seq DESC) AS nth FROM e WHERE stamp > {NOW} - CAST(25 AS BIGINT) * 86400000) SELECT id, stamp, event, value, kk, seq FROM r WHERE nth <= 40""",
)
def _(spark, sf_dir):
    """Events as JSON texts, twice over, through coercion, deduplication, retention by age and by count."""
    e = source.fixture_events(spark, sf_dir)
    texts = e.select("seq", F.to_json(F.struct(F.col("id"), F.col("stamp"), F.col("event"), F.col("value"), F.col("kk"))).alias("value"))
    twice = texts.unionByName(texts.withColumn("seq", F.col("seq") - 1_000_000_000))
    spec = source.FIXTURE.with_settings(event_ttl=25 * 86_400_000, event_max=40)
    events, _ = source.ingest(source.from_strings(twice, spec, carry=("seq",)), spec, seq="seq", now=NOW)
    return events.select("id", "stamp", "event", "value", "kk", "seq")


#: JSON values of every kind, and what each becomes as int, double, bool, text, and as sets of int and text.
ODD_VALUES = (
    ("12", "12", "12.0", "true", "12", "12", "12"),
    ('"12"', None, None, "true", "12", None, "12"),
    ('"0"', None, None, "false", "0", None, "0"),
    ("3.75", "3", "3.75", "true", "3.750000", "3", "3.750000"),
    ("-3.75", "-3", "-3.75", "true", "-3.750000", "-3", "-3.750000"),
    ("0", "0", "0.0", "false", "0", "0", "0"),
    ("true", "1", "1.0", "true", "true", "1", "true"),
    ("9007199254740993", "9007199254740993", "9007199254740992.0", "true", "9007199254740993", "9007199254740993", "9007199254740993"),
    ("null", None, None, None, None, None, None),
    ('[1, "2", 3.5, true, null, 1]', None, None, None, None, "1,3", "1,2,3.500000,true"),
    ('{"a": 1}', None, None, None, None, None, None),
)
_ODD = ", ".join("(" + ", ".join([str(k), *["NULL" if x is None else f"'{x}'" for x in row[1:]]]) + ")" for k, row in enumerate(ODD_VALUES))


@query(
    "sc_json_types",
    f"""WITH o(k, i, d, b, t, si, st) AS (VALUES {_ODD})
SELECT event_id, user_id AS id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS stamp, CAST(i AS BIGINT) AS ii, CAST(d AS DOUBLE) AS dd, CAST(b AS BOOLEAN) AS bb, t AS tt, si, st, 'kept' AS fixed
FROM events JOIN o ON event_id % {len(ODD_VALUES)} = k WHERE event_id % 7 <> 0 AND event_id % 13 <> 0""",
)
def _(spark, sf_dir):
    """Values of all JSON types in properties of all types; quoted ids and events that are no text are dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.element_at(F.array(*[F.lit(row[0]) for row in ODD_VALUES]), (F.col("event_id") % len(ODD_VALUES) + 1).cast("int"))
    stamp = F.unix_millis(F.col("ts").cast("timestamp"))
    stamped = F.when(F.col("event_id") % 3 == 0, F.call_function("div", stamp, F.lit(1000)).cast("string")).otherwise(stamp.cast("string"))
    named = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    said = F.when(F.col("event_id") % 13 == 0, F.lit("5")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    parts = [F.lit('{"id": '), named, F.lit(', "stamp": '), stamped, F.lit(', "event": '), said, F.lit(', "fixed": "kept"')]
    for n in ("ii", "dd", "bb", "tt", "si", "st"):
        parts += [F.lit(f', "{n}": '), odd]
    texts = e.select("event_id", F.concat(*parts, F.lit("}")).alias("value"))
    spec = TableSpec("odd", "numeric", (Property("ii", "int"), Property("dd", "double"), Property("bb", "bool"), Property("tt", "text"), Property("si", "int", is_set=True), Property("st", "text", is_set=True), Property("fixed", "text")))
    typed = source.from_strings(texts, spec, carry=("event_id",))
    return typed.select("event_id", "id", "stamp", "ii", "dd", "bb", "tt", *[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("si", "st")], "fixed")


@query(
    "sc_property_write_back",
    """WITH s AS (SELECT o_custkey AS id, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN n > 9 THEN 'many' WHEN n IS NOT NULL THEN NULL ELSE c_mktsegment END AS segment, round(CASE WHEN n IS NOT NULL THEN t ELSE c_acctbal END, 2) AS balance FROM customer LEFT JOIN s ON id = c_custkey""",
)
def _(spark, sf_dir):
    e = baskets(spark, sf_dir)
    script = "balance = sum(price) where event.is(== 'order')\nif (count(order_id) where event.is(== 'order')) > 9\n segment = 'many'\nelse\n segment = nil\nend"
    return e.apply("baskets", script, now=NOW).withColumn("balance", F.round("balance", 2))


@query(
    "sc_customer_json",
    f"""WITH r AS ({ROWS}) SELECT id, '{{"id":' || id || ',"properties":{{}},"events":[' || string_agg('{{"stamp":' || stamp || ',"stamp_iso":"' || strftime(make_timestamp(stamp * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || '","event":"' || event || '","_":{{' ||
concat_ws(',', '"value":' || CAST(value AS VARCHAR), '"kk":' || CAST(kk AS VARCHAR)) || '}}}}', ',' ORDER BY rn) || ']}}' AS json FROM r GROUP BY id""",
)
def _(spark, sf_dir):
    e = source.fixture_events(spark, sf_dir)
    return render.customer_json(e, None, ["value", "kk"], [])


@query(
    "sc_property_values",
    f"SELECT kk AS value, count(DISTINCT id) AS customers FROM ({EV}) WHERE kk IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT id) FROM ({EV}) WHERE kk IS NOT NULL",
)
def _(spark, sf_dir):
    return engine(spark, sf_dir).property("events", "kk")


@query("st_sessions_window", f"""WITH s AS (SELECT *, sum(CASE WHEN stamp - prev > 1800000 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY stamp, seq) AS session FROM (SELECT *, lag(stamp) OVER (PARTITION BY id ORDER BY stamp, seq) AS prev FROM ({EV})))
SELECT id, CAST(session AS BIGINT) AS session, min(stamp) AS first_stamp, max(stamp) AS last_stamp, count(*) AS n FROM s GROUP BY ALL""")
def _(spark, sf_dir):
    closed = streaming.sessions(source.fixture_events(spark, sf_dir), rows.DEFAULT_SESSION_MS)
    return closed.select("id", F.row_number().over(Window.partitionBy("id").orderBy("first_stamp")).cast("long").alias("session"), "first_stamp", "last_stamp", "n")


scripted(
    "pr_look",
    """
select
  count id
  count event as n
end
each_row where event.look_ahead(3_days, 1705000000000).ever(== 'signup') && event.look_back(2_days, 1705000000000).ever(== 'error') && event not in ['view', 'signup']
  << event
end
""",
    f"""SELECT CAST(1 AS BIGINT) AS d, event AS g1, count(DISTINCT id) AS id, count(*) AS n FROM (SELECT *, bool_or(event = 'signup' AND stamp BETWEEN 1705000000000 AND 1705259200000) OVER (PARTITION BY id) AS a,
bool_or(event = 'error' AND stamp BETWEEN 1704827200000 AND 1705000000000) OVER (PARTITION BY id) AS b FROM ({EV})) WHERE a AND b AND event NOT IN ('view', 'signup') GROUP BY event""",
)
scripted(
    "fl_break_elsif",
    """
select
  count id
  count event as n
end
found = 0
each_row where value > dbl_least
  found = found + 1
  if found > int_most
    break
  elsif event == str_wanted
    << 'wanted', event
  else
    << 'other', event
  end
end
""",
    f"""WITH f AS (SELECT *, CASE WHEN event = 'click' THEN 'wanted' ELSE 'other' END AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS nth FROM ({ROWS}) WHERE value > 100.5) WHERE nth <= 3)
SELECT CAST(1 AS BIGINT) AS d, k AS g1, NULL AS g2, count(DISTINCT id) AS id, count(*) AS n FROM f GROUP BY k UNION ALL SELECT 2, k, event, count(DISTINCT id), count(*) FROM f GROUP BY k, event""",
    params={"least": 100.5, "most": 3, "wanted": "click"},
)
scripted(
    "fc_dict_script",
    """
each_row.limit(1) where event != nil
  box = {'rows': row_count}
  box['kinds'] = dcount(event) where event != nil
  for name in keys(box)
    << name, box[name]
  end
end
""",
    f"""WITH c AS (SELECT id, count(*) AS r, count(DISTINCT event) AS k FROM ({EV}) GROUP BY id), f AS (SELECT id, 'rows' AS g1, CAST(r AS VARCHAR) AS g2 FROM c UNION ALL SELECT id, 'kinds', CAST(k AS VARCHAR) FROM c)
SELECT CAST(1 AS BIGINT) AS d, g1, NULL AS g2, count(DISTINCT id) AS id FROM f GROUP BY g1 UNION ALL SELECT 2, g1, g2, count(DISTINCT id) FROM f GROUP BY g1, g2""",
)
scripted(
    "fs_text_script",
    """
select
  count event as n
end
each_row where __find(event, 'i') >= 0
  << event[0:3] + '.', event[-2:], __rfind(event, 'c'), len(event)
end
""",
    f"""WITH f AS (SELECT left(event, 3) || '.' AS g1, right(event, 2) AS g2, length(event) - strpos(reverse(event), 'c') - CASE WHEN strpos(event, 'c') = 0 THEN length(event) + 1 ELSE 0 END AS g3, length(event) AS g4 FROM ({EV}) WHERE contains(event, 'i'))
SELECT CAST(1 AS BIGINT) AS d, g1, NULL AS g2, NULL AS g3, NULL AS g4, count(*) AS n FROM f GROUP BY g1 UNION ALL SELECT 2, g1, g2, NULL, NULL, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 3, g1, g2, g3, NULL, count(*) FROM f GROUP BY ALL UNION ALL SELECT 4, g1, g2, g3, g4, count(*) FROM f GROUP BY ALL""",
)


@query(
    "sg_batch",
    f"""WITH m AS (SELECT id FROM ({EV}) GROUP BY id HAVING bool_or(event = 'purchase')), r AS (SELECT * FROM ({EV}) WHERE id IN (SELECT id FROM m))
SELECT 'kk' AS section, CAST(kk AS VARCHAR) AS value, count(DISTINCT id) AS customers FROM r WHERE kk < 6 GROUP BY ALL UNION ALL SELECT 'kk', NULL, count(DISTINCT id) FROM r WHERE kk IS NOT NULL
UNION ALL SELECT 'events', event, count(DISTINCT id) FROM r GROUP BY ALL UNION ALL SELECT 'copied', 'members', count(*) FROM m""",
)
def _(spark, sf_dir):
    """Sections of one text: segments first, a copy of one, then a property and an event query of its members."""
    e = engine(spark, sf_dir)
    out = e.batch("events", "@event kinds\neach_row where event != nil\n << event\nend\n@use copied\n@property kk lt=6\n@event kinds\neach_row where event != nil\n << event\nend\n@segment buyers\nreturn(event.ever(== 'purchase'))\n@segment copied z_index=200\npopulation(buyers)", now=NOW)
    kk = out[1]["frame"].select(F.lit("kk").alias("section"), F.col("value").cast("string").alias("value"), "customers")
    kinds = out[2]["result"].frame.select(F.lit("events").alias("section"), F.col("g1").alias("value"), F.col("id").alias("customers"))
    copied = e.members("events").where("segment = 'copied'").groupBy().agg(F.count("*").alias("customers")).select(F.lit("copied").alias("section"), F.lit("members").alias("value"), "customers")
    return kk.unionByName(kinds).unionByName(copied)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next-purchase sequence."""
    return QUERIES["jn_next_purchase_script"](spark, sf_dir)
