"""Event sources: JSON events and Parquet fixtures, coerced, normalised, deduplicated and ordered."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.functions import scalars
from cohortlake.spec import Property, TableSpec

#: Rank of events that the order does not name.
UNRANKED = 99


def json_schema(spec: TableSpec) -> T.StructType:
    """Every field as a variant: it keeps the type the JSON has, and an odd value does not null its whole record."""
    return T.StructType([T.StructField(n, T.VariantType()) for n in ("id", "stamp", "event", *[p.name for p in spec.properties])])


def read_json(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Line-delimited events of a file or folder, coerced to the specification."""
    return coerce(spark.read.schema(json_schema(spec)).json(path), spec)


def from_strings(lines: DataFrame, spec: TableSpec, column: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Events from a column of JSON texts: one object or an array of objects each; the columns `carry` come along."""
    one = json_schema(spec)
    both = F.when(F.col(column).rlike(r"^\s*\["), F.from_json(column, T.ArrayType(one))).otherwise(F.array(F.from_json(column, one)))
    return coerce(lines.select(*carry, F.explode(both).alias("e")).where("e IS NOT NULL").select(*carry, "e.*"), spec, carry)


def _is(raw: Column, *kinds: str) -> Column:
    """Whether a variant holds one of the kinds; a missing one holds none."""
    said = F.schema_of_variant(raw)
    yes = F.lit(False)
    for k in kinds:
        yes = yes | said.startswith(k)
    return F.coalesce(yes, F.lit(False))


def _get(raw: Column, kind: str) -> Column:
    return F.try_variant_get(raw, "$", kind)


_WHOLE, _BROKEN = ("BIGINT",), ("DECIMAL", "DOUBLE", "FLOAT")


def _scalar(raw: Column, kind: str) -> Column:
    """A variant that is no array, in a property's type; null where the table of types has no entry."""
    whole, broken, text, truth = _is(raw, *_WHOLE), _is(raw, *_BROKEN), _is(raw, "STRING"), _is(raw, "BOOLEAN")
    if kind == "int":
        return F.when(whole, _get(raw, "long")).when(broken, _get(raw, "double").try_cast("long")).when(truth, _get(raw, "boolean").cast("long"))
    if kind == "double":
        return F.when(whole | broken, _get(raw, "double")).when(truth, _get(raw, "boolean").cast("double"))
    if kind == "bool":
        return F.when(whole | broken, _get(raw, "double") != 0).when(text, _get(raw, "string") != "0").when(truth, _get(raw, "boolean"))
    return F.when(text | whole | truth, _get(raw, "string")).when(broken, F.format_string("%f", _get(raw, "double")))


def coerce_value(raw: Column, p: Property) -> Column:
    """A variant to the property's type.

    Whole numbers stay exact, others are cut towards zero for int; text becomes no number; bool takes numbers by
    being 0 and text by being '0'; text takes numbers in digits, with six decimals unless they are whole. A scalar
    becomes a set of one, elements without a value in the type go, an array is no value of a single property."""
    if not p.is_set:
        return _scalar(raw, p.type)
    one = _scalar(raw, p.type)
    many = F.filter(F.transform(_get(raw, "array<variant>"), lambda x: _scalar(x, p.type)), lambda x: x.isNotNull())
    return F.when(_is(raw, "ARRAY"), F.array_distinct(many)).when(one.isNotNull(), F.array(one))


def normal_stamp(raw: Column) -> Column:
    """A variant of ISO 8601 text or a number; small numbers are seconds; 0 if missing."""
    number = F.when(_is(raw, *_WHOLE), _get(raw, "long")).when(_is(raw, *_BROKEN), _get(raw, "double").try_cast("long"))
    text = F.when(_is(raw, "STRING"), scalars.iso8601_to_stamp(_get(raw, "string")))
    return F.coalesce(scalars.millis(number), text, F.lit(0).cast("long"))


def coerce(raw: DataFrame, spec: TableSpec, carry: tuple[str, ...] = ()) -> DataFrame:
    """Typed events and customer properties; rows without a usable id, an event or any property, or with a
    negative stamp, are dropped. A numeric id is a whole number, a textual one text, in lower case. Unknown fields
    are ignored, missing ones null; columns of other types than variants count as JSON of their values."""
    kinds = {f.name: f.dataType for f in raw.schema.fields}

    def field(n: str) -> Column:
        if n not in kinds or isinstance(kinds[n], T.NullType):
            return F.lit(None).cast("variant")
        return F.col(n) if isinstance(kinds[n], T.VariantType) else F.col(n).cast("variant")

    named, said = field("id"), field("event")
    key = F.when(_is(named, *_WHOLE), _get(named, "long")) if spec.id_type == "numeric" else F.lower(F.when(_is(named, "STRING"), _get(named, "string")))
    event = F.when(_is(said, "STRING"), _get(said, "string"))
    typed = raw.select(*carry, key.alias("id"), normal_stamp(field("stamp")).alias("stamp"), event.alias("event"), *[coerce_value(field(p.name), p).alias(p.name) for p in spec.properties])
    some = F.lit(False)
    for p in spec.properties:
        some = some | F.col(p.name).isNotNull()
    return typed.where(F.col("id").isNotNull() & F.col("event").isNotNull() & (F.col("stamp") >= 0) & some)


def event_rank(spec: TableSpec) -> Column:
    if not spec.event_order:
        return F.lit(UNRANKED)
    ranks = F.create_map(*chain.from_iterable((F.lit(e), F.lit(k)) for k, e in enumerate(spec.event_order)))
    return F.coalesce(F.element_at(ranks, F.col("event")), F.lit(UNRANKED))


def ingest(coerced: DataFrame, spec: TableSpec, *, seq: str | None = None, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, customers). Events: id, stamp, event, event properties, z (rank) and seq (arrival).

    Of rows equal in id, stamp, event and all event properties the latest stays. Rows older than event_ttl
    before now, and a customer's oldest beyond event_max, go. Of each customer property the value that
    arrived last holds. One shuffle by id serves the deduplication, the limit and later windows.
    """
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    rows = coerced.withColumn("seq", order.cast("long"))
    return merged(rows, spec, now=now), customers(rows, spec)


def merged(rows: DataFrame, spec: TableSpec, *, now: int | None = None) -> DataFrame:
    """The events of ingest(), from rows with arrival numbers."""
    names = [p.name for p in spec.event_properties]
    alike = Window.partitionBy("id", "stamp", "event", *names).orderBy(F.desc("seq"))
    events = rows.select("id", "stamp", "event", *names, event_rank(spec).cast("int").alias("z"), "seq").repartition("id")
    events = events.withColumn("nth", F.row_number().over(alike)).where("nth = 1").drop("nth")
    if now is not None:
        events = events.where(F.col("stamp") > now - spec.setting("event_ttl"))
    newest = Window.partitionBy("id").orderBy(F.desc("stamp"), F.desc("z"), F.desc("seq"))
    return events.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= spec.setting("event_max")).drop("nth")


def customers(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per id; a later null does not unset a property."""
    last = [F.max_by(p.name, F.when(F.col(p.name).isNotNull(), F.struct("stamp", "seq"))).alias(p.name) for p in spec.customer_properties]
    return rows.groupBy("id").agg(*last) if last else rows.select("id").distinct()


FIXTURE = TableSpec("events", "numeric", (Property("value", "double"), Property("kk", "int")))
BASKETS = TableSpec("baskets", "numeric", (Property("order_id", "int"), Property("product", "int"), Property("price", "double"), Property("quantity", "double"), Property("segment", "text", is_customer=True), Property("balance", "double", is_customer=True)), ("order", "item"))


def fixture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as engine events."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(F.col("user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("stamp"), F.col("event_type").alias("event"), "value", F.get_json_object("props", "$.k").cast("long").alias("kk"), F.lit(UNRANKED).alias("z"), F.col("event_id").alias("seq"))


def fixture_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as one stream per customer: an 'order' event, then its 'item' events."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("stamp"), "o_totalprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    head = orders.select(F.col("o_custkey").alias("id"), "stamp", F.lit("order").alias("event"), F.col("o_orderkey").alias("order_id"), F.lit(None).cast("long").alias("product"), F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("quantity"), F.lit(0).alias("z"), (F.col("o_orderkey") * 10).alias("seq"))
    items = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), "stamp", F.lit("item").alias("event"), F.col("o_orderkey").alias("order_id"), F.col("l_partkey").alias("product"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.lit(1).alias("z"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return head.unionByName(items)


def fixture_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
