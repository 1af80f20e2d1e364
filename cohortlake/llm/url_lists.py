"""Dated URL lists joined as of each capture's fetch time, with DataFrame operations only.

Entries say that a pattern (a domain, or a domain with leading path segments) was put on or taken off a
list on a date. They become validity intervals per list and pattern; a capture is tested against the
patterns its URL falls under, in the intervals that hold its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower case, without user, port and trailing dot; '' if the URL has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")


def segments(url: Column) -> Column:
    """The non-empty segments of the path."""
    return F.filter(F.split(F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")


def domains(name: Column) -> Column:
    """The host and each parent domain of two labels or more; only itself for an address or one label."""
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name == "", F.array().cast("array<string>")).when(name.rlike(r"^\d+(\.\d+){3}$"), F.array(name)).otherwise(parents)


def patterns(url: Column, depth: int) -> Column:
    """Every domain of the URL with its first 0..depth path segments."""
    parts = segments(url)
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(depth))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    both = F.flatten(F.transform(domains(host(url)), lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(both)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) in seconds from entries (list, pattern, day, listed); valid_to is
    excluded and null while nothing ended it.

    day counts days since 1970 and takes effect at midnight UTC. Repeated entries count once, so a pattern
    has two entries a day at most; of both on one day the listing holds. Entries with a null are ignored.
    """
    clean = entries.select("list", F.lower("pattern").alias("pattern"), "day", "listed").dropna().distinct()
    order = Window.partitionBy("list", "pattern").orderBy("day", "listed")
    spans = clean.withColumn("next", F.lead("day").over(order)).where("listed AND (next IS NULL OR next > day)")
    return spans.select("list", "pattern", (F.col("day") * 86400).alias("valid_from"), (F.col("next") * 86400).alias("valid_to"))


def match(captures: DataFrame, entries: DataFrame, *, key: str = "page_id", url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """(key, url, fetched_at, n_active, lists, pattern, blocked), one row for each row of captures.

    n_active: entries (list, pattern) in force at fetched_at (seconds since 1970); lists: their names,
    sorted, comma-joined; pattern: the longest of them, the first in the alphabet of equals, null if none.
    Null or hostless URLs and null times match nothing. Captures equal in all three columns are evaluated
    once and given back as often as they came. Patterns meet captures by equality, so a host with a third
    of all captures is an ordinary skewed join key; a capture has a few rows however long the list is.
    """
    rows = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched_at).cast("long").alias("at"))
    spans = intervals(entries)
    depth = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("d")).first()["d"] or 0
    # the shuffled rows carry a hash in place of the URL
    candidates = rows.where("at IS NOT NULL").distinct().select("key", "at", F.xxhash64("url").alias("url_hash"), F.explode(F.array_distinct(patterns(F.col("url"), depth))).alias("pattern"))
    active = candidates.join(spans, "pattern").where("at >= valid_from AND (valid_to IS NULL OR at < valid_to)")
    found = active.select("key", "at", "url_hash", F.lit(None).cast("string").alias("url"), F.lit(0).alias("row"), F.struct((-F.length("pattern")).alias("rank"), "pattern", "list").alias("entry"))
    asked = rows.select("key", "at", F.xxhash64("url").alias("url_hash"), "url", F.lit(1).alias("row"), F.lit(None).cast(found.schema["entry"].dataType).alias("entry"))
    judged = asked.unionByName(found).groupBy("key", "at", "url_hash").agg(F.max("url").alias("url"), F.sum("row").alias("rows"), F.array_sort(F.collect_set("entry")).alias("entries"))
    return judged.select(
        F.col("key").alias(key),
        "url",
        F.col("at").alias(fetched_at),
        F.size("entries").cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["list"]))), ",").alias("lists"),
        F.get(F.transform("entries", lambda e: e["pattern"]), F.lit(0)).alias("pattern"),
        (F.size("entries") > 0).alias("blocked"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
