"""The canonical frame: each customer's events in order, with row metadata added where it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_SESSION_MS = 30 * 60_000


def ordered(desc: bool = False) -> Window:
    """Events of one customer by stamp, event rank and arrival."""
    keys = ["stamp", "z", "seq"]
    return Window.partitionBy("id").orderBy(*[F.desc(k) if desc else F.asc(k) for k in keys])


def everything() -> Window:
    return Window.partitionBy("id")


def number(events: DataFrame) -> DataFrame:
    """rn: 0-based place in the customer's order (the cursor)."""
    return events.withColumn("rn", F.row_number().over(ordered()) - 1)


def with_session(events: DataFrame, session_ms: int = DEFAULT_SESSION_MS) -> DataFrame:
    """session: 1, and one more after each gap longer than session_ms."""
    w = ordered()
    gap = F.coalesce((F.col("stamp") - F.lag("stamp").over(w) > session_ms).cast("int"), F.lit(1))
    return events.withColumn("gap", gap).withColumn("session", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("gap")


def with_metadata(events: DataFrame, *names: str) -> DataFrame:
    """Any of row_count, first_stamp, last_stamp, session_count (needs session)."""
    w = everything()
    made = {"row_count": F.count(F.lit(1)), "first_stamp": F.min("stamp"), "last_stamp": F.max("stamp"), "session_count": F.max("session") if "session" in events.columns else None}
    for n in names:
        if made[n] is None:
            raise ValueError("session_count needs session")
        events = events.withColumn(n, made[n].over(w))
    return events


def attach(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer properties on each event; customers is small beside events, so it is the side to move."""
    return events.join(customers, "id", "left")


def ever(condition, *, scope=None):
    """True on all rows of a customer if the condition holds on any (in scope)."""
    within = condition if scope is None else condition & scope
    return F.max(F.coalesce(within, F.lit(False))).over(everything())
