"""Result trees: sorting and trimming siblings in Spark, JSON on the driver from what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def arrange(result: DataFrame, groups: list[str], *, sort: str | None = None, order: str = "desc", trim: int | None = None) -> DataFrame:
    """result of tally() with `place`, the place among siblings by a column (sort='group': by the key, text in
    lower case), and only the first `trim` of each parent whose parents are kept too."""
    values = [c for c in result.columns if c not in ("d", *groups)]
    key = sort or values[0]
    own = F.lit(None).cast("string")
    for k in range(len(groups) - 1, -1, -1):
        own = F.when(F.col("d") == k + 1, F.col(groups[k]).cast("string")).otherwise(own)
    by = F.lower(own) if key == "group" else F.col(key)
    turned = by.desc_nulls_last() if order == "desc" else by.asc_nulls_last()
    if key == "group" and all(result.schema[g].dataType.simpleString() in ("bigint", "int", "double") for g in groups):
        number = F.lit(None).cast("double")
        for k in range(len(groups) - 1, -1, -1):
            number = F.when(F.col("d") == k + 1, F.col(groups[k]).cast("double")).otherwise(number)
        turned = number.desc() if order == "desc" else number.asc()
    parents = [F.when(F.col("d") > k + 1, F.col(g)) for k, g in enumerate(groups)]
    placed = result.withColumn("place", F.row_number().over(Window.partitionBy("d", *parents).orderBy(turned, own.asc())))
    if trim is None:
        return placed
    kept = placed.where(F.col("place") <= trim)
    for k in range(1, len(groups)):
        up = kept.where(F.col("d") == k).select(*[F.col(g).alias(f"_{g}") for g in groups[:k]])
        on = F.lit(True)
        for g in groups[:k]:
            on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
        kept = kept.where(F.col("d") <= k).unionByName(kept.where(F.col("d") > k).join(up, on, "left_semi"))
    return kept


def tree(result: DataFrame, groups: list[str], **options) -> dict:
    """{'_': [{'g': key, 'c': [..], '_': [..]}]}; empty numbers are 0. Collects the result, so trim large ones."""
    placed = arrange(result, groups, **options)
    values = [c for c in result.columns if c not in ("d", *groups)]
    numeric = {c for c in values if result.schema[c].dataType.simpleString() in ("bigint", "int", "double")}
    root: dict = {"_": []}
    nodes: dict[tuple, dict] = {(): root}
    for r in sorted(placed.collect(), key=lambda r: (r["d"], r["place"])):
        path = tuple(r[g] for g in groups[: r["d"]])
        node = {"g": path[-1], "c": [0 if r[c] is None and c in numeric else r[c] for c in values]}
        nodes[path] = node
        nodes[path[:-1]].setdefault("_", []).append(node)
    return root


def customer_json(events: DataFrame, customers: DataFrame | None, properties: list[str], customer_properties: list[str]) -> DataFrame:
    """(id, json): each customer's properties and events, in order, nulls left out."""
    from cohortlake.functions.scalars import iso8601

    row = F.struct("stamp", "z", "seq", F.struct("stamp", iso8601(F.col("stamp")).alias("stamp_iso"), "event", F.struct(*properties).alias("_")).alias("e"))
    told = events.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["e"]).alias("events"))
    if customers is not None and customer_properties:
        told = told.join(customers, "id", "left").withColumn("properties", F.struct(*customer_properties))
    else:
        told = told.withColumn("properties", F.create_map().cast("map<string,string>"))
    return told.select("id", F.to_json(F.struct("id", "properties", "events")).alias("json"))
