"""Problem 3: the best representative of each duplicate group.

Method: records are ranked by trust, completeness and recency with a deterministic
tie-break, and the top record of each group is kept by a window ordering.  ``rank = 1``
lets Spark limit each group before the shuffle, so a group that holds a third of all rows
sends a few rows per task.  ``merged`` builds a record field by field in the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickstream.operators.components import connected_components

FIELDS = ("rooms", "floor", "total_floors", "year_built", "construction_type", "seller_type", "address", "contact_phone", "contact_email", "description_full")
# What stands in a field whose value isn't known.
PLACEHOLDERS = ("", "-", "--", "—", "–", "?", "??", "???", ".", "n/a", "na", "няма", "няма данни", "няма информация", "скрит", "неизвестно", "неизвестен", "не е посочено", "none", "null", "nan", "unknown", "hidden", "xxx", "0")


def filled(field: str, kind: str) -> Column:
    """Whether a field holds a value: not null, NaN, zero, blank or a placeholder."""
    value = F.col(field)
    if kind == "string":
        return F.coalesce(~F.lower(F.trim(F.regexp_replace(value, "[\\s\\u00A0]+", " "))).isin(*PLACEHOLDERS), F.lit(False))
    if kind in ("double", "float"):
        return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))
    if kind == "boolean":
        return value.isNotNull()
    return F.coalesce(value != 0, F.lit(False))


def completeness(rows: DataFrame, fields: Sequence[str] = FIELDS) -> Column:
    """Number of filled fields among ``fields`` (absent columns count as not filled)."""
    kinds = dict(rows.dtypes)
    return sum((filled(f, kinds[f]).cast("int") for f in fields if f in kinds), F.lit(0))


def property_groups(rows: DataFrame, row_id: str = "id") -> DataFrame:
    """``row_id, group, canonical_id``: the property each row belongs to.

    Rows belong together if they share a canonical id, or one's ``duplicate_of`` is the
    other's ``source_id``, also through others.  A shared canonical id is itself the node
    of the graph, so its group needs no edges; only links between different nodes do.
    Links to nothing and null, blank or placeholder ids tie nothing.
    """
    key = F.when(filled("canonical_id", "string"), F.trim("canonical_id"))
    nodes = rows.select(
        F.col(row_id).alias("_id"),
        F.coalesce(F.concat(F.lit("c:"), key), F.concat(F.lit("i:"), F.col(row_id).cast("string"))).alias("_node"),
        F.trim("source_id").alias("_source_id"),
        F.when(filled("duplicate_of", "string"), F.trim("duplicate_of")).alias("_to"),
    )
    targets = nodes.filter("_source_id is not null").select(F.col("_source_id").alias("_to"), F.col("_node").alias("_other")).distinct()
    edges = nodes.filter("_to is not null").select("_node", "_to").distinct().join(targets, "_to").filter("_node != _other")
    linked = connected_components(edges, "_node", "_other")
    grouped = nodes.join(linked, nodes["_node"] == linked["node"], "left").select("_id", F.coalesce("component", "_node").alias("group"), "_node")
    # nodes with a canonical id sort before those without, so the smallest node of a group carries one if any does
    return grouped.select(F.col("_id").alias(row_id), "group", F.when(F.col("group").startswith("c:"), F.substring("group", 3, 1000)).alias("canonical_id"))


def ranked(rows: DataFrame, trust: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``rows`` with ``_trust`` (1 is best; unknown sources last) and ``_filled``."""
    known = trust.select(F.col("source").alias("_source"), F.col("trust_rank").cast("long").alias("_rank")).groupBy("_source").agg(F.min("_rank").alias("_rank"))
    return rows.withColumn("_filled", completeness(rows, fields)).join(known, F.col("source") == F.col("_source"), "left").withColumn("_trust", F.coalesce("_rank", F.lit(2**31))).drop("_source", "_rank")


def survivors(rows: DataFrame, trust: DataFrame, row_id: str = "id") -> DataFrame:
    """``canonical_id, survivor_id`` of each property with two or more rows.

    The survivor is the row first in trust, then in filled fields, then in ``last_seen``
    (null last), then with the smallest id.  A group without any canonical id comes out
    with null; an empty table gives no row.
    """
    order = [F.col("_trust").asc(), F.col("_filled").desc(), F.col("last_seen").desc_nulls_last(), F.col(row_id).asc()]
    lean = ranked(rows, trust).select(row_id, "_trust", "_filled", "last_seen")
    groups = property_groups(rows, row_id)
    many = groups.groupBy("group", "canonical_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("group", "canonical_id")
    members = groups.select(row_id, "group").join(many.select("group"), "group", "left_semi").join(lean, row_id)
    top = members.withColumn("_place", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter("_place = 1")
    return top.join(many, "group").select("canonical_id", F.col(row_id).alias("survivor_id"))


def merged(rows: DataFrame, trust: DataFrame, fields: Sequence[str] = FIELDS, row_id: str = "id") -> DataFrame:
    """``group, n_members`` and each field's filled value from the best member that has one.

    Built by partial aggregates only: no group is ever collected in one place.
    """
    kinds = dict(rows.dtypes)
    order = F.struct((-F.col("_trust")).alias("t"), F.col("_filled").alias("f"), F.coalesce(F.col("last_seen").cast("string"), F.lit("")).alias("s"), (-F.col(row_id)).alias("i"))
    groups = property_groups(rows, row_id).select(F.col(row_id).alias("_id"), F.col("group").alias("_group"))
    sizes = groups.groupBy(F.col("_group").alias("_g")).agg(F.count("*").alias("_n"))
    sized = groups.join(sizes, F.col("_group") == F.col("_g")).select("_id", "_group", "_n")
    full = ranked(rows, trust, fields).select(row_id, *fields, "_trust", "_filled", "last_seen").join(sized, F.col(row_id) == F.col("_id"))
    known = [F.when(filled(f, kinds[f]), F.col(f)).alias(f) for f in fields]
    # a record without duplicates is its own best, so its long texts move no further
    alone = full.filter("_n = 1").select(F.col("_group").alias("group"), F.col("_n").alias("n_members"), *known)
    best = [F.max_by(F.col(f), F.when(filled(f, kinds[f]), order)).alias(f) for f in fields]
    several = full.filter("_n > 1").groupBy(F.col("_group").alias("group")).agg(F.count("*").alias("n_members"), *best)
    return alone.unionByName(several)
