"""Duplicates by fingerprint: winner of each group, back-filled attributes, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nonempty(rows: DataFrame, field: str) -> Column:
    """Whether a field is filled: null, NaN, zero and blank are empty."""
    kind = dict(rows.dtypes)[field]
    value = F.col(field)
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind in ("double", "float"):
        return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))
    if kind == "boolean":
        return value.isNotNull()
    return F.coalesce(value != 0, F.lit(False))


def filled_count(rows: DataFrame, fields: Sequence[str]) -> Column:
    return sum((nonempty(rows, f).cast("int") for f in fields), F.lit(0))


def winners(rows: DataFrame, key: str, priority: str, filled: str, arrival: str) -> DataFrame:
    """``rows`` with ``is_winner``: the first of its key by priority, filled fields and arrival.

    Decided by a minimum of structs (combined before the shuffle) and a join back on the
    key, so no group is sorted in one task; adaptive execution splits a hot key's join.
    """
    order = F.struct(F.col(priority).alias("p"), (-F.col(filled)).alias("f"), F.col(arrival).alias("a"))
    best = rows.groupBy(key).agg(F.min(order).alias("_best"), F.count("*").alias("group_size"))
    return rows.join(best, key).withColumn("is_winner", order == F.col("_best")).drop("_best")


def backfilled(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key: each field's first filled value in the order of ``order``."""
    rank = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(F.col(f), F.when(nonempty(rows, f), rank)).alias(f) for f in fields])


def source_combinations(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Groups with more than one row, counted by the sorted combination of their sources."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources")).filter("n > 1")
    return groups.groupBy("sources").agg(F.count("*").alias("groups"), F.sum("n").alias("listings"))


def duplicate_totals(rows: DataFrame, key: str) -> DataFrame:
    """One row: listings, unique keys, keys with several rows, and the rows in them."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").alias("listings"), F.count("*").alias("unique_keys"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_duplicate_groups")
    )


def priorities(source: Column, table: Mapping[str, int], default: int = 99) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), source), F.lit(default))


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the window's group limit runs before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
