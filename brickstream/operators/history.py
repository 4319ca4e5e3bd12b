"""Problem 7: the history of changing entity attributes.

Method: checkpoint-delta storage.  Per entity and period one full version is stored, the
checkpoint; every later change of the period is stored as a patch of the attributes that
changed.  Validity rows come from folding the patches forward from the nearest checkpoint.

Every window runs within one entity and one period, so an entity that holds a third of all
rows is spread over its periods; what passes from one period to the next goes through a
summary of one row per entity and period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 00:00:00"


def observed(events: DataFrame, key: str, at: str, order: Column, attributes: Sequence[str]) -> DataFrame:
    """``_key, _at`` and the attributes: of several events at one time the greatest ``order`` counts.

    Events without key or time are left out.  Combined before the shuffle.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    top = F.max(F.struct(order.alias("_order"), *[F.col(a) for a in attributes])).alias("_top")
    return rows.groupBy(F.col(key).alias("_key"), F.col(at).alias("_at")).agg(top).select("_key", "_at", *[F.col(f"_top.{a}").alias(a) for a in attributes])


def _state(attributes: Sequence[str]) -> Column:
    return F.struct(*[F.col(a) for a in attributes])


def store(rows: DataFrame, attributes: Sequence[str], period: str = "month") -> DataFrame:
    """``_key, _period, _at, _kind, _changed`` and the attributes, as they are stored.

    ``_kind`` is ``full`` (the first change of a period, with every attribute) or ``patch``
    (only the attributes named in ``_changed``; the others are null).  An observation that
    changes nothing is not stored; null is a value like any other.
    """
    rows = rows.withColumn("_period", F.date_trunc(period, F.col("_at")).cast("timestamp_ntz")).withColumn("_state", _state(attributes))
    inside = Window.partitionBy("_key", "_period").orderBy("_at")
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_before", F.lag("_state").over(inside))
    ends = rows.groupBy("_key", "_period").agg(F.max_by("_state", "_at").alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy("_key").orderBy("_period"))).select("_key", "_period", "_carried")
    moved = (
        rows.join(carried, ["_key", "_period"])
        .withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
        .filter(~F.col("_state").eqNullSafe(F.col("_before")))
    )
    fresh = moved.withColumn("_kind", F.when(F.row_number().over(inside) == 1, "full").otherwise("patch"))
    changed = F.array_compact(F.array(*[F.when((F.col("_kind") == "full") | ~F.col(a).eqNullSafe(F.col(f"_before.{a}")), F.lit(a)) for a in attributes]))
    stored = fresh.withColumn("_changed", changed)
    return stored.select("_key", "_period", "_at", "_kind", "_changed", *[F.when(F.array_contains("_changed", a), F.col(a)).alias(a) for a in attributes])


def validity(stored: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """``_key, valid_from, valid_to`` and the attributes of each version; the last one is open (null)."""
    folded = Window.partitionBy("_key", "_period").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("_key", "_period").orderBy("_at")
    # wrapped in a struct, so that a change to null is kept and not skipped
    wrapped = {a: F.last(F.when(F.array_contains("_changed", a), F.struct(F.col(a).alias("v"))), ignorenulls=True).over(folded)["v"] for a in attributes}
    rows = stored.select("_key", "_period", "_at", F.lead("_at").over(inside).alias("_next"), *[c.alias(a) for a, c in wrapped.items()])
    starts = stored.groupBy("_key", "_period").agg(F.min("_at").alias("_start"))
    following = starts.withColumn("_following", F.lead("_start").over(Window.partitionBy("_key").orderBy("_period"))).drop("_start")
    return rows.join(following, ["_key", "_period"]).select("_key", F.col("_at").alias("valid_from"), F.coalesce("_next", "_following").alias("valid_to"), *attributes)


def as_of(stored: DataFrame, attributes: Sequence[str], moment: Column) -> DataFrame:
    """The version of each entity that was valid at ``moment``, from its nearest checkpoint only."""
    before = stored.filter(F.col("_at") <= moment)
    nearest = before.groupBy("_key").agg(F.max("_period").alias("_period"))
    part = before.join(nearest, ["_key", "_period"])
    return part.groupBy("_key").agg(*[F.max_by(F.struct(F.col(a).alias("v")), F.when(F.array_contains("_changed", a), F.col("_at")))["v"].alias(a) for a in attributes])


def price_events(price_history: DataFrame, listings: DataFrame) -> DataFrame:
    """``key, at, id, cents``: every price seen; null, NaN and zero prices are left out.

    The first price of a listing counts at ``first_seen``, behind a history row of the same time.
    """
    cents = lambda c: F.when(~F.isnan(c) & (c != 0), F.round(c * 100).cast("long"))
    seen = price_history.select(F.col("listing_id").alias("key"), F.col("recorded_at").alias("at"), F.col("id").alias("id"), cents(F.col("price_eur")).alias("cents"))
    first = listings.select(F.col("id").alias("key"), F.col("first_seen").alias("at"), F.lit(None).cast("long").alias("id"), cents(F.col("first_price_eur")).alias("cents"))
    return seen.unionByName(first).filter("cents is not null and cents != 0")


def price_periods(price_history: DataFrame, listings: DataFrame) -> DataFrame:
    """``listing_id, valid_from, valid_to`` of each period in which a listing had one price to the cent."""
    order = F.coalesce("id", F.lit(-(2**62)))
    events = observed(price_events(price_history, listings), "key", "at", order, ["cents"])
    rows = validity(store(events, ["cents"]), ["cents"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select(F.col("_key").alias("listing_id"), text(F.col("valid_from")).alias("valid_from"), F.coalesce(text(F.col("valid_to")), F.lit(FOREVER)).alias("valid_to"))
