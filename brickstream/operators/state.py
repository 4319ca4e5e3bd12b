"""Keyed state in tables: upsert with history, deactivation, insert-if-absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, staged: DataFrame, keys: Sequence[str], scraped: Sequence[str], price: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """New table and history delta of a batch of records, by one full outer join on the keys.

    A known record takes the scraped fields; if its price differs, the old price goes to
    the history and ``price_changes`` grows.  A new one starts with its first price, zero
    changes and a history row.  What the batch doesn't hold stays as it was.
    """
    c, s = current.alias("c"), staged.alias("s")
    both = c.join(s, [F.col(f"c.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    is_old, is_staged = F.col(f"c.{keys[0]}").isNotNull(), F.col(f"s.{keys[0]}").isNotNull()
    moved = is_old & is_staged & ~F.col(f"c.{price}").eqNullSafe(F.col(f"s.{price}"))
    fields = {k: F.coalesce(F.col(f"s.{k}"), F.col(f"c.{k}")) for k in keys}
    fields |= {f: F.when(is_staged, F.col(f"s.{f}")).otherwise(F.col(f"c.{f}")) for f in scraped}
    fields |= {
        "first_price": F.when(is_old, F.col("c.first_price")).otherwise(F.col(f"s.{price}")),
        "price_changes": F.coalesce("c.price_changes", F.lit(0)) + moved.cast("int"),
        "first_seen": F.coalesce("c.first_seen", now),
        "last_seen": F.when(is_staged, now).otherwise(F.col("c.last_seen")),
        "is_active": F.when(is_staged, F.lit(True)).otherwise(F.col("c.is_active")),
    }
    table = both.select(*[v.alias(k) for k, v in fields.items()])
    delta = both.filter(moved | (~is_old & is_staged)).select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"c.{k}")).alias(k) for k in keys], F.when(moved, F.col(f"c.{price}")).otherwise(F.col(f"s.{price}")).alias(price), now.alias("recorded_at")
    )
    return table, delta


def missing(active: DataFrame, seen: DataFrame, source: str, key: str, least_ratio: float) -> DataFrame:
    """Active records of sources that were seen enough but don't hold them: to be deactivated.

    A source whose seen records are under ``least_ratio`` of its active ones is spared.
    """
    have = active.groupBy(source).agg(F.count("*").alias("_active"))
    got = seen.select(source, key).distinct().groupBy(source).agg(F.count("*").alias("_seen"))
    sound = have.join(got, source).filter(F.col("_seen") >= least_ratio * F.col("_active")).select(source)
    return active.join(sound, source, "left_semi").join(seen.select(source, key).distinct(), [source, key], "left_anti")


def absent(candidates: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that the ledger doesn't have yet, one per key."""
    return candidates.join(ledger.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))


def mark_sold(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Inactive, unsold records unseen for ``days`` become sold at their last sight."""
    due = ~F.coalesce("is_active", F.lit(False)) & ~F.coalesce("is_sold", F.lit(False)) & (F.col("last_seen") < now - F.expr(f"INTERVAL {days} DAYS"))
    lived = F.greatest(F.lit(0), F.timestamp_diff("DAY", F.col("first_seen"), F.col("last_seen"))).cast("int")
    return rows.withColumns(
        {
            "is_sold": F.when(due, F.lit(True)).otherwise(F.col("is_sold")),
            "sold_date": F.when(due, F.col("last_seen")).otherwise(F.col("sold_date")),
            "days_on_market": F.when(due, lived).otherwise(F.col("days_on_market")),
        }
    )


def overlay(old: DataFrame, new: DataFrame, key: str, replace: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """``old`` with the new record's fields: ``replace`` wherever it has a value, ``fill`` only where the old is empty."""
    n = new.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_n_{f}") for f in [*replace, *fill]])
    out = old.join(n, F.col(key) == F.col("_key"), "left")
    blank = lambda f: F.nullif(F.col(f).cast("string"), F.lit("")).isNull()
    changes = {f: F.coalesce(F.col(f"_n_{f}"), F.col(f)) for f in replace} | {f: F.when(blank(f), F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fill}
    return out.withColumns(changes).select(*old.columns)
