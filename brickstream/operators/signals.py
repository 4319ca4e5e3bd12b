"""Penalty signals with evidence, counters per key, and checks with a colour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flagged(signals: Sequence[tuple[str, int, Column]]) -> Column:
    """Array of ``signal, penalty`` of the signals whose condition holds, in the given order."""
    parts = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("signal"), F.lit(penalty).alias("penalty"))) for name, penalty, c in signals]
    return F.array_compact(F.array(*parts))


def penalty_score(flags: Column, start: int = 100) -> Column:
    return F.greatest(F.lit(0), F.lit(start) - F.aggregate(flags, F.lit(0), lambda a, x: a + x["penalty"]))


def reposts(rows: DataFrame, row_id: str, keys: Sequence[str], active: Column, first_seen: str, source_id: str) -> DataFrame:
    """Active rows that an older inactive row with the same keys precedes.

    The range condition needs only the earliest inactive first sight of each key and of
    each source id, so no pairs are built: one aggregate and one join.  Joined by sorting,
    as the keys grow with the rows.
    """
    null_safe = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])
    keyed = rows.withColumn("_k", null_safe).withColumn("_a", active)
    old = keyed.filter(~F.coalesce("_a", F.lit(False))).groupBy("_k", source_id).agg(F.min(F.coalesce(F.col(first_seen), F.lit("1900-01-01").cast("timestamp_ntz"))).alias("_t"))
    # the two earliest source ids of a key decide for every row, whichever its own id is
    one = old.groupBy("_k").agg(F.min(F.struct("_t", source_id)).alias("_o"))
    both = old.join(one.hint("merge"), "_k").groupBy("_k", "_o").agg(F.min(F.when(F.col(source_id) != F.col(f"_o.{source_id}"), F.col("_t"))).alias("_t2"))
    earliest = F.when(F.col(source_id) == F.col(f"_o.{source_id}"), F.col("_t2")).otherwise(F.col("_o._t"))
    return keyed.filter("_a").join(both.hint("merge"), "_k").filter(earliest < F.col(first_seen)).select(row_id)


def reused(rows: DataFrame, row_id: str, hash_column: str, near: DataFrame, who: str, place: str | None = None, price: str | None = None, delta: float = 0.25) -> DataFrame:
    """``row_id`` of rows whose hash, or one near it, a row of another identity has too.

    ``near`` has ``hash_a, hash_b``; equal hashes count as near.  With ``place`` and ``price``
    the other row must differ materially: in place (both filled), or in price (both filled)
    by ``delta`` of the higher one.  A few extremes per hash decide, so no pairs of rows
    are built and a hash that many rows share costs what its rows do.  Hashes are joined by
    sorting, never broadcast, as they grow with the rows.
    """
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    cents = F.when(F.col(price) > 0, F.col(price)) if price else F.lit(None).cast("double")
    mine = rows.filter(F.col(hash_column).rlike("^[0-9a-fA-F]{16}$")).select(
        F.col(row_id).alias("_id"), F.lower(F.col(hash_column)).alias("_h"), F.coalesce(F.col(who), F.lit("")).alias("_w"), (filled(place) if place else F.lit("")).alias("_l"), cents.alias("_p")
    )
    # false where null: what is missing differs from nothing
    unlike = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    if place is None:
        known = mine.groupBy("_h").agg(F.min("_w").alias("_w1"), F.max("_w").alias("_w2"))
        differs = unlike("_w1", "_w") | unlike("_w2", "_w")
    else:
        cells = mine.groupBy("_h", "_w", "_l").agg(F.max("_p").alias("_hi"), F.min("_p").alias("_lo"))
        placed, priced = F.col("_l").isNotNull(), F.col("_hi").isNotNull()
        one = cells.groupBy("_h").agg(
            F.min(F.when(placed, F.struct("_l", "_w"))).alias("_one"), F.max(F.when(priced, F.struct("_hi", "_w"))).alias("_top"), F.min(F.when(priced, F.struct("_lo", "_w"))).alias("_low")
        )
        # the extremes of two identities decide for every row, whichever its own identity is; so do one placed
        # cell, the places of other identities than its own and the identities in other places than its own
        others, away = placed & unlike("_w", "_one._w"), placed & unlike("_l", "_one._l")
        known = (
            cells.join(one.hint("merge"), "_h")
            .groupBy("_h", "_one", "_top", "_low")
            .agg(
                F.max(F.when(unlike("_w", "_top._w"), F.col("_hi"))).alias("_hi2"),
                F.min(F.when(unlike("_w", "_low._w"), F.col("_lo"))).alias("_lo2"),
                *[f(F.when(others, F.col("_l"))).alias(f"_l{i}") for i, f in ((1, F.min), (2, F.max))],
                *[f(F.when(away, F.col("_w"))).alias(f"_w{i}") for i, f in ((1, F.min), (2, F.max))],
            )
        )
        elsewhere = (
            F.when(unlike("_w", "_one._w") & unlike("_l", "_one._l"), True)
            .when(F.col("_w") == F.col("_one._w"), unlike("_l1", "_l") | unlike("_l2", "_l"))
            .otherwise(placed & (unlike("_w1", "_w") | unlike("_w2", "_w")))
        )
        high, low = (F.when(unlike("_w", f"{top}._w"), F.col(f"{top}.{end}")).otherwise(F.col(f"{end}2")) for top, end in (("_top", "_hi"), ("_low", "_lo")))
        dearer, cheaper = (high - F.col("_p")) / high >= delta, (F.col("_p") - low) / F.col("_p") >= delta
        differs = elsewhere | F.coalesce(dearer, F.lit(False)) | F.coalesce(cheaper, F.lit(False))
    ways = F.array(*[F.struct(F.col(a).alias("_h"), F.col(b).alias("_g")) for a, b in (("hash_a", "hash_b"), ("hash_b", "hash_a"))])
    around = near.select(F.inline(ways))
    asked = known.unionByName(around.join(known.withColumnRenamed("_h", "_g").hint("merge"), "_g").drop("_g"))
    return mine.join(asked.hint("merge"), "_h").filter(differs).select(F.col("_id").alias(row_id)).distinct()


def counters(rows: DataFrame, key: str, counts: Mapping[str, Column]) -> DataFrame:
    """Conditional counts per key, keys without any left out."""
    out = rows.groupBy(key).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])
    any_ = F.lit(False)
    for name in counts:
        any_ = any_ | (F.col(name) > 0)
    return out.filter(any_)


def coloured(value: Column, amber: float, red: float, above: bool = True) -> Column:
    """``red``, ``amber`` or ``green`` by two limits; null is ``amber``."""
    over = (lambda x: value > x) if above else (lambda x: value < x)
    return F.when(value.isNull(), "amber").when(over(red), "red").when(over(amber), "amber").otherwise("green")


def worst(checks: DataFrame, status: str = "status") -> DataFrame:
    """One row: the worst colour of all checks."""
    rank = F.when(F.col(status) == "red", 2).when(F.col(status) == "amber", 1).otherwise(0)
    return checks.agg(F.element_at(F.array(F.lit("green"), F.lit("amber"), F.lit("red")), F.coalesce(F.max(rank), F.lit(0)) + 1).alias(status), F.count("*").alias("checks"))
