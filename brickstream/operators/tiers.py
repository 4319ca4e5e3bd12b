"""Group statistics on several tiers in one pass, and lookups that fall back from tier to tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def tiered_stats(rows: DataFrame, tiers: Sequence[str], value: str, min_group: int = 5, shares: Sequence[float] = (0.2,)) -> DataFrame:
    """Statistics of ``value`` for every prefix of ``tiers`` with at least ``min_group`` values.

    One grouping-sets aggregation; rolled-up columns hold ``all``, told apart from a real
    null by the grouping id.  Null values count nowhere; std is that of the population,
    percentiles are interpolated.
    """
    sets = [tuple(tiers[:k]) for k in range(len(tiers), 0, -1)]
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max")]
    aggs += [F.percentile(v, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares]
    named = [F.when(F.grouping(t) == 1, F.lit(ALL)).otherwise(F.coalesce(F.col(t).cast("string"), F.lit("unknown"))).alias(f"{t}_") for t in tiers]
    out = rows.filter(v.isNotNull()).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(t) for t in tiers]).agg(*named, *aggs)
    keep = ["mean", "median", "std", "count", "min", "max", *[f"p{round(s * 100)}" for s in shares]]
    return out.filter(F.col("count") >= min_group).select(*[F.col(f"{t}_").alias(t) for t in tiers], *keep)


def tier_lookup(rows: DataFrame, stats: DataFrame, tiers: Sequence[str], fields: Sequence[str], usable: Column | None = None, depth: int | None = None) -> DataFrame:
    """``rows`` with the ``fields`` of the finest tier that has statistics, and ``basis`` (its number from 0).

    ``depth`` tiers are tried, from the finest; a tier whose statistics aren't ``usable``
    is passed over.  One left join per tier; the statistics are small and have one row per
    group, so adaptive execution broadcasts them where their measured size allows it.
    """
    depth = depth or len(tiers)
    out = rows
    for k in range(depth):
        known = tiers[: len(tiers) - k]
        part = stats
        for t in tiers[len(known) :]:
            part = part.filter(F.col(t) == ALL)
        for t in known:
            part = part.filter(F.col(t) != ALL)
        if usable is not None:
            part = part.filter(usable)
        part = part.select(*[F.col(t).alias(f"_{k}_{t}") for t in known], F.struct(*fields).alias(f"_t{k}"))
        on = [F.coalesce(F.col(t).cast("string"), F.lit("unknown")) == F.col(f"_{k}_{t}") for t in known]
        out = out.join(part, on, "left").drop(*[f"_{k}_{t}" for t in known])
    hit = F.coalesce(*[F.col(f"_t{k}") for k in range(depth)])
    basis = F.coalesce(*[F.when(F.col(f"_t{k}").isNotNull(), F.lit(k)) for k in range(depth)])
    return out.withColumn("_hit", hit).withColumn("basis", basis).select(*rows.columns, *[F.col(f"_hit.{f}").alias(f) for f in fields], "basis")


def anomalies(rows: DataFrame, stats: DataFrame, tiers: Sequence[str], value: str, z_limit: float, share_of_mean: float, depth: int = 2) -> DataFrame:
    """Rows whose value lies ``z_limit`` deviations below the mean of their tier and under a share of it.

    A tier without deviation gives nothing and isn't passed over.
    """
    found = tier_lookup(rows, stats, tiers, ["mean", "std", "median", "count"], depth=depth)
    z = (F.col(value) - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    return found.withColumn("zscore", z).filter((F.col("zscore") < z_limit) & (F.col(value) < share_of_mean * F.col("mean")))


def prefer(stats: DataFrame, key: str, kind: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key the statistics of the first kind in ``order`` that it has, with that kind as ``basis``."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(order)])
    ranked = stats.withColumn("_rank", rank).filter("_rank is not null")
    return ranked.groupBy(key).agg(F.min_by(F.struct(*fields, F.col(kind).alias("basis")), "_rank").alias("_s")).select(key, *[f"_s.{f}" for f in fields], "_s.basis")


def grouped_or_all(rows: DataFrame, key: str, special: Column, value: Column, least: int) -> DataFrame:
    """Median of the special rows of each key if there are enough of them, else of all its rows."""
    return rows.groupBy(key).agg(
        F.when(F.count(F.when(special, value)) >= least, F.median(F.when(special, value))).otherwise(F.median(value)).alias("median"), F.count(value).alias("count")
    )
