"""Ordered operators: latest rows, runs, percentiles, as-of values, interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The fields of each key's last row, by a maximum of structs (combined before the shuffle)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_l")).select(key, *[f"_l.{f}" for f in fields])


def latest_values(rows: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Each field's newest value that isn't null, independently of the others."""
    return rows.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def collapse_runs(rows: DataFrame, key: str, order: Sequence[str], value: str, period: str | None = None) -> DataFrame:
    """Of consecutive rows with equal values of a key only the last one.

    With ``period`` (``month``, ``day``; the first of ``order`` is then a time) windows run
    within one key and period, and what follows a period comes from a summary of one row
    per key and period, so a key that holds very many rows is spread.
    """
    split = [] if period is None else ["_period"]
    if split:
        rows = rows.withColumn("_period", F.date_trunc(period, F.col(order[0])))
    w = Window.partitionBy(key, *split).orderBy(*order)
    out = rows.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(w))
    if split:
        firsts = rows.groupBy(key, "_period").agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
        after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(key).orderBy("_period"))).drop("_first")
        out = out.join(after, [key, "_period"], "left").withColumn("_next", F.coalesce("_next", "_after")).drop("_after")
    return out.filter(F.col("_next").isNull() | ~F.col("_next.v").eqNullSafe(F.col(value))).drop("_next", *split)


def rank_pct(rows: DataFrame, key: str, value: str, out: str, digits: int = 1) -> DataFrame:
    """Share of the key's rows with at most this value, in percent.

    Counted on distinct values: the window runs over one row per key and value, and its
    input is combined before the shuffle.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn(out, F.round(100 * F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy(key)), digits)).drop("_n")
    r = ranked.select(F.col(key).alias("_k"), F.col(value).alias("_v"), out)
    return rows.join(r, F.col(key).eqNullSafe(F.col("_k")) & (F.col(value) == F.col("_v")), "left").drop("_k", "_v")


def as_of(series: DataFrame, key: str, at: str, cutoff: Column, fields: Sequence[str]) -> DataFrame:
    """The fields of each key's last row at or before ``cutoff`` (one as-of point for all keys)."""
    return latest(series.filter(F.col(at) <= cutoff), key, [at], fields)


def trend(series: DataFrame, key: str, at: str, value: str, days: int) -> DataFrame:
    """Change from the last point at least ``days`` before a key's latest point to that one, in percent."""
    end = series.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max(at).alias("_end"))
    joined = series.filter(F.col(value).isNotNull()).join(end, key)
    before = F.col(at) <= F.col("_end") - F.expr(f"INTERVAL {days} DAYS")
    out = joined.groupBy(key).agg(F.max_by(value, at).alias("latest"), F.max_by(value, F.when(before, F.col(at))).alias("earlier"))
    return out.withColumn("trend_pct", F.round((F.col("latest") - F.col("earlier")) / F.nullif(F.col("earlier"), F.lit(0.0)) * 100, 2))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, fields: Sequence[str], period: str = "month") -> DataFrame:
    """``left`` with the fields of the last row of ``right`` at or before each row's time.

    Both sides are merged into one ordered stream per key and period, in which the last
    value is carried forward; what holds at a period's start comes from a summary of one
    row per key and period.  No range join, and a hot key is spread over its periods.
    """
    marked = lambda at: {"_at": F.col(at), "_period": F.date_trunc(period, F.col(at))}
    l = left.withColumns(marked(left_at)).withColumn("_side", F.lit(1))
    r = right.withColumns(marked(right_at)).select(key, "_at", "_period", F.lit(0).alias("_side"), F.struct(*fields).alias("_carry"))
    both = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(key, "_period").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(key, "_period").agg(F.max_by("_carry", F.when(F.col("_carry").isNotNull(), F.col("_at"))).alias("_end"))
    opening = ends.withColumn("_open", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    carried = both.withColumn("_carry", F.last("_carry", ignorenulls=True).over(inside)).filter("_side = 1").join(opening, [key, "_period"], "left")
    held = F.coalesce("_carry", "_open")
    return carried.withColumn("_held", held).select(*left.columns, *[F.col(f"_held.{f}").alias(f"{f}_asof") for f in fields])


def interleave(rows: DataFrame, lane: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Round robin over lanes: the first of each lane, then the second of each, up to ``limit``."""
    place = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    # only the first ``limit`` of a lane can come out, so each lane is cut before the shuffle
    return rows.withColumn("turn", place).filter(F.col("turn") <= limit).orderBy("turn", lane).limit(limit)


def shingles(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` words of a lower-case text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) >= size, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    # bound once: written out, the words would be found again for every run
    return F.transform(F.array(words), runs)[0]
