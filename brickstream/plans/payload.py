"""Nested documents for publication, built in the JVM from aggregated children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.functions import scalars as S

PRIVATE = ("contact_phone", "contact_email", "seller_name")  # never part of a public document


def price_points(prices: DataFrame) -> DataFrame:
    """``id, price_history``: at least two points in order; every child is aggregated once."""
    point = F.struct(F.date_format("recorded_at", "yyyy-MM-dd").alias("date"), F.col("price").alias("price_eur"))
    return prices.groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("price_history")).filter(F.size("price_history") > 1)


def links(rows: DataFrame) -> DataFrame:
    """``canonical_id, cross_source_links`` sorted by source."""
    return rows.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("source", "url"))).alias("cross_source_links"))


def trap_flags(extract: Column, hard: tuple[str, ...]) -> Column:
    """Names of the keys of a JSON object that are true, in the given order."""
    return F.array_compact(F.array(*[F.when(F.lower(F.get_json_object(extract, f"$.{k}")) == "true", F.lit(k)) for k in hard]))


def listing_documents(listings: DataFrame, history: DataFrame, cross_links: DataFrame, zscores: DataFrame, columns: list[str]) -> DataFrame:
    """One document per listing: its columns without private ones, history, links and z-score."""
    public = [c for c in columns if c not in PRIVATE]
    rows = listings.select(*public, *[c for c in ("canonical_id",) if c not in public])
    rows = rows.join(history, "id", "left").join(cross_links, "canonical_id", "left").join(zscores.select(F.col("listing_id").alias("id"), "zscore"), "id", "left")
    if "exposure" in public:
        rows = rows.withColumn("exposure", S.json_list(F.col("exposure")))
    return rows


def market_documents(places: DataFrame, history: DataFrame, rents: DataFrame, days: DataFrame, key: str = "neighborhood") -> DataFrame:
    """One row per place with its history nested; every part is joined from the left."""
    nested = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.date_format("snapshot_date", "yyyy-MM-dd").alias("date"), "median_price_per_sqm", "listing_count"))).alias("history"))
    return places.join(nested, key, "left").join(rents.filter("bucket = 'all'").select(key, F.col("rent").alias("median_rent_per_sqm")), key, "left").join(days.select(key, F.col("median").alias("median_days")), key, "left")


def contact_documents(ranked: DataFrame, contacts: DataFrame, keep: int = 500) -> DataFrame:
    """Contacts of the ``keep`` best deals that have a channel, best first."""
    with_channel = contacts.filter("phone is not null or email is not null")
    return ranked.join(with_channel, "id").orderBy(F.desc("savings_pct"), "id").limit(keep).select("id", "phone", "email")
