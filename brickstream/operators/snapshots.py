"""Problem 6: what changed between full snapshots of a table.

Method: every snapshot row is unpivoted into cells (key, field, value) and one marker of
the key's presence.  A cell counts +1 at its own date and -1 at the next date on which its
source delivered; cells whose sum isn't zero are the differences, and they say whether a
key was added, removed or changed, and in which fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRESENT = "\u0001present"
NULL_CELL = "\u0001null"


def spelling(key: Column) -> Column:
    """Key without blanks around it, in lower case: one spelling for each."""
    return F.lower(F.trim(F.regexp_replace(key, "^[\\s\\u00A0]+|[\\s\\u00A0]+$", "")))


def last_loaded(rows: DataFrame, key: Sequence[str], loaded: str, values: Sequence[str]) -> DataFrame:
    """One row of each key: the one loaded last (ties: the greatest values, so it is repeatable).

    A maximum of structs, combined before the shuffle; a key delivered very often costs little.
    """
    top = F.max(F.struct(F.col(loaded).isNotNull().alias("_has"), F.col(loaded).alias("_at"), *[F.col(v) for v in values])).alias("_top")
    return rows.groupBy(*key).agg(top).select(*key, *[F.col(f"_top.{v}").alias(v) for v in values])


def changes(rows: DataFrame, source: str, key: str, date: str, loaded: str, fields: Mapping[str, Column]) -> DataFrame:
    """``date, source, key, change_kind, changed_fields`` between consecutive snapshots of each source.

    ``fields`` gives the compared value of each field as a string expression (null differs
    from every value).  Consecutive are the dates on which a source has rows at all; its
    first snapshot gives nothing.  Rows whose source, key or date is null are left out, as
    they name no record.  An empty table gives an empty result.
    """
    keyed = rows.select(
        F.col(date).alias("_date"), F.col(source).alias("_source"), spelling(F.col(key)).alias("_key"), F.col(loaded).alias("_loaded"), *[v.alias(f) for f, v in fields.items()]
    ).filter("_date is not null and _source is not null and _key is not null")
    # one row for each source and date: a few hundred at any number of records
    dates = keyed.select("_source", "_date").distinct()
    calendar = dates.withColumn("_next", F.lead("_date").over(Window.partitionBy("_source").orderBy("_date")))
    first = dates.groupBy("_source").agg(F.min("_date").alias("_first"))
    whole = last_loaded(keyed, ["_source", "_key", "_date"], "_loaded", list(fields))
    cells = F.array(
        F.struct(F.lit(PRESENT).alias("field"), F.lit("").alias("value")),
        *[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(NULL_CELL)).alias("value")) for f in fields],
    )
    signed = (
        whole.join(calendar, ["_source", "_date"])
        .withColumn("_cells", cells)
        # from here on everything is about one key: one shuffle by the key serves both sums
        .repartition("_source", "_key")
        .select("_source", "_key", F.explode(F.array(F.struct(F.col("_date").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")))).alias("_s"), "_cells")
        .filter("_s.at is not null")
        .select("_source", "_key", F.col("_s.at").alias("_at"), F.col("_s.sign").alias("_sign"), F.explode("_cells").alias("_cell"))
        .groupBy("_source", "_key", "_at", "_cell.field", "_cell.value")
        .agg(F.sum("_sign").alias("_sum"))
        .filter("_sum != 0")
    )
    marker = F.max(F.when(F.col("field") == PRESENT, F.col("_sum")))
    judged = signed.groupBy("_source", "_key", "_at").agg(
        marker.alias("_marker"), F.array_sort(F.collect_set(F.when(F.col("field") != PRESENT, F.col("field")))).alias("changed_fields")
    )
    return (
        judged.join(first, "_source")
        .filter("_at > _first")
        .select(
            F.col("_at").alias(date),
            F.col("_source").alias(source),
            F.col("_key").alias(key),
            F.when(F.col("_marker") == 1, "added").when(F.col("_marker") == -1, "removed").otherwise("changed").alias("change_kind"),
            F.when(F.col("_marker").isNull(), F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


def cents(amount: Column) -> Column:
    """Amount to the cent as text; null and NaN are null."""
    return F.when(~F.isnan(amount), F.round(amount, 2).cast("decimal(20,2)").cast("string"))


def listing_changes(snapshots: DataFrame, listings: DataFrame) -> DataFrame:
    """Changes of the weekly listing snapshots, with source ids as they are written in ``listings``.

    Only changed records are looked up; one that ``listings`` doesn't have keeps its
    normalised spelling.
    """
    plain = F.when(~F.isnan("area_sqm"), F.col("area_sqm").cast("string"))
    fields = {"price_eur": cents(F.col("price_eur")), "area_sqm": plain, "is_active": F.col("is_active").cast("string"), "is_sold": F.col("is_sold").cast("string")}
    found = changes(snapshots, "source", "source_id", "snapshot_date", "loaded_at", fields)
    names = listings.select(F.col("source"), F.col("source_id").alias("_written"), spelling(F.col("source_id")).alias("source_id")).groupBy("source", "source_id").agg(F.min("_written").alias("_written"))
    return found.join(names, ["source", "source_id"], "left").select(
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "source", F.coalesce("_written", "source_id").alias("source_id"), "change_kind", "changed_fields"
    )
