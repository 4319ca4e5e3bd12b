"""Queries of the general training-data problems (snapshot changes, attribute history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickstream.operators import history, snapshots
from brickstream.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.listing_changes(table(spark, d, "listing_snapshots"), table(spark, d, "listings")).drop("changed_fields")


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field changed, per date and source."""
    rows = snapshots.listing_changes(table(spark, d, "listing_snapshots"), table(spark, d, "listings"))
    return rows.select("snapshot_date", "source", F.explode("changed_fields").alias("field")).groupBy("snapshot_date", "source", "field").agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return history.price_periods(table(spark, d, "price_history"), table(spark, d, "listings"))


QUERIES = {f.__name__: f for f in (p6_found, p6_fields, p7_found)}

_CHANGED = """
    WITH k AS (
        SELECT snapshot_date AS d, source AS s, lower(trim(source_id)) AS i,
               arg_max(struct_pack(p := round(price_eur, 2), a := CASE WHEN isnan(area_sqm) THEN NULL ELSE area_sqm END,
                                   x := is_active, y := is_sold), loaded_at) AS v
        FROM listing_snapshots WHERE snapshot_date IS NOT NULL AND source IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL),
    dates AS (SELECT s, d, lag(d) OVER (PARTITION BY s ORDER BY d) AS before FROM (SELECT DISTINCT s, d FROM k)),
    now AS (SELECT k.*, before FROM k JOIN dates USING (s, d) WHERE before IS NOT NULL),
    pairs AS (
        SELECT now.d, now.s, now.i, p.i IS NULL AS is_new, now.v AS v, p.v AS w
        FROM now LEFT JOIN k p ON p.s = now.s AND p.i = now.i AND p.d = now.before),
    gone AS (
        SELECT dates.d, dates.s, p.i FROM dates JOIN k p ON p.s = dates.s AND p.d = dates.before
        LEFT JOIN k n ON n.s = p.s AND n.i = p.i AND n.d = dates.d WHERE n.i IS NULL)"""

ORACLES = {
    "p6_found": _CHANGED
    + """
    SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, s AS source, i AS source_id, CASE WHEN is_new THEN 'added' ELSE 'changed' END AS change_kind
    FROM pairs WHERE is_new OR v.p IS DISTINCT FROM w.p OR v.a IS DISTINCT FROM w.a OR v.x IS DISTINCT FROM w.x OR v.y IS DISTINCT FROM w.y
    UNION ALL SELECT strftime(d, '%Y-%m-%d'), s, i, 'removed' FROM gone""",
    "p6_fields": _CHANGED
    + """,
    f AS (
        SELECT d, s, 'price_eur' AS field FROM pairs WHERE NOT is_new AND v.p IS DISTINCT FROM w.p
        UNION ALL SELECT d, s, 'area_sqm' FROM pairs WHERE NOT is_new AND v.a IS DISTINCT FROM w.a
        UNION ALL SELECT d, s, 'is_active' FROM pairs WHERE NOT is_new AND v.x IS DISTINCT FROM w.x
        UNION ALL SELECT d, s, 'is_sold' FROM pairs WHERE NOT is_new AND v.y IS DISTINCT FROM w.y)
    SELECT strftime(d, '%Y-%m-%d') AS snapshot_date, s AS source, field, count(*) AS n FROM f GROUP BY ALL""",
    "p7_found": """
    WITH e AS (
        SELECT listing_id AS k, recorded_at AS t, id, price_eur AS p FROM price_history
        UNION ALL SELECT id, first_seen, -1, first_price_eur FROM listings),
    f AS (SELECT k, t, id, CAST(round(p * 100) AS BIGINT) AS c FROM e WHERE p IS NOT NULL AND NOT isnan(p) AND round(p * 100) <> 0 AND t IS NOT NULL AND k IS NOT NULL),
    g AS (SELECT k, t, arg_max(c, id) AS c FROM f GROUP BY k, t),
    h AS (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS before FROM g)
    SELECT k AS listing_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS valid_from,
           coalesce(strftime(lead(t) OVER (PARTITION BY k ORDER BY t), '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS valid_to
    FROM h WHERE before IS NULL OR before <> c""",
}
