"""Queries of the analytics, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickstream.functions import scalars as S
from brickstream.operators import dedup, hedonic, neardup, series, signals, state, tiers
from brickstream.rules import DEFAULT as R
from brickstream.session import table, written

DOUBLES = ("price_eur", "area_sqm", "price_per_sqm_eur", "first_price_eur", "predicted_price_per_sqm", "residual_pct")
TIERS = ["neighborhood", "property_type", "construction_type"]
PRIORITY = {"kvadrato": 1, "domika": 2, "imotlist": 3, "balkandom": 4, "ceedom": 5, "olko": 6, "pazarko": 7, "aloriq": 8}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BASE = """
WITH base AS (SELECT * REPLACE (
    CASE WHEN isnan(price_eur) THEN NULL ELSE price_eur END AS price_eur, CASE WHEN isnan(area_sqm) THEN NULL ELSE area_sqm END AS area_sqm,
    CASE WHEN isnan(price_per_sqm_eur) THEN NULL ELSE price_per_sqm_eur END AS price_per_sqm_eur,
    CASE WHEN isnan(first_price_eur) THEN NULL ELSE first_price_eur END AS first_price_eur,
    CASE WHEN isnan(predicted_price_per_sqm) THEN NULL ELSE predicted_price_per_sqm END AS predicted_price_per_sqm,
    CASE WHEN isnan(residual_pct) THEN NULL ELSE residual_pct END AS residual_pct) FROM listings),
uniq AS (SELECT * FROM base WHERE NOT coalesce(is_duplicate, false)),
active AS (SELECT * FROM uniq WHERE is_active),
sale AS (SELECT * FROM active WHERE listing_kind = 'sale'),
sane AS (SELECT * FROM sale WHERE price_per_sqm_eur > 0 AND price_eur >= 5000
    AND (coalesce(property_type, '') NOT IN ('apartment', 'studio', 'maisonette') OR area_sqm BETWEEN 20 AND 500)),
al AS (SELECT * REPLACE (CASE WHEN isnan(zscore) THEN NULL ELSE zscore END AS zscore, CASE WHEN isnan(savings_eur) THEN NULL ELSE savings_eur END AS savings_eur,
    CASE WHEN isnan(savings_pct) THEN NULL ELSE savings_pct END AS savings_pct) FROM alerts),
ph AS (SELECT * FROM price_history WHERE price_eur IS NOT NULL AND NOT isnan(price_eur) AND price_eur > 0)
"""


def now() -> Column:
    return F.lit(R.now).cast("timestamp_ntz")


def query(sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _BASE + (sql if not sql.lstrip().startswith(",") else sql) if base else sql
        return f

    return register


def clean(df: DataFrame) -> DataFrame:
    """NaN as null in every double column."""
    return df.withColumns({c: S.number(F.col(c)) for c, t in df.dtypes if t == "double"})


def base(spark: SparkSession, d: str) -> DataFrame:
    return clean(table(spark, d, "listings"))


def uniq(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).filter(~F.coalesce("is_duplicate", F.lit(False)))


def active(spark: SparkSession, d: str) -> DataFrame:
    return uniq(spark, d).filter("is_active")


def sale(spark: SparkSession, d: str) -> DataFrame:
    return active(spark, d).filter("listing_kind = 'sale'")


def plausible() -> Column:
    """Only homes have bounds of area; a row of unknown type has none."""
    return ~F.coalesce("property_type", F.lit("")).isin(*R.apartment_like) | F.col("area_sqm").between(R.min_area, R.max_area)


def sane(spark: SparkSession, d: str) -> DataFrame:
    return sale(spark, d).filter((F.col("price_per_sqm_eur") > 0) & (F.col("price_eur") >= R.min_price) & plausible())


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return clean(table(spark, d, "alerts"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return clean(table(spark, d, "price_history")).filter("price_eur > 0")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stats(spark: SparkSession, d: str) -> DataFrame:
    return tiers.tiered_stats(sane(spark, d), TIERS, "price_per_sqm_eur", R.min_group)


_STATS = """,
stats AS (
    SELECT CASE WHEN grouping(neighborhood) = 1 THEN 'all' ELSE coalesce(neighborhood, 'unknown') END AS neighborhood,
           CASE WHEN grouping(property_type) = 1 THEN 'all' ELSE coalesce(property_type, 'unknown') END AS property_type,
           CASE WHEN grouping(construction_type) = 1 THEN 'all' ELSE coalesce(construction_type, 'unknown') END AS construction_type,
           avg(price_per_sqm_eur) AS mean, median(price_per_sqm_eur) AS median, stddev_pop(price_per_sqm_eur) AS std, count(price_per_sqm_eur) AS count,
           min(price_per_sqm_eur) AS min, max(price_per_sqm_eur) AS max, quantile_cont(price_per_sqm_eur, 0.2) AS p20
    FROM sane GROUP BY GROUPING SETS ((neighborhood, property_type, construction_type), (neighborhood, property_type), (neighborhood)) HAVING count(price_per_sqm_eur) >= 5)
"""


@query(_STATS + "SELECT neighborhood, property_type, construction_type, round(mean, 4) AS mean, median, round(std, 4) AS std, count, min, max, round(p20, 4) AS p20 FROM stats")
def group_stats_tiered(spark, d):
    """Grouping sets over place, type and construction, groups of at least five."""
    return rounded(stats(spark, d), "mean", "std", "p20")


@query(
    _STATS
    + """, k AS (SELECT * FROM stats WHERE construction_type = 'all'),
    pick AS (SELECT *, row_number() OVER (PARTITION BY neighborhood ORDER BY CASE property_type WHEN 'apartment' THEN 0 WHEN 'house' THEN 1 ELSE 2 END) AS r FROM k WHERE property_type IN ('apartment', 'house', 'all'))
    SELECT p.neighborhood, p.property_type AS basis, p.median, p.count FROM pick p LEFT JOIN k plots ON plots.neighborhood = p.neighborhood AND plots.property_type = 'plot'
    WHERE p.r = 1 AND (p.property_type <> 'all' OR plots.median IS NULL OR p.median > 2 * plots.median) AND p.median >= 700"""
)
def published_stats(spark, d):
    """One statistic per place: apartments, else houses, else all types unless plots prevail; none below the floor."""
    rows = stats(spark, d).filter("construction_type = 'all'")
    plots = rows.filter("property_type = 'plot'").select(F.col("neighborhood").alias("_n"), F.col("median").alias("_plots"))
    best = tiers.prefer(rows, "neighborhood", "property_type", ["apartment", "house", tiers.ALL], ["median", "count"])
    mixed = (F.col("basis") == tiers.ALL) & (F.col("median") <= 2 * F.col("_plots"))
    return best.join(plots, F.col("neighborhood") == F.col("_n"), "left").filter(~F.coalesce(mixed, F.lit(False)) & (F.col("median") >= R.min_per_sqm)).select("neighborhood", "basis", "median", "count")


@query(
    _STATS
    + """, f AS (
        SELECT s.id, s.price_per_sqm_eur AS p, coalesce(a.mean, b.mean) AS mean, CASE WHEN a.mean IS NOT NULL THEN a.std ELSE b.std END AS std, CASE WHEN a.mean IS NOT NULL THEN 0 ELSE 1 END AS basis
        FROM sane s LEFT JOIN stats a ON a.neighborhood = coalesce(s.neighborhood, 'unknown') AND a.property_type = coalesce(s.property_type, 'unknown') AND a.construction_type = coalesce(s.construction_type, 'unknown') AND a.construction_type <> 'all'
        LEFT JOIN stats b ON b.neighborhood = coalesce(s.neighborhood, 'unknown') AND b.property_type = coalesce(s.property_type, 'unknown') AND b.construction_type = 'all' AND b.property_type <> 'all')
    SELECT id, round((p - mean) / std, 4) AS zscore, round((mean - p) / mean * 100, 4) AS savings_pct, basis FROM f WHERE std <> 0 AND (p - mean) / std < -1.5 AND p < 0.85 * mean"""
)
def anomalies_zscore(spark, d):
    """Rows far below the mean of their finest tier."""
    out = tiers.anomalies(sane(spark, d), stats(spark, d), TIERS, "price_per_sqm_eur", R.z_limit, R.share_of_mean)
    return out.select("id", F.round("zscore", 4).alias("zscore"), F.round((F.col("mean") - F.col("price_per_sqm_eur")) / F.col("mean") * 100, 4).alias("savings_pct"), "basis")


@query(
    _STATS
    + """, city AS (SELECT property_type, avg(price_per_sqm_eur) AS mean, stddev_pop(price_per_sqm_eur) AS std FROM sale WHERE price_per_sqm_eur > 0 GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(price_per_sqm_eur) <> 0),
    u AS (SELECT * FROM stats WHERE std <> 0),
    f AS (
        SELECT s.id, s.price_per_sqm_eur AS p, coalesce(a.mean, b.mean, g.mean, c.mean) AS mean, coalesce(a.std, b.std, g.std, c.std) AS std,
               CASE WHEN a.mean IS NOT NULL THEN 0 WHEN b.mean IS NOT NULL THEN 1 WHEN g.mean IS NOT NULL THEN 2 ELSE 3 END AS basis
        FROM sane s LEFT JOIN u a ON a.neighborhood = coalesce(s.neighborhood, 'unknown') AND a.property_type = coalesce(s.property_type, 'unknown') AND a.construction_type = coalesce(s.construction_type, 'unknown') AND a.construction_type <> 'all'
        LEFT JOIN u b ON b.neighborhood = coalesce(s.neighborhood, 'unknown') AND b.property_type = coalesce(s.property_type, 'unknown') AND b.construction_type = 'all' AND b.property_type <> 'all'
        LEFT JOIN u g ON g.neighborhood = coalesce(s.neighborhood, 'unknown') AND g.property_type = 'all'
        LEFT JOIN city c ON c.property_type = s.property_type)
    SELECT id, round((p - mean) / std, 4) AS zscore, basis FROM f WHERE mean IS NOT NULL"""
)
def zscore_fallback(spark, d):
    """Z-score by the finest tier that has a deviation, at last by the city's type."""
    rows = sane(spark, d)
    p = F.col("price_per_sqm_eur")
    city = sale(spark, d).filter(p > 0).groupBy("property_type").agg(F.avg(p).alias("c_mean"), F.stddev_pop(p).alias("c_std"), F.count("*").alias("_n")).filter((F.col("_n") >= 5) & (F.col("c_std") != 0))
    found = tiers.tier_lookup(rows, stats(spark, d), TIERS, ["mean", "std"], usable=F.col("std") != 0).join(city, "property_type", "left")
    mean, std = F.coalesce("mean", "c_mean"), F.coalesce("std", "c_std")
    return found.filter(mean.isNotNull()).select("id", F.round((p - mean) / std, 4).alias("zscore"), F.coalesce("basis", F.lit(3)).alias("basis"))


@query(
    """, train AS (SELECT * FROM uniq WHERE listing_kind = 'sale' AND property_type IN ('apartment', 'studio', 'maisonette') AND area_sqm BETWEEN 20 AND 500 AND price_per_sqm_eur BETWEEN 700 AND 15000 AND first_seen IS NOT NULL),
    m3 AS (SELECT neighborhood, property_type, construction_type, median(price_per_sqm_eur) AS m FROM train GROUP BY ALL), m2 AS (SELECT neighborhood, property_type, median(price_per_sqm_eur) AS m FROM train GROUP BY ALL),
    m1 AS (SELECT neighborhood, median(price_per_sqm_eur) AS m FROM train GROUP BY ALL)
    SELECT t.id, coalesce(m3.m, m2.m, m1.m, (SELECT median(price_per_sqm_eur) FROM train)) AS baseline FROM sane t
    LEFT JOIN m3 ON m3.neighborhood IS NOT DISTINCT FROM t.neighborhood AND m3.property_type IS NOT DISTINCT FROM t.property_type AND m3.construction_type IS NOT DISTINCT FROM t.construction_type
    LEFT JOIN m2 ON m2.neighborhood IS NOT DISTINCT FROM t.neighborhood AND m2.property_type IS NOT DISTINCT FROM t.property_type LEFT JOIN m1 ON m1.neighborhood IS NOT DISTINCT FROM t.neighborhood"""
)
def baseline_tiers(spark, d):
    """Median of the finest tier of the training rows that knows the row."""
    return hedonic.baseline(sane(spark, d), training(spark, d), TIERS, "price_per_sqm_eur").select("id", "baseline")


def training(spark, d) -> DataFrame:
    return uniq(spark, d).filter(
        (F.col("listing_kind") == "sale") & F.col("property_type").isin(*R.apartment_like) & F.col("area_sqm").between(R.min_area, R.max_area)
        & F.col("price_per_sqm_eur").between(R.min_per_sqm, R.max_per_sqm) & F.col("first_seen").isNotNull()
    )


_RENT = """, rent AS (SELECT *, CASE WHEN rooms IS NULL THEN 'all' WHEN rooms >= 4 THEN '4+' ELSE CAST(greatest(rooms, 1) AS VARCHAR) END AS bucket, price_eur / area_sqm AS rpm
    FROM active WHERE listing_kind = 'rent' AND price_eur >= 100 AND area_sqm > 0),
rents AS (SELECT neighborhood, 'all' AS bucket, median(rpm) AS rent, count(*) AS n FROM rent GROUP BY 1 HAVING count(*) >= 5
    UNION ALL SELECT neighborhood, bucket, median(rpm), count(*) FROM rent WHERE bucket <> 'all' GROUP BY 1, 2 HAVING count(*) >= 5)
"""


def rents(spark, d) -> DataFrame:
    rows = active(spark, d).filter((F.col("listing_kind") == "rent") & (F.col("price_eur") >= R.min_rent) & (F.col("area_sqm") > 0))
    rows = rows.select("neighborhood", S.rooms_bucket(F.col("rooms")).alias("bucket"), (F.col("price_eur") / F.col("area_sqm")).alias("rpm"))
    # each row counts for its bucket and for all; a row without rooms only for all
    both = rows.withColumn("bucket", F.explode(F.array_distinct(F.array("bucket", F.lit("all")))))
    return both.groupBy("neighborhood", "bucket").agg(F.median("rpm").alias("rent"), F.count("*").alias("n")).filter(F.col("n") >= R.min_group)


@query(_RENT + "SELECT neighborhood, bucket, round(rent, 4) AS rent, n FROM rents")
def rent_stats(spark, d):
    """Median rent per square metre per place and number of rooms."""
    return rounded(rents(spark, d), "rent")


@query(
    _RENT
    + """, y AS (SELECT s.id, round(coalesce(a.rent, b.rent) * 12 / s.price_per_sqm_eur * 100, 4) AS gross_yield_pct FROM sane s
        LEFT JOIN rents a ON a.neighborhood = s.neighborhood AND a.bucket = CASE WHEN s.rooms IS NULL THEN 'all' WHEN s.rooms >= 4 THEN '4+' ELSE CAST(greatest(s.rooms, 1) AS VARCHAR) END
        LEFT JOIN rents b ON b.neighborhood = s.neighborhood AND b.bucket = 'all' WHERE s.property_type IN ('apartment', 'studio', 'maisonette'))
    SELECT * FROM y WHERE gross_yield_pct <= 25"""
)
def gross_yield(spark, d):
    """Yearly rent over price by the bucket's median rent, else the place's."""
    r = rents(spark, d)
    exact = r.select(F.col("neighborhood").alias("_n1"), F.col("bucket").alias("_b1"), F.col("rent").alias("r1"))
    every = r.filter("bucket = 'all'").select(F.col("neighborhood").alias("_n2"), F.col("rent").alias("r2"))
    rows = sane(spark, d).filter(F.col("property_type").isin(*R.apartment_like)).withColumn("_b", S.rooms_bucket(F.col("rooms")))
    out = rows.join(exact, (F.col("neighborhood") == F.col("_n1")) & (F.col("_b") == F.col("_b1")), "left").join(every, F.col("neighborhood") == F.col("_n2"), "left")
    pct = F.round(F.coalesce("r1", "r2") * 12 / F.col("price_per_sqm_eur") * 100, 4)
    return out.select("id", pct.alias("gross_yield_pct")).filter("gross_yield_pct <= 25")


_FP = """, fp AS (
    SELECT *, concat_ws('_', pl, CAST(ar AS VARCHAR), CAST(rm AS VARCHAR), bd, coalesce(listing_kind, 'sale')) AS fp FROM (
        SELECT *,
            CASE WHEN coalesce(nm, '') = '' THEN 'unknown' ELSE nm END AS pl,
            CASE WHEN coalesce(area_sqm, 0) <= 0 THEN 0 ELSE CAST(round_even(area_sqm / 5, 0) AS INT) * 5 END AS ar,
            CASE WHEN coalesce(rooms, 0) = 0 AND property_type = 'studio' THEN 1 ELSE coalesce(rooms, 0) END AS rm,
            CASE WHEN coalesce(price_eur, 0) <= 0 THEN 'unknown' ELSE CAST(CAST(round_even(price_eur / greatest(5000.0, round_even(price_eur * 0.05 / 5000, 0) * 5000), 0) * greatest(5000.0, round_even(price_eur * 0.05 / 5000, 0) * 5000) AS BIGINT) AS VARCHAR) END AS bd
        FROM (SELECT *, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(trim(replace(neighborhood, chr(160), ' '))), 'гр. ', ''), 'кв. ', ''), 'ж.к. ', ''), 'жк ', ''), 'м-т ', ''), 'в.з. ', ''), 'с. ', ''), 'р-н ', ''), '  ', ' ')) AS nm FROM base)))
"""


def fingerprinted(spark, d) -> DataFrame:
    c = F.col
    return base(spark, d).withColumn("fp", S.fingerprint(c("neighborhood"), c("area_sqm"), c("rooms"), c("property_type"), c("price_eur"), c("listing_kind")))


_PRIO = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 99 END"
_FILLED = " + ".join(f"CASE WHEN coalesce({f}, 0) <> 0 THEN 1 ELSE 0 END" for f in ("rooms", "floor", "total_floors", "year_built")) + " + CASE WHEN trim(coalesce(construction_type, '')) <> '' THEN 1 ELSE 0 END"
FILL = ["rooms", "floor", "total_floors", "year_built", "construction_type"]


@query(_FP + f", w AS (SELECT id, fp, count(*) OVER (PARTITION BY fp) AS group_size, row_number() OVER (PARTITION BY fp ORDER BY {_PRIO}, {_FILLED} DESC, id) = 1 AS is_winner FROM fp) SELECT id, substr(md5(fp), 1, 16) AS canonical, group_size, is_winner FROM w")
def fingerprint_dedup(spark, d):
    """Fingerprint, canonical id and winner of each group."""
    rows = fingerprinted(spark, d)
    rows = rows.withColumns({"_p": dedup.priorities(F.col("source"), PRIORITY), "_f": dedup.filled_count(rows, FILL)})
    return dedup.winners(rows, "fp", "_p", "_f", "id").select("id", S.canonical_id(F.col("fp")).alias("canonical"), "group_size", "is_winner")


@query(
    _FP
    + f", o AS (SELECT *, {_PRIO} AS p FROM fp) SELECT fp, "
    + ", ".join(f"arg_min({f}, p * 100000000000 + id) FILTER (WHERE coalesce({f}, 0) <> 0) AS {f}" for f in FILL[:4])
    + ", arg_min(construction_type, p * 100000000000 + id) FILTER (WHERE trim(coalesce(construction_type, '')) <> '') AS construction_type FROM o GROUP BY fp"
)
def dedup_backfill(spark, d):
    """First filled value of each attribute by source priority."""
    rows = fingerprinted(spark, d).withColumn("_p", dedup.priorities(F.col("source"), PRIORITY))
    return dedup.backfilled(rows, "fp", ["_p", "id"], FILL)


@query(_FP + ", g AS (SELECT fp, count(*) AS n FROM fp GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS listings, count(*) AS unique_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS in_duplicate_groups FROM g")
def dedup_totals(spark, d):
    return dedup.duplicate_totals(fingerprinted(spark, d), "fp")


@query(_FP + ", g AS (SELECT fp, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM fp GROUP BY 1 HAVING count(*) > 1) SELECT sources, count(*) AS groups, CAST(sum(n) AS BIGINT) AS listings FROM g GROUP BY 1")
def dedup_sources(spark, d):
    return dedup.source_combinations(fingerprinted(spark, d), "fp", "source")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC NULLS LAST, id DESC) AS rn FROM ph WHERE recorded_at IS NOT NULL) SELECT listing_id, price_eur, recorded_at FROM r WHERE rn = 1")
def latest_price(spark, d):
    """Last recorded price of each listing."""
    return series.latest(prices(spark, d).filter("recorded_at is not null"), "listing_id", ["recorded_at", "id"], ["price_eur", "recorded_at"])


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC, id DESC) AS rn FROM ph WHERE recorded_at >= TIMESTAMP '2026-03-26' - INTERVAL 7 DAY)
    SELECT s.id, r.price_eur AS old_price, s.price_eur AS new_price, round((r.price_eur - s.price_eur) / r.price_eur * 100, 3) AS drop_pct FROM sale s JOIN r ON r.listing_id = s.id AND rn = 1
    WHERE s.price_eur < r.price_eur AND (r.price_eur - s.price_eur) / r.price_eur * 100 >= 5"""
)
def recent_price_drops(spark, d):
    """Listings now at least 5 % below their last price of the week."""
    week = prices(spark, d).filter(F.col("recorded_at") >= now() - F.expr("INTERVAL 7 DAYS"))
    old = series.latest(week, "listing_id", ["recorded_at", "id"], ["price_eur"]).select(F.col("listing_id").alias("id"), F.col("price_eur").alias("old_price"))
    pct = (F.col("old_price") - F.col("price_eur")) / F.col("old_price") * 100
    return sale(spark, d).join(old, "id").filter((F.col("price_eur") < F.col("old_price")) & (pct >= R.drop_pct)).select("id", "old_price", F.col("price_eur").alias("new_price"), F.round(pct, 3).alias("drop_pct"))


@query("SELECT id, round((first_price_eur - price_eur) / first_price_eur * 100, 4) AS drop_pct FROM sale WHERE first_price_eur > 0 AND price_changes > 0 AND (first_price_eur - price_eur) / first_price_eur * 100 >= 5 ORDER BY (first_price_eur - price_eur) / first_price_eur DESC, id LIMIT 50")
def first_price_drops(spark, d):
    """The 50 largest drops from the first price."""
    pct = (F.col("first_price_eur") - F.col("price_eur")) / F.col("first_price_eur")
    rows = sale(spark, d).filter((F.col("first_price_eur") > 0) & (F.col("price_changes") > 0) & (pct * 100 >= R.drop_pct))
    return rows.orderBy(pct.desc(), "id").limit(50).select("id", F.round(pct * 100, 4).alias("drop_pct"))


@query(", r AS (SELECT listing_id, id, recorded_at, round(price_eur, 2) AS price, lead(round(price_eur, 2)) OVER w AS nx, lead(id) OVER w AS ni FROM ph WHERE recorded_at IS NOT NULL WINDOW w AS (PARTITION BY listing_id ORDER BY recorded_at, id)) SELECT listing_id, recorded_at, price FROM r WHERE ni IS NULL OR nx <> price")
def price_runs(spark, d):
    """Price history without repetitions, each run at its last date."""
    rows = prices(spark, d).filter("recorded_at is not null").select("listing_id", "id", "recorded_at", F.round("price_eur", 2).alias("price"))
    return series.collapse_runs(rows, "listing_id", ["recorded_at", "id"], "price", period="month").select("listing_id", "recorded_at", "price")


@query("SELECT id, round(100 * cume_dist() OVER (PARTITION BY neighborhood ORDER BY price_per_sqm_eur), 1) AS percentile FROM sane")
def price_percentile(spark, d):
    """Share of the place's listings that cost at most as much."""
    return series.rank_pct(sane(spark, d), "neighborhood", "price_per_sqm_eur", "percentile").select("id", "percentile")


@query("SELECT listing_id, arg_max(zscore, id) FILTER (WHERE zscore IS NOT NULL) AS zscore, arg_max(savings_pct, id) FILTER (WHERE savings_pct IS NOT NULL) AS savings_pct, min(zscore) FILTER (WHERE alert_type = 'underpriced') AS extreme_z FROM al GROUP BY 1")
def latest_alert_values(spark, d):
    """Newest z-score and savings of a listing, each for itself, and its extreme z-score."""
    rows = alerts(spark, d)
    extreme = rows.groupBy("listing_id").agg(F.min(F.when(F.col("alert_type") == "underpriced", F.col("zscore"))).alias("extreme_z"))
    return series.latest_values(rows, "listing_id", "id", ["zscore", "savings_pct"]).join(extreme, "listing_id")


@query("SELECT a.id AS alert_id, s.id, a.zscore FROM sale s JOIN al a ON a.listing_id = s.id WHERE a.zscore < -1.5 ORDER BY a.zscore, a.id LIMIT 10")
def new_deals(spark, d):
    """The ten lowest z-scores among alerts of active sales."""
    a = alerts(spark, d).select(F.col("id").alias("alert_id"), "listing_id", "zscore").filter(F.col("zscore") < R.z_limit)
    return sale(spark, d).select("id").join(a, F.col("id") == F.col("listing_id")).orderBy("zscore", "alert_id").limit(10).select("alert_id", "id", "zscore")


@query("SELECT id, EXISTS (SELECT 1 FROM al a WHERE a.listing_id = s.id AND a.alert_type = 'underpriced' AND a.zscore <= -1.5) AS is_deal FROM sale s ORDER BY is_deal DESC, first_seen DESC NULLS LAST, id DESC LIMIT 60")
def extraction_queue(spark, d):
    """Deals first, then the newest: the next 60 listings to read."""
    deals = alerts(spark, d).filter((F.col("alert_type") == "underpriced") & (F.col("zscore") <= R.z_limit)).select(F.col("listing_id").alias("_l")).distinct()
    rows = sale(spark, d).select("id", "first_seen").join(deals, F.col("id") == F.col("_l"), "left").withColumn("is_deal", F.col("_l").isNotNull())
    return rows.orderBy(F.desc("is_deal"), F.desc("first_seen"), F.desc("id")).limit(60).select("id", "is_deal")


@query("SELECT id FROM active l WHERE EXISTS (SELECT 1 FROM ph h WHERE h.listing_id = l.id AND h.recorded_at > l.first_seen + INTERVAL 30 DAY)")
def changed_after(spark, d):
    """Listings with a price recorded more than 30 days after their first sight (semi-join on a bound)."""
    newest = prices(spark, d).groupBy(F.col("listing_id").alias("id")).agg(F.max("recorded_at").alias("_t"))
    return active(spark, d).select("id", "first_seen").join(newest, "id").filter("_t > first_seen + INTERVAL 30 DAYS").select("id")


_LAST = ", lastday AS (SELECT source, lower(trim(source_id)) AS source_id, arg_max(struct_pack(p := price_eur, n := neighborhood), loaded_at) AS v FROM listing_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM listing_snapshots) AND source_id IS NOT NULL GROUP BY 1, 2)"


def last_day(spark, d) -> DataFrame:
    rows = clean(table(spark, d, "listing_snapshots"))
    newest = rows.agg(F.max("snapshot_date").alias("_max"))
    rows = rows.join(F.broadcast(newest), F.col("snapshot_date") == F.col("_max")).withColumn("source_id", F.lower(F.trim("source_id"))).filter("source_id is not null")
    top = F.max_by(F.struct("price_eur", "neighborhood"), "loaded_at").alias("_v")
    return rows.groupBy("source", "source_id").agg(top).select("source", "source_id", "_v.price_eur", "_v.neighborhood")


@query(
    _LAST
    + """, a AS (SELECT source, count(*) AS n FROM base WHERE is_active GROUP BY 1), g AS (SELECT source, count(*) AS n FROM lastday GROUP BY 1),
    ok AS (SELECT a.source FROM a JOIN g USING (source) WHERE g.n >= 0.5 * a.n)
    SELECT b.id FROM base b WHERE is_active AND source IN (SELECT source FROM ok) AND NOT EXISTS (SELECT 1 FROM lastday l WHERE l.source = b.source AND l.source_id = b.source_id)"""
)
def missing_listings(spark, d):
    """Active listings that the last snapshot of their source doesn't hold, sparing thin snapshots."""
    return state.missing(base(spark, d).filter("is_active"), last_day(spark, d), "source", "source_id", R.min_seen_ratio).select("id")


@query(
    _LAST
    + """, c AS (SELECT source, source_id, price_eur, first_price_eur, price_changes, first_seen, last_seen, is_active FROM base)
    SELECT coalesce(c.source, s.source) AS source, coalesce(c.source_id, s.source_id) AS source_id, CASE WHEN s.source IS NOT NULL THEN s.v.p ELSE c.price_eur END AS price_eur,
           CASE WHEN c.source IS NOT NULL THEN c.first_price_eur ELSE s.v.p END AS first_price,
           coalesce(c.price_changes, 0) + CASE WHEN c.source IS NOT NULL AND s.source IS NOT NULL AND c.price_eur IS DISTINCT FROM s.v.p THEN 1 ELSE 0 END AS price_changes,
           CASE WHEN s.source IS NOT NULL THEN true ELSE c.is_active END AS is_active
    FROM c FULL JOIN lastday s ON s.source = c.source AND s.source_id = c.source_id"""
)
def upsert_listings(spark, d):
    """The listing table after the last snapshot is upserted."""
    current = base(spark, d).select("source", "source_id", "price_eur", F.col("first_price_eur").alias("first_price"), "price_changes", "first_seen", "last_seen", "is_active")
    out, _ = state.upsert(current, last_day(spark, d), ["source", "source_id"], ["price_eur"], "price_eur", now())
    return out.select("source", "source_id", "price_eur", "first_price", "price_changes", "is_active")


@query(
    _LAST
    + """ SELECT coalesce(c.source, s.source) AS source, coalesce(c.source_id, s.source_id) AS source_id, CASE WHEN c.source IS NOT NULL THEN c.price_eur ELSE s.v.p END AS price_eur
    FROM base c FULL JOIN lastday s ON s.source = c.source AND s.source_id = c.source_id WHERE (c.source IS NULL) OR (s.source IS NOT NULL AND c.price_eur IS DISTINCT FROM s.v.p)"""
)
def upsert_history(spark, d):
    """The history rows that the same upsert appends."""
    current = base(spark, d).select("source", "source_id", "price_eur", F.col("first_price_eur").alias("first_price"), "price_changes", "first_seen", "last_seen", "is_active")
    _, delta = state.upsert(current, last_day(spark, d), ["source", "source_id"], ["price_eur"], "price_eur", now())
    return delta.select("source", "source_id", "price_eur")


@query("SELECT id, CASE WHEN due THEN true ELSE is_sold END AS is_sold, CASE WHEN due THEN last_seen ELSE sold_date END AS sold_date, CASE WHEN due THEN CAST(greatest(0, datesub('day', first_seen, last_seen)) AS INT) ELSE days_on_market END AS days_on_market FROM (SELECT *, coalesce(NOT coalesce(is_active, false) AND NOT coalesce(is_sold, false) AND last_seen < TIMESTAMP '2026-03-26' - INTERVAL 14 DAY, false) AS due FROM base)")
def mark_sold(spark, d):
    return state.mark_sold(base(spark, d), now(), R.sold_after_days).select("id", "is_sold", "sold_date", "days_on_market")


@query(
    _STATS
    + """, f AS (SELECT s.id AS listing_id, 'underpriced' AS alert_type FROM sane s JOIN stats b ON b.neighborhood = coalesce(s.neighborhood, 'unknown') AND b.property_type = 'all' WHERE s.price_per_sqm_eur < 0.85 * b.mean AND b.std <> 0 AND (s.price_per_sqm_eur - b.mean) / b.std < -1.5)
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM al a WHERE a.listing_id = f.listing_id AND a.alert_type = f.alert_type)"""
)
def new_alerts(spark, d):
    """Anomalies of the place for which no alert exists yet."""
    place = stats(spark, d).filter("property_type = 'all'")
    found = tiers.anomalies(sane(spark, d), place, ["neighborhood"], "price_per_sqm_eur", R.z_limit, R.share_of_mean, depth=1)
    return state.absent(found.select(F.col("id").alias("listing_id"), F.lit("underpriced").alias("alert_type")), alerts(spark, d), ["listing_id", "alert_type"])


@query("SELECT neighborhood, median_price_per_sqm, listing_count FROM neighborhood_stats_history WHERE snapshot_date <= TIMESTAMP '2026-03-26' - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY neighborhood ORDER BY snapshot_date DESC) = 1", base=False)
def stats_as_of(spark, d):
    """Each place's statistics as of 30 days ago."""
    return series.as_of(table(spark, d, "neighborhood_stats_history"), "neighborhood", "snapshot_date", now() - F.expr("INTERVAL 30 DAYS"), ["median_price_per_sqm", "listing_count"])


@query(
    """WITH h AS (SELECT * FROM neighborhood_stats_history WHERE median_price_per_sqm IS NOT NULL AND NOT isnan(median_price_per_sqm)), e AS (SELECT neighborhood, max(snapshot_date) AS e FROM h GROUP BY 1),
    t AS (SELECT neighborhood, arg_max(median_price_per_sqm, snapshot_date) AS latest, arg_max(median_price_per_sqm, snapshot_date) FILTER (WHERE snapshot_date <= e - INTERVAL 30 DAY) AS earlier FROM h JOIN e USING (neighborhood) GROUP BY 1)
    SELECT neighborhood, latest, earlier, CASE WHEN p IS NULL THEN 'insufficient history' WHEN p > 0.5 THEN 'up' WHEN p < -0.5 THEN 'down' ELSE 'stable' END AS trend_direction FROM (SELECT *, round((latest - earlier) / nullif(earlier, 0) * 100, 2) AS p FROM t)""",
    base=False,
)
def place_trends(spark, d):
    """Trend of each place's median over 30 days of its own series."""
    out = series.trend(clean(table(spark, d, "neighborhood_stats_history")), "neighborhood", "snapshot_date", "median_price_per_sqm", 30)
    return out.select("neighborhood", "latest", "earlier", S.direction(F.col("trend_pct"), 0.5, "insufficient history").alias("trend_direction"))


@query(
    """, p AS (SELECT h.id, l.neighborhood, h.recorded_at, h.price_eur FROM ph h JOIN uniq l ON l.id = h.listing_id WHERE h.recorded_at IS NOT NULL AND l.neighborhood IS NOT NULL)
    SELECT p.id, s.median_price_per_sqm AS median_price_per_sqm_asof FROM p ASOF LEFT JOIN neighborhood_stats_history s ON s.neighborhood = p.neighborhood AND s.snapshot_date <= p.recorded_at"""
)
def price_asof_stats(spark, d):
    """Every recorded price with the place's median at that time (as-of join)."""
    places = uniq(spark, d).select(F.col("id").alias("listing_id"), "neighborhood").filter("neighborhood is not null")
    rows = prices(spark, d).filter("recorded_at is not null").select("id", "listing_id", "recorded_at").join(places, "listing_id")
    return series.asof_join(rows, table(spark, d, "neighborhood_stats_history"), "neighborhood", "recorded_at", "snapshot_date", ["median_price_per_sqm"]).select("id", "median_price_per_sqm_asof")


@query(
    """, z AS (SELECT s.*, n.zone FROM sane s LEFT JOIN neighborhoods n ON n.name = s.neighborhood)
    SELECT CASE WHEN grouping(property_type) = 0 THEN 'type' WHEN grouping(zone) = 0 THEN 'zone' ELSE 'all' END AS scope,
           CASE WHEN grouping(property_type) = 0 THEN coalesce(property_type, 'unknown') WHEN grouping(zone) = 0 THEN coalesce(zone, 'unknown') ELSE 'all' END AS name,
           count(*) AS n, round(avg(price_per_sqm_eur), 4) AS mean, median(price_per_sqm_eur) AS median, min(price_per_sqm_eur) AS min, max(price_per_sqm_eur) AS max
    FROM z GROUP BY GROUPING SETS ((property_type), (zone), ())"""
)
def market_summary(spark, d):
    """Overall, by type and by zone, in one pass."""
    zones = table(spark, d, "neighborhoods").select(F.col("name").alias("_n"), "zone")
    rows = sane(spark, d).join(zones, F.col("neighborhood") == F.col("_n"), "left")
    t, z, p = F.grouping("property_type") == 0, F.grouping("zone") == 0, F.col("price_per_sqm_eur")
    name = F.when(t, F.coalesce("property_type", F.lit("unknown"))).when(z, F.coalesce("zone", F.lit("unknown"))).otherwise("all")
    out = rows.groupingSets([[F.col("property_type")], [F.col("zone")], []], F.col("property_type"), F.col("zone")).agg(
        F.when(t, "type").when(z, "zone").otherwise("all").alias("scope"), name.alias("name"), F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.median(p).alias("median"), F.min(p).alias("min"), F.max(p).alias("max")
    )
    return out.select("scope", "name", "n", "mean", "median", "min", "max")


@query(
    """, x AS (SELECT *, coalesce(is_sold, false) AS sold, CASE WHEN first_price_eur > 0 THEN greatest(0, (first_price_eur - price_eur) / first_price_eur * 100) END AS cut FROM uniq WHERE listing_kind = 'sale' AND neighborhood IS NOT NULL)
    SELECT neighborhood, count(*) FILTER (WHERE sold) AS exits, count(*) FILTER (WHERE first_seen >= TIMESTAMP '2026-03-19') AS new_week, count(*) FILTER (WHERE sold AND sold_date >= TIMESTAMP '2026-03-19') AS exits_week,
           CASE WHEN count(*) FILTER (WHERE sold) >= 10 THEN median(price_per_sqm_eur) FILTER (WHERE sold AND price_per_sqm_eur > 0) END AS exit_median,
           CASE WHEN count(*) FILTER (WHERE sold) >= 10 THEN round(median(cut) FILTER (WHERE sold), 4) END AS exit_discount,
           CASE WHEN count(*) FILTER (WHERE sold) >= 10 THEN median(days_on_market) FILTER (WHERE sold) END AS exit_days
    FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE sold) > 0 OR count(*) FILTER (WHERE first_seen >= TIMESTAMP '2026-03-19') > 0"""
)
def market_signals(spark, d):
    """New listings, exits and exit medians per place."""
    sold, week = F.coalesce("is_sold", F.lit(False)), now() - F.expr("INTERVAL 7 DAYS")
    cut = F.when(F.col("first_price_eur") > 0, F.when(F.col("price_eur").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("first_price_eur") - F.col("price_eur")) / F.col("first_price_eur") * 100)))
    rows = uniq(spark, d).filter("listing_kind = 'sale' and neighborhood is not null").withColumn("_s", sold).withColumn("_cut", cut)
    exits, p = F.count_if("_s"), F.col("price_per_sqm_eur")
    enough = lambda v: F.when(exits >= 10, v)
    out = rows.groupBy("neighborhood").agg(
        exits.alias("exits"), F.count_if(F.col("first_seen") >= week).alias("new_week"), F.count_if(F.col("_s") & (F.col("sold_date") >= week)).alias("exits_week"),
        enough(F.median(F.when(F.col("_s") & (p > 0), p))).alias("exit_median"), enough(F.round(F.median(F.when(F.col("_s"), F.col("_cut"))), 4)).alias("exit_discount"),
        enough(F.median(F.when(F.col("_s"), F.col("days_on_market")))).alias("exit_days"),
    )
    return out.filter("exits > 0 or new_week > 0")


@query(
    """, x AS (SELECT neighborhood, count(*) AS n, count(*) FILTER (WHERE first_seen >= TIMESTAMP '2026-03-12') AS added, count(*) FILTER (WHERE NOT coalesce(is_active, false) AND last_seen >= TIMESTAMP '2026-03-12') AS gone,
        median(price_per_sqm_eur) FILTER (WHERE is_active) AS median FROM uniq WHERE listing_kind = 'sale' AND neighborhood IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
    SELECT neighborhood, added, gone, median, CASE WHEN added - gone > 2 THEN 'hot' WHEN added - gone < -2 THEN 'fast selling' WHEN gone > added THEN 'absorbing' ELSE 'stable' END AS velocity FROM x ORDER BY added DESC, neighborhood LIMIT 8"""
)
def district_velocity(spark, d):
    """The eight places with most new listings, and how fast they move."""
    since = now() - F.expr("INTERVAL 14 DAYS")
    on = F.coalesce("is_active", F.lit(False))
    rows = uniq(spark, d).filter("listing_kind = 'sale' and neighborhood is not null").groupBy("neighborhood").agg(
        F.count("*").alias("n"), F.count_if(F.col("first_seen") >= since).alias("added"), F.count_if(~on & (F.col("last_seen") >= since)).alias("gone"), F.median(F.when(on, F.col("price_per_sqm_eur"))).alias("median")
    )
    gap = F.col("added") - F.col("gone")
    label = F.when(gap > 2, "hot").when(gap < -2, "fast selling").when(gap < 0, "absorbing").otherwise("stable")
    return rows.filter("n >= 5").orderBy(F.desc("added"), "neighborhood").limit(8).select("neighborhood", "added", "gone", "median", label.alias("velocity"))


_DOM = ", dm AS (SELECT *, coalesce(days_on_market, CAST(greatest(0, datesub('day', first_seen, TIMESTAMP '2026-03-26')) AS INT)) AS dom FROM sale WHERE neighborhood IS NOT NULL)"


@query(_DOM + " SELECT neighborhood, CASE WHEN count(dom) FILTER (WHERE property_type = 'apartment') >= 5 THEN median(dom) FILTER (WHERE property_type = 'apartment') ELSE median(dom) END AS median, count(dom) AS count FROM dm GROUP BY 1")
def days_on_market(spark, d):
    """Median days on the market: apartments where there are five, else all."""
    dom = F.coalesce("days_on_market", S.whole_days(now(), F.col("first_seen")))
    return tiers.grouped_or_all(sale(spark, d).filter("neighborhood is not null").withColumn("_dom", dom), "neighborhood", F.col("property_type") == "apartment", F.col("_dom"), R.min_group)


@query(
    """, r AS (SELECT l.source, median(price_per_sqm_eur) FILTER (WHERE price_per_sqm_eur > 0) AS median_price, count(*) AS n FROM uniq l WHERE is_active GROUP BY 1),
    s AS (SELECT source, count(*) AS scraped FROM listing_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM listing_snapshots) GROUP BY 1)
    SELECT coalesce(r.source, s.source) AS source, median_price, coalesce(scraped, 0) AS scraped FROM r FULL JOIN s ON r.source = s.source"""
)
def source_metrics(spark, d):
    """Median price and rows delivered on the last date, for every source that has either."""
    p = F.col("price_per_sqm_eur")
    medians = active(spark, d).groupBy("source").agg(F.median(F.when(p > 0, p)).alias("median_price"))
    rows = table(spark, d, "listing_snapshots")
    newest = rows.agg(F.max("snapshot_date").alias("_m"))
    scraped = rows.join(F.broadcast(newest), F.col("snapshot_date") == F.col("_m")).groupBy("source").agg(F.count("*").alias("scraped"))
    return medians.join(scraped, "source", "full_outer").select("source", "median_price", F.coalesce("scraped", F.lit(0)).alias("scraped"))


@query(
    """WITH w AS (SELECT source, snapshot_date, CAST(count(*) AS DOUBLE) AS scraped, median(price_per_sqm_eur) FILTER (WHERE NOT isnan(price_per_sqm_eur) AND price_per_sqm_eur > 0) AS median_price FROM listing_snapshots GROUP BY 1, 2),
    l AS (SELECT source, snapshot_date, 'scraped' AS field, scraped AS v FROM w UNION ALL SELECT source, snapshot_date, 'median_price', median_price FROM w),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY snapshot_date DESC) AS k FROM l),
    c AS (SELECT source, field, max(v) FILTER (WHERE k = 1) AS value, median(v) FILTER (WHERE k BETWEEN 2 AND 8) AS baseline FROM r GROUP BY 1, 2)
    SELECT source, field, round(value, 4) AS value, round(baseline, 4) AS baseline, CASE WHEN p IS NULL THEN 'amber' WHEN p > 30 THEN 'red' ELSE 'green' END AS status FROM (SELECT *, abs(value - baseline) / nullif(baseline, 0) * 100 AS p FROM c)""",
    base=False,
)
def source_drift(spark, d):
    """Each source's last delivery against the median of the seven before, per metric."""
    p = F.col("price_per_sqm_eur")
    weekly = clean(table(spark, d, "listing_snapshots")).groupBy("source", "snapshot_date").agg(F.count("*").cast("double").alias("scraped"), F.median(F.when(p > 0, p)).alias("median_price"))
    long = weekly.unpivot(["source", "snapshot_date"], ["scraped", "median_price"], "field", "v")
    k = F.row_number().over(Window.partitionBy("source", "field").orderBy(F.desc("snapshot_date")))
    out = long.withColumn("_k", k).groupBy("source", "field").agg(F.max(F.when(F.col("_k") == 1, F.col("v"))).alias("value"), F.median(F.when(F.col("_k").between(2, 8), F.col("v"))).alias("baseline"))
    pct = F.abs(F.col("value") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0)) * 100
    return rounded(out.withColumn("status", signals.coloured(pct, R.drift_pct, R.drift_pct)), "value", "baseline")


@query("SELECT source, round(100.0 * count(image_url) / count(*), 4) AS pct, CASE WHEN 100.0 * count(image_url) / count(*) < 30 THEN 'red' WHEN 100.0 * count(image_url) / count(*) < 60 THEN 'amber' ELSE 'green' END AS status FROM active GROUP BY 1")
def image_coverage(spark, d):
    out = active(spark, d).groupBy("source").agg((100.0 * F.count("image_url") / F.count("*")).alias("pct"))
    return rounded(out.withColumn("status", signals.coloured(F.col("pct"), 60, 30, above=False)), "pct")


@query(
    """, m AS (SELECT neighborhood, avg(price_per_sqm_eur) AS mean, count(*) AS n FROM sane GROUP BY 1 HAVING count(*) >= 20)
    SELECT m.neighborhood, round((mean - avg_price_per_sqm) / avg_price_per_sqm * 100, 4) AS delta_pct, abs((mean - avg_price_per_sqm) / avg_price_per_sqm * 100) > 40 AS diverges FROM m JOIN neighborhoods n ON n.name = m.neighborhood WHERE avg_price_per_sqm > 0 AND NOT isnan(avg_price_per_sqm)"""
)
def benchmark_delta(spark, d):
    """Each place's mean against the benchmark table."""
    p = F.col("price_per_sqm_eur")
    ours = sane(spark, d).groupBy("neighborhood").agg(F.avg(p).alias("mean"), F.count("*").alias("n")).filter("n >= 20")
    bench = clean(table(spark, d, "neighborhoods")).filter("avg_price_per_sqm > 0").select(F.col("name").alias("neighborhood"), "avg_price_per_sqm")
    delta = (F.col("mean") - F.col("avg_price_per_sqm")) / F.col("avg_price_per_sqm") * 100
    return ours.join(bench, "neighborhood").select("neighborhood", F.round(delta, 4).alias("delta_pct"), (F.abs(delta) > R.benchmark_pct).alias("diverges"))


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE coalesce(is_duplicate, false)) AS duplicates, count(*) FILTER (WHERE coalesce(is_sold, false)) AS off_market FROM base GROUP BY 1")
def counts_by_source(spark, d):
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return base(spark, d).groupBy("source").agg(F.count("*").alias("total"), yes("is_active").alias("active"), yes("is_duplicate").alias("duplicates"), yes("is_sold").alias("off_market"))


@query("SELECT neighborhood, count(*) AS n FROM base GROUP BY 1 ORDER BY n DESC, neighborhood NULLS FIRST LIMIT 10")
def top_places(spark, d):
    return base(spark, d).groupBy("neighborhood").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("neighborhood")).limit(10)


_PHONE = """regexp_replace(contact_phone, '[^0-9]', '', 'g')"""
_DIGITS = f"""CASE WHEN {_PHONE} LIKE '00359%' THEN substr({_PHONE}, 3) WHEN {_PHONE} LIKE '359%' THEN {_PHONE} WHEN {_PHONE} LIKE '0%' THEN '359' || substr({_PHONE}, 2) WHEN length({_PHONE}) BETWEEN 8 AND 9 THEN '359' || {_PHONE} ELSE {_PHONE} END"""


@query(f"SELECT id, CASE WHEN n LIKE '359%' AND length(n) BETWEEN 11 AND 12 THEN '+' || n END AS phone, CASE WHEN regexp_full_match(lower(trim(contact_email)), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(trim(contact_email)) END AS email FROM (SELECT *, {_DIGITS} AS n FROM base)")
def contacts(spark, d):
    """Normalised phone and mail address of each listing."""
    return base(spark, d).select("id", S.phone(F.col("contact_phone")).alias("phone"), S.email(F.col("contact_email")).alias("email"))


@query(f"SELECT phone, count(DISTINCT source) AS sources, count(*) AS listings FROM (SELECT source, CASE WHEN n LIKE '359%' AND length(n) BETWEEN 11 AND 12 THEN '+' || n END AS phone FROM (SELECT *, {_DIGITS} AS n FROM base)) WHERE phone IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def phones_on_many_sources(spark, d):
    rows = base(spark, d).select("source", S.phone(F.col("contact_phone")).alias("phone")).filter("phone is not null")
    return rows.groupBy("phone").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("listings")).filter("sources > 1")


@query("SELECT id, source, turn FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY last_seen NULLS FIRST, id) AS turn FROM active) ORDER BY turn, source LIMIT 400")
def round_robin(spark, d):
    """The next 400 listings to visit, sources by turns, longest unseen first."""
    return series.interleave(active(spark, d).select("id", "source", "last_seen"), "source", [F.asc_nulls_first("last_seen"), F.col("id")], 400).select("id", "source", "turn")


@query(
    """, h AS (SELECT DISTINCT lower(image_phash) AS h FROM sale WHERE regexp_full_match(image_phash, '[0-9a-fA-F]{16}')), b AS (SELECT h, i, substr(h, i * 2 + 1, 2) AS k FROM h, range(8) r(i)),
    p AS (SELECT DISTINCT a.h AS hash_a, b.h AS hash_b FROM b a JOIN b ON a.i = b.i AND a.k = b.k AND a.h < b.h)
    SELECT hash_a, hash_b, CAST(bit_count(xor(('0x' || hash_a)::UBIGINT, ('0x' || hash_b)::UBIGINT)) AS INT) AS distance FROM p WHERE bit_count(xor(('0x' || hash_a)::UBIGINT, ('0x' || hash_b)::UBIGINT)) <= 6"""
)
def photo_near_pairs(spark, d):
    """Different photo hashes at most six bits apart."""
    return neardup.near_pairs(sale(spark, d), "id", "image_phash", R.photo_bits)


@query("SELECT id, lower(image_phash) AS hash_class, count(*) OVER (PARTITION BY lower(image_phash)) AS members FROM sale WHERE regexp_full_match(image_phash, '[0-9a-fA-F]{16}')")
def photo_classes(spark, d):
    """Each listing's class of equal photos and the class's size."""
    return neardup.hash_classes(sale(spark, d), "id", "image_phash")


_SETS = r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)') AS ws FROM documents),
s AS (SELECT *, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) ELSE [] END AS sh FROM w),
c AS (SELECT doc_id, sh, CASE WHEN text IS NULL THEN 'null' WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) WHEN len(ws) > 0 THEN md5(array_to_string(ws, ' '))
    WHEN regexp_full_match(text, '[\s\x{0B}\x{85}\p{Z}]*') THEN 'blank' ELSE md5(regexp_replace(text, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')) END AS hash_class FROM s)
"""


@query(
    _SETS
    + """, k AS (SELECT hash_class, any_value(sh) AS sh FROM c WHERE len(sh) > 0 GROUP BY 1), e AS (SELECT hash_class, len(sh) AS n, unnest(sh) AS t FROM k), rare AS (SELECT t FROM e GROUP BY 1 HAVING count(*) > 1),
    p AS (SELECT a.hash_class AS hash_a, b.hash_class AS hash_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a SEMI JOIN rare USING (t) JOIN e b ON a.t = b.t AND a.hash_class < b.hash_class GROUP BY 1, 2)
    SELECT hash_a, hash_b, common / (na + nb - common) AS similarity FROM p WHERE common / (na + nb - common) >= 0.8 - 1e-12""",
    base=False,
)
def text_near_pairs(spark, d):
    """Different texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, between classes of equal texts."""
    return neardup.jaccard_pairs(neardup.text_sets(table(spark, d, "documents"), "doc_id", "text", R.text_shingle), R.text_similarity)


@query(_SETS + "SELECT doc_id, hash_class, count(*) OVER (PARTITION BY hash_class) AS members FROM c", base=False)
def text_classes(spark, d):
    """Every document's class of equal texts (null and blank ones are classes, too) and the class's size."""
    return neardup.text_classes(table(spark, d, "documents"), "doc_id", "text", R.text_shingle)


@query("SELECT canonical_id, source, min_by(url, id) AS url FROM base WHERE canonical_id IS NOT NULL AND url IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY canonical_id) > 1")
def cross_source_links(spark, d):
    """First link of each source for properties on several sources."""
    rows = base(spark, d).filter("canonical_id is not null and url is not null and source is not null")
    links = rows.groupBy("canonical_id", "source").agg(F.min_by("url", "id").alias("url"))
    several = links.groupBy("canonical_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("canonical_id")
    return links.join(several, "canonical_id", "left_semi")


@query(
    """SELECT id, CASE WHEN coalesce(year_built, 0) = 0 THEN 'unknown' WHEN year_built < 1960 THEN '<1960' WHEN year_built >= 2020 THEN '>=2020' ELSE CAST(year_built // 10 * 10 AS VARCHAR) || 's' END AS decade,
    CASE WHEN area_sqm IS NULL THEN NULL WHEN area_sqm < 45 THEN '<45' WHEN area_sqm < 60 THEN '45-60' WHEN area_sqm < 80 THEN '60-80' WHEN area_sqm < 100 THEN '80-100' WHEN area_sqm < 130 THEN '100-130' ELSE '130+' END AS size_bucket,
    coalesce(image_count, CASE WHEN image_url IS NOT NULL THEN 1 ELSE 0 END) AS photos, coalesce(nullif(canonical_id, ''), source || ':' || source_id) AS identity,
    regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS link, substr(md5(concat_ws('_', source, source_id)), 1, 16) AS digest FROM base"""
)
def scalar_features(spark, d):
    """Buckets, counts, identities and links of each listing."""
    c = F.col
    return base(spark, d).select(
        "id", S.decade(c("year_built")).alias("decade"), S.size_bucket(c("area_sqm")).alias("size_bucket"), S.photo_count(c("image_count"), F.lit(None).cast("string"), c("image_url")).alias("photos"),
        S.identity(c("canonical_id"), c("source"), c("source_id")).alias("identity"), S.clean_url(c("url")).alias("link"), S.canonical_id(F.concat_ws("_", "source", "source_id")).alias("digest"),
    )


@query("SELECT id, x.side AS side FROM (SELECT id, unnest(CASE WHEN json_valid(exposure) AND json_type(exposure::JSON) = 'ARRAY' THEN from_json(exposure::JSON, '[\"VARCHAR\"]') END) AS side FROM base WHERE json_valid(exposure)) x WHERE x.side IS NOT NULL")
def exposure_sides(spark, d):
    """Sides of the JSON lists of exposures; malformed JSON gives none."""
    return base(spark, d).select("id", F.explode(S.json_list(F.col("exposure"))).alias("side")).filter("side is not null")


@query("SELECT id, CASE WHEN json_valid(llm_extract) AND nullif(substr(lower(trim(json_extract_string(llm_extract, '$.view'))), 1, 80), '') IS NOT NULL THEN substr(lower(trim(json_extract_string(llm_extract, '$.view'))), 1, 80) ELSE 'unknown' END AS view FROM base")
def json_views(spark, d):
    """View out of the JSON objects; missing or malformed is unknown."""
    return base(spark, d).select("id", S.json_text(F.col("llm_extract"), "$.view").alias("view"))


@query(
    """, tr AS (SELECT * FROM uniq WHERE listing_kind = 'sale' AND property_type IN ('apartment', 'studio', 'maisonette') AND area_sqm BETWEEN 20 AND 500 AND price_per_sqm_eur BETWEEN 700 AND 15000 AND first_seen IS NOT NULL)
    SELECT neighborhood, round((avg(price_per_sqm_eur) * count(*) + (SELECT median(price_per_sqm_eur) FROM tr) * 20) / (count(*) + 20), 4) AS encoded_place FROM tr GROUP BY 1"""
)
def smoothed_places(spark, d):
    """Target encoding of places, drawn to the global median."""
    return rounded(hedonic.smoothed_target(training(spark, d), "neighborhood", "price_per_sqm_eur", R.smoothing), "encoded_place")


@query()
def hedonic_scores(spark, d):
    """Fair value and residual of every listing like the training rows, with its five largest effects."""
    train = training(spark, d)
    encoded = hedonic.smoothed_target(train, "neighborhood", "price_per_sqm_eur", R.smoothing)
    ready = lambda rows: hedonic.features(rows, encoded, "neighborhood", 2026).withColumn("target", F.log("price_per_sqm_eur"))
    model = hedonic.fit(ready(train), "target", R.ridge_alpha)
    rows = sale(spark, d).filter(F.col("property_type").isin(*R.apartment_like) & (F.col("area_sqm") > 0) & (F.col("price_per_sqm_eur") > 0))
    scored = hedonic.score(ready(rows), model, "price_per_sqm_eur")
    return scored.select("id", "predicted_per_sqm", "residual_percent", hedonic.contributions(scored, model).alias("contributions"))


@query()
def hedonic_holdout(spark, d):
    """Error of the model and of the tiered medians on the newest 30 days, trained on the rest."""
    old, new = hedonic.time_split(training(spark, d), "first_seen", 30)
    encoded = hedonic.smoothed_target(old, "neighborhood", "price_per_sqm_eur", R.smoothing)
    ready = lambda rows: hedonic.features(rows, encoded, "neighborhood", 2026).withColumn("target", F.log("price_per_sqm_eur"))
    model = hedonic.fit(ready(old), "target", R.ridge_alpha)
    ours = hedonic.quality(hedonic.score(ready(new), model, "price_per_sqm_eur"), "price_per_sqm_eur", "predicted_per_sqm").select(F.lit("ridge").alias("model"), "*")
    theirs = hedonic.quality(hedonic.baseline(new, old, TIERS, "price_per_sqm_eur"), "price_per_sqm_eur", "baseline").select(F.lit("tiered median").alias("model"), "*")
    return ours.unionByName(theirs)


@query(
    f""", k AS (SELECT *, CASE WHEN n LIKE '359%' AND length(n) BETWEEN 11 AND 12 THEN '+' || n END AS phone FROM (SELECT *, {_DIGITS} AS n FROM uniq WHERE listing_kind = 'sale')),
    f AS (SELECT phone, count(DISTINCT coalesce(nullif(canonical_id, ''), source || ':' || source_id)) AS ads FROM k WHERE is_active AND phone IS NOT NULL GROUP BY 1),
    z AS (SELECT listing_id, min(zscore) FILTER (WHERE alert_type = 'underpriced') AS z FROM al GROUP BY 1),
    s AS (SELECT id, 30 * CAST(coalesce(residual_pct < -35 OR z < -3, false) AS INT) + 25 * CAST(coalesce(seller_type = 'private' AND ads >= 15, false) AS INT) + 10 * CAST(coalesce(image_count, 0) <= 1 AS INT)
        + 10 * CAST(floor IS NULL AND year_built IS NULL AS INT) AS penalty FROM k LEFT JOIN f ON f.phone = k.phone LEFT JOIN z ON z.listing_id = k.id WHERE is_active)
    SELECT id, CAST(greatest(0, 100 - penalty) AS INT) AS score FROM s"""
)
def authenticity_scores(spark, d):
    """Score of each active sale by the four signals that its SQL has; :func:`authenticity_composite` has all seven."""
    joined, parts = _own_signals(spark, d)
    return joined.select("id", signals.penalty_score(signals.flagged(parts)).alias("score"))


def _own_signals(spark, d):
    rows = uniq(spark, d).filter("listing_kind = 'sale'").withColumn("phone", S.phone(F.col("contact_phone")))
    who = S.identity(F.col("canonical_id"), F.col("source"), F.col("source_id"))
    ads = rows.filter("is_active and phone is not null").groupBy("phone").agg(F.count_distinct(who).alias("ads"))
    extreme = alerts(spark, d).groupBy(F.col("listing_id").alias("id")).agg(F.min(F.when(F.col("alert_type") == "underpriced", F.col("zscore"))).alias("z"))
    # both grow with the listings, so they are joined by sorting; a missing phone is no key, or all such rows would be one task's
    asked = rows.filter("is_active").withColumn("_k", F.coalesce("phone", F.concat(F.lit("-"), F.col("id").cast("string"))))
    joined = asked.join(ads.withColumnRenamed("phone", "_k").hint("merge"), "_k", "left").join(extreme.hint("merge"), "id", "left")
    return joined, [
        ("price", 30, (F.col("residual_pct") < -35) | (F.col("z") < -3)),
        ("seller footprint", 25, (F.col("seller_type") == "private") & (F.col("ads") >= 15)),
        ("few photos", 10, F.coalesce("image_count", F.lit(0)) <= 1),
        ("no floor, no year", 10, F.col("floor").isNull() & F.col("year_built").isNull()),
    ]


@query()
def authenticity_composite(spark, d):
    """Score and flags of each active sale by all seven signals: also reused photos, reused descriptions and reposts.

    Hashes and the hits of photos and reposts are written, so that each plan is small and nothing that
    grows with the listings is broadcast: the driver holds neither one plan of sixty exchanges nor tables.
    """
    joined, (price, footprint, photos, bare) = _own_signals(spark, d)
    who = S.identity(F.col("canonical_id"), F.col("source"), F.col("source_id"))
    live = sale(spark, d).select("id", "image_phash", "description_full", who.alias("who"), "neighborhood", "price_eur")
    shots = written(live.filter(neardup.valid_hash(F.col("image_phash"))).drop("description_full"), "photos")
    photo = signals.reused(shots, "id", "image_phash", neardup.near_pairs(shots, "id", "image_phash", R.photo_bits), "who", "neighborhood", "price_eur", R.material_delta)
    # texts under twelve words are no descriptions
    long = live.filter(F.size(series.shingles(F.col("description_full"), 12)) > 0).withColumn("_row", F.struct("id", "who"))
    hashes = written(neardup.simhash(long, "_row", series.shingles(F.col("description_full"), 4)).select("_row.*", "simhash"), "descriptions")
    text = signals.reused(hashes, "id", "simhash", neardup.near_pairs(hashes, "id", "simhash", R.text_bits), "who")
    seen = F.col("last_seen") >= now() - F.expr("INTERVAL 90 DAYS")
    pool = uniq(spark, d).filter("listing_kind = 'sale'").filter(F.col("is_active") | seen).withColumn("phone", S.phone(F.col("contact_phone"))).filter("phone is not null")
    # an active ad without a first sight may have come after any other
    pool = pool.withColumn("_area", F.rint(F.coalesce("area_sqm", F.lit(0.0)))).withColumn("first_seen", F.when(F.col("is_active"), F.coalesce("first_seen", F.lit("9999-12-31").cast("timestamp_ntz"))).otherwise(F.col("first_seen")))
    again = signals.reposts(pool, "id", ["source", "phone", "neighborhood", "property_type", "rooms", "_area"], F.col("is_active"), "first_seen", "source_id")
    for name, ids in (("_photo", written(photo, "photo_hits")), ("_text", text), ("_again", written(again, "repost_hits"))):
        joined = joined.join(ids.distinct().withColumn(name, F.lit(True)).hint("merge"), "id", "left")
    flags = signals.flagged([("photo reuse", 35, F.col("_photo")), price, footprint, ("description reuse", 25, F.col("_text")), photos, bare, ("repost", 20, F.col("_again"))])
    return joined.select("id", signals.penalty_score(flags).alias("score"), flags.alias("flags"))


@query(
    f""", k AS (SELECT *, CASE WHEN n LIKE '359%' AND length(n) BETWEEN 11 AND 12 THEN '+' || n END AS phone FROM (SELECT *, {_DIGITS} AS n FROM base WHERE listing_kind = 'sale'))
    SELECT id FROM k a WHERE is_active AND phone IS NOT NULL AND EXISTS (SELECT 1 FROM k b WHERE NOT coalesce(b.is_active, false) AND b.phone = a.phone AND b.neighborhood IS NOT DISTINCT FROM a.neighborhood AND b.property_type IS NOT DISTINCT FROM a.property_type
        AND b.rooms IS NOT DISTINCT FROM a.rooms AND b.source_id <> a.source_id AND (b.first_seen < a.first_seen OR b.first_seen IS NULL))"""
)
def reposted(spark, d):
    """Active sales that an older, withdrawn ad of the same phone, place, type and rooms precedes."""
    rows = base(spark, d).filter("listing_kind = 'sale'").withColumn("phone", S.phone(F.col("contact_phone"))).filter("phone is not null")
    return signals.reposts(rows, "id", ["phone", "neighborhood", "property_type", "rooms"], F.col("is_active"), "first_seen", "source_id")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", base=False)
def events_daily(spark, d):
    """Tumbling windows of one day per event type."""
    rows = table(spark, d, "events")
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT neighborhood, strftime(snapshot_date, '%Y-%m-%d') AS date, median_price_per_sqm, listing_count FROM neighborhood_stats_history", base=False)
def place_history(spark, d):
    """The nested history of each place, ordered and flattened again."""
    rows = table(spark, d, "neighborhood_stats_history")
    nested = rows.groupBy("neighborhood").agg(F.array_sort(F.collect_list(F.struct(F.date_format("snapshot_date", "yyyy-MM-dd").alias("date"), "id", "median_price_per_sqm", "listing_count"))).alias("history"))
    return nested.select("neighborhood", F.explode("history").alias("h")).select("neighborhood", "h.date", "h.median_price_per_sqm", "h.listing_count")


@query("SELECT source, source_id, snapshot_date FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_date DESC) AS r FROM listing_snapshots) WHERE r <= 3", base=False)
def retained_dates(spark, d):
    """Rows of the three newest dates: the dates are ranked, not the rows."""
    rows = table(spark, d, "listing_snapshots")
    newest = rows.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(3)
    return rows.join(F.broadcast(newest), "snapshot_date", "left_semi").select("source", "source_id", "snapshot_date")


@query(
    ORACLES["source_drift"].replace("SELECT source, field, round(value, 4)", ", d AS (SELECT source, field, round(value, 4)")
    + """), i AS (SELECT source, 100.0 * count(image_url) / count(*) AS pct FROM listings WHERE is_active AND NOT coalesce(is_duplicate, false) GROUP BY 1),
    s AS (SELECT status FROM d UNION ALL SELECT CASE WHEN pct < 30 THEN 'red' WHEN pct < 60 THEN 'amber' ELSE 'green' END FROM i)
    SELECT CASE WHEN bool_or(status = 'red') THEN 'red' WHEN bool_or(status = 'amber') THEN 'amber' ELSE 'green' END AS status, count(*) AS checks FROM s""",
    base=False,
)
def health_status(spark, d):
    """The worst colour of all drift and coverage checks."""
    return signals.worst(source_drift(spark, d).select("status").unionByName(image_coverage(spark, d).select("status")))


@query("SELECT id, authenticity_score FROM active WHERE authenticity_score IS NOT NULL ORDER BY authenticity_score, id LIMIT 20")
def lowest_scores(spark, d):
    return active(spark, d).filter("authenticity_score is not null").orderBy("authenticity_score", "id").limit(20).select("id", "authenticity_score")


@query("SELECT id, source, price_eur FROM active WHERE listing_kind = 'auction' AND first_seen >= TIMESTAMP '2026-03-26' - INTERVAL 30 DAY ORDER BY first_seen DESC, id LIMIT 8")
def auction_watch(spark, d):
    rows = active(spark, d).filter((F.col("listing_kind") == "auction") & (F.col("first_seen") >= now() - F.expr("INTERVAL 30 DAYS")))
    return rows.orderBy(F.desc("first_seen"), "id").limit(8).select("id", "source", "price_eur")


@query("SELECT id FROM active WHERE image_url IS NOT NULL AND image_phash IS NULL ORDER BY first_seen DESC NULLS LAST, id LIMIT 100")
def hash_queue(spark, d):
    return active(spark, d).filter("image_url is not null and image_phash is null").orderBy(F.desc("first_seen"), "id").limit(100).select("id")


@query(
    """, t AS (SELECT s.id, s.image_url, s.llm_extract, a.id AS aid, a.savings_pct FROM sale s JOIN al a ON a.listing_id = s.id WHERE a.savings_pct > 0 ORDER BY a.savings_pct DESC, a.id LIMIT 25)
    SELECT id, savings_pct FROM t WHERE image_url IS NOT NULL ORDER BY savings_pct DESC, aid LIMIT 1"""
)
def top_pick(spark, d):
    """The best of the 25 largest savings that has a photo: the gate comes after the cut."""
    a = alerts(spark, d).filter("savings_pct > 0").select(F.col("id").alias("aid"), "listing_id", "savings_pct")
    cut = sale(spark, d).select("id", "image_url").join(a, F.col("id") == F.col("listing_id")).orderBy(F.desc("savings_pct"), "aid").limit(25)
    return cut.filter("image_url is not null").orderBy(F.desc("savings_pct"), "aid").limit(1).select("id", "savings_pct")


@query("SELECT neighborhood, count(DISTINCT s.id) AS deals FROM sale s JOIN al a ON a.listing_id = s.id WHERE a.alert_type = 'underpriced' AND a.zscore <= -1.5 GROUP BY 1")
def deals_per_place(spark, d):
    """Deals per place: a listing with several alerts counts once (semi-join)."""
    deals = alerts(spark, d).filter((F.col("alert_type") == "underpriced") & (F.col("zscore") <= R.z_limit)).select(F.col("listing_id").alias("id"))
    return sale(spark, d).select("id", "neighborhood").join(deals, "id", "left_semi").groupBy("neighborhood").agg(F.count("*").alias("deals"))


@query("SELECT count(*) AS listings, round(avg(round(price_per_sqm_eur)), 4) AS mean, median(round(price_per_sqm_eur)) AS median, count(*) FILTER (WHERE first_seen >= TIMESTAMP '2026-03-19') AS new_week, count(*) FILTER (WHERE authenticity_score < 50) AS red, count(*) FILTER (WHERE authenticity_score BETWEEN 50 AND 79) AS amber FROM sane")
def city_totals(spark, d):
    """Totals of the city, from rounded prices as they are shown."""
    p, s = F.round("price_per_sqm_eur"), F.col("authenticity_score")
    return sane(spark, d).agg(
        F.count("*").alias("listings"), F.round(F.avg(p), 4).alias("mean"), F.median(p).alias("median"), F.count_if(F.col("first_seen") >= now() - F.expr("INTERVAL 7 DAYS")).alias("new_week"),
        F.count_if(s < 50).alias("red"), F.count_if(s.between(50, 79)).alias("amber"),
    )


@query(
    """, tr AS (SELECT *, nullif(rooms, 0) AS rm, nullif(total_floors, 0) AS tf, 2026 - nullif(year_built, 0) AS age FROM uniq WHERE listing_kind = 'sale' AND property_type IN ('apartment', 'studio', 'maisonette') AND area_sqm BETWEEN 20 AND 500 AND price_per_sqm_eur BETWEEN 700 AND 15000 AND first_seen IS NOT NULL)
    SELECT * FROM (SELECT 'log_area' AS feature, round(avg(ln(area_sqm)), 6) AS mean, round(stddev_pop(ln(area_sqm)), 6) AS std FROM tr UNION ALL SELECT 'rooms', round(avg(rm), 6), round(stddev_pop(rm), 6) FROM tr
    UNION ALL SELECT 'floor_share', round(avg(floor / CAST(tf AS DOUBLE)), 6), round(stddev_pop(floor / CAST(tf AS DOUBLE)), 6) FROM tr UNION ALL SELECT 'age', round(avg(age), 6), round(stddev_pop(age), 6) FROM tr UNION ALL SELECT 'area_rooms', round(avg(area_sqm * rm), 6), round(stddev_pop(area_sqm * rm), 6) FROM tr)"""
)
def feature_moments(spark, d):
    """Means and population deviations of model features, in one pass."""
    train = training(spark, d)
    rows = hedonic.features(train, hedonic.smoothed_target(train, "neighborhood", "price_per_sqm_eur", R.smoothing), "neighborhood", 2026)
    names = ["log_area", "rooms", "floor_share", "age", "area_rooms"]
    one = rows.agg(*[F.struct(F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std")).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std")) for c in names])).alias("x")).select("x.*")


@query(_STATS + "SELECT n.name FROM neighborhoods n WHERE NOT EXISTS (SELECT 1 FROM stats s WHERE s.neighborhood = n.name)")
def unpublished_places(spark, d):
    """Reference places without published statistics (set difference)."""
    return table(spark, d, "neighborhoods").select("name").join(stats(spark, d).select(F.col("neighborhood").alias("name")), "name", "left_anti")


@query(
    """WITH k AS (SELECT DISTINCT source, lower(trim(source_id)) AS sid, snapshot_date AS t FROM listing_snapshots WHERE source_id IS NOT NULL),
    g AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t > lag(t) OVER w + INTERVAL 14 DAY THEN 1 ELSE 0 END AS s FROM k WINDOW w AS (PARTITION BY source, sid ORDER BY t)), n AS (SELECT *, sum(s) OVER (PARTITION BY source, sid ORDER BY t) AS i FROM g)
    SELECT source, sid AS source_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS dates FROM n GROUP BY source, sid, i""",
    base=False,
)
def presence_spans(spark, d):
    """Spans in which an ad was there without a gap of 14 days (session windows)."""
    rows = table(spark, d, "listing_snapshots").select("source", F.lower(F.trim("source_id")).alias("source_id"), F.col("snapshot_date").cast("timestamp").alias("t")).filter("source_id is not null").distinct()
    spans = rows.groupBy("source", "source_id", F.session_window("t", "14 days")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("dates"))
    return spans.select("source", "source_id", F.col("a").cast("timestamp_ntz").alias("first_seen"), F.col("b").cast("timestamp_ntz").alias("last_seen"), "dates")


@query("SELECT user_id, min(ts) AS first_ts, count(*) AS events, count(DISTINCT event_type) AS kinds, max(value) AS best FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) >= 50 GROUP BY 1", base=False)
def event_users(spark, d):
    """Events filtered by a JSON number, per user."""
    rows = table(spark, d, "events").filter(F.get_json_object("props", "$.k").try_cast("int") >= 50)
    return rows.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("best"))
