"""Queries of places, sellers, exits, text attributes and model checks, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickstream.functions import scalars as S
from brickstream.operators import dedup, hedonic, neardup, series
from brickstream.plans import reference as ref
from brickstream.rules import DEFAULT as R
from brickstream.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, base: bool = True):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, (ref._BASE if base else "") + sql
        return f

    return register


def _latin(text: str) -> str:
    """SQL of the transliteration that :func:`scalars.cyrillic_word` does."""
    out = f"replace(replace(replace({text}, 'tsk', chr(1)), 'ts', 'ц'), chr(1), 'tsk')"
    for a, b in S.LATIN_GROUPS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"translate({out}, '{S.LATIN_LETTERS}', '{S.CYRILLIC_LETTERS}')"
    return f"replace(replace({out}, 'x', 'кс'), 'q', 'к')"


@query(
    f"""WITH t AS (SELECT id, trim(regexp_replace(trim(regexp_replace(trim(replace(neighborhood, chr(160), ' ')), '^(?i:гр|с|ж\\.?к|кв|м-т)\\.?\\s+', '')), '[.,;: ]+$', '')) AS c FROM listings),
    u AS (SELECT id, c, regexp_matches(c, '[а-яА-Я]') AS cyrillic, CASE WHEN trim(regexp_replace(c, '^(?i:dabringrad)\\s+', '')) = '' THEN c ELSE trim(regexp_replace(c, '^(?i:dabringrad)\\s+', '')) END AS l FROM t),
    v AS (SELECT id, c, CASE WHEN cyrillic THEN c WHEN lower(l) = 'center' THEN 'Център' WHEN lower(l) LIKE 'center %' THEN 'Център' || substr(l, 7)
        WHEN lower(l) = 'lulin' THEN 'Люлин' WHEN lower(l) LIKE 'lulin %' THEN 'Люлин' || substr(l, 6) ELSE {_latin("lower(l)")} END AS n FROM u),
    w AS (SELECT id, c, regexp_replace(n, '\\s+', ' ', 'g') AS n FROM v)
    SELECT w.id, CASE WHEN coalesce(w.c, '') = '' OR length(w.c) > 40 OR regexp_matches(w.c, '(?i)снимки|продава|обява|€|лв\\.|кв\\.?\\s*м') THEN 'Unknown' ELSE coalesce(k.name, upper(substr(w.n, 1, 1)) || lower(substr(w.n, 2))) END AS place
    FROM w LEFT JOIN neighborhoods k ON lower(k.name) = lower(w.n)""",
    base=False,
)
def place_names(spark, d):
    """Canonical form of each typed place: prefixes off, Latin spelled in Cyrillic, junk ``Unknown``, known names in their own casing."""
    known = table(spark, d, "neighborhoods").select(F.lower("name").alias("_key"), F.col("name").alias("_name"))
    rows = table(spark, d, "listings").select("id", S.place_form(F.col("neighborhood"), "dabringrad").alias("_form"))
    named = rows.join(known, F.lower("_form") == F.col("_key"), "left")
    return named.select("id", F.coalesce("_name", S.sentence_case(F.col("_form")), F.lit("Unknown")).alias("place"))


@query(
    """, cuts AS (SELECT listing_id, max(recorded_at) AS last_cut FROM price_history WHERE recorded_at IS NOT NULL GROUP BY 1),
    dom AS (SELECT s.*, CASE WHEN days_on_market IS NOT NULL THEN greatest(0, days_on_market) ELSE coalesce(greatest(0, datesub('day', first_seen, TIMESTAMP '2026-03-26')), 0) END AS dom FROM sale s),
    hood AS (SELECT neighborhood, median(dom) AS m FROM dom GROUP BY 1),
    p AS (SELECT d.id, least(greatest(coalesce(price_changes, 0), 0) * 8, 25) AS a,
        least(CASE WHEN first_price_eur > 0 AND price_eur IS NOT NULL THEN greatest(0.0, (first_price_eur - price_eur) / first_price_eur * 100) ELSE 0.0 END * 1.5, 30) AS b,
        CASE WHEN coalesce(price_changes, 0) > 0 AND last_cut IS NOT NULL THEN CASE WHEN greatest(0, datesub('day', last_cut, TIMESTAMP '2026-03-26')) <= 7 THEN 20 WHEN greatest(0, datesub('day', last_cut, TIMESTAMP '2026-03-26')) <= 30 THEN 14 WHEN greatest(0, datesub('day', last_cut, TIMESTAMP '2026-03-26')) <= 60 THEN 7 ELSE 0 END ELSE 0 END AS c,
        CASE WHEN h.m > 0 THEN CASE WHEN dom / h.m >= 2 THEN 25 WHEN dom / h.m >= 1.5 THEN 18 WHEN dom / h.m >= 1 THEN 10 ELSE 0 END ELSE 0 END AS e
        FROM dom d LEFT JOIN cuts ON cuts.listing_id = d.id LEFT JOIN hood h ON h.neighborhood IS NOT DISTINCT FROM d.neighborhood)
    SELECT id, CAST(least(100, floor(a + b + c + e + 0.5)) AS INT) AS motivated_score FROM p"""
)
def seller_motivation(spark, d):
    """Score of 0 to 100 from price changes, the cut so far, how recent the last cut is and the time on the market against the place's median."""
    rows = ref.sale(spark, d).select("id", "neighborhood", "price_changes", "first_price_eur", "price_eur", "days_on_market", "first_seen")
    dom = F.when(F.col("days_on_market").isNotNull(), F.greatest("days_on_market", F.lit(0))).otherwise(F.coalesce(S.whole_days(ref.now(), F.col("first_seen")), F.lit(0)))
    rows = rows.withColumn("_dom", dom)
    hood = rows.groupBy(F.col("neighborhood").alias("_hood")).agg(F.median("_dom").alias("_median"))
    cuts = table(spark, d, "price_history").groupBy(F.col("listing_id").alias("_listing")).agg(F.max("recorded_at").alias("_cut"))
    out = rows.join(cuts, F.col("id") == F.col("_listing"), "left").join(hood, F.col("neighborhood").eqNullSafe(F.col("_hood")), "left")
    since = F.when(F.col("_cut").isNotNull(), S.whole_days(ref.now(), F.col("_cut")))
    return out.select("id", S.motivation(F.col("price_changes"), F.col("first_price_eur"), F.col("price_eur"), since, F.col("_dom"), F.col("_median")).alias("motivated_score"))


_EXITS = """, l AS (SELECT *, coalesce(nullif(neighborhood, ''), 'Unknown') AS hood, coalesce(first_seen >= TIMESTAMP '2026-03-19', false) AS is_new, coalesce(is_sold, false) AS sold, coalesce(is_sold AND sold_date >= TIMESTAMP '2026-03-19', false) AS is_exit
    FROM uniq WHERE listing_kind = 'sale')"""


def _exits(spark, d) -> DataFrame:
    rows = ref.uniq(spark, d).filter("listing_kind = 'sale'")
    week = ref.now() - F.expr("INTERVAL 7 DAYS")
    false = F.lit(False)
    return rows.withColumns(
        {
            "hood": F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit("Unknown")),
            "is_new": F.coalesce(F.col("first_seen") >= week, false),
            "sold": F.coalesce("is_sold", false),
            "is_exit": F.coalesce(F.col("is_sold") & (F.col("sold_date") >= week), false),
        }
    )


@query(
    _EXITS
    + """, g AS (SELECT hood AS neighborhood, count(*) FILTER (WHERE sold) AS exit_count, count(*) FILTER (WHERE is_new) AS weekly_new, count(*) FILTER (WHERE is_exit) AS weekly_exits,
        median(price_per_sqm_eur) FILTER (WHERE sold AND price_per_sqm_eur > 0) AS p, median(greatest(0.0, (first_price_eur - price_eur) / first_price_eur * 100)) FILTER (WHERE sold AND first_price_eur > 0 AND price_eur IS NOT NULL) AS c,
        median(days_on_market) FILTER (WHERE sold AND days_on_market IS NOT NULL) AS m FROM l GROUP BY 1)
    SELECT neighborhood, exit_count, weekly_new, weekly_exits, round(weekly_exits / nullif(weekly_new, 0), 2) AS absorption, CASE WHEN exit_count >= 10 THEN p END AS exit_price, CASE WHEN exit_count >= 10 THEN c END AS exit_discount, CASE WHEN exit_count >= 10 THEN m END AS exit_days
    FROM g WHERE exit_count + weekly_new > 0"""
)
def market_absorption(spark, d):
    """Exits and new rows of the week per place and their ratio; medians of exits where there are ten or more."""
    sold, c = F.col("sold"), F.col
    cut = F.when(c("first_price_eur") > 0, F.greatest(F.lit(0.0), (c("first_price_eur") - c("price_eur")) / c("first_price_eur") * 100))
    enough = lambda m: F.when(c("exit_count") >= R.min_exits, c(m))
    g = _exits(spark, d).groupBy(c("hood").alias("neighborhood")).agg(
        F.count_if(sold).alias("exit_count"), F.count_if("is_new").alias("weekly_new"), F.count_if("is_exit").alias("weekly_exits"),
        F.median(F.when(sold & (c("price_per_sqm_eur") > 0), c("price_per_sqm_eur"))).alias("_p"), F.median(F.when(sold & c("price_eur").isNotNull(), cut)).alias("_c"), F.median(F.when(sold, c("days_on_market"))).alias("_m"),
    )
    ratio = F.round(c("weekly_exits") / F.nullif("weekly_new", F.lit(0)), 2)
    return g.filter("exit_count + weekly_new > 0").select("neighborhood", "exit_count", "weekly_new", "weekly_exits", ratio.alias("absorption"), enough("_p").alias("exit_price"), enough("_c").alias("exit_discount"), enough("_m").alias("exit_days"))


@query(
    _EXITS
    + """, g AS (SELECT count(*) FILTER (WHERE is_new) AS n, count(*) FILTER (WHERE is_exit) AS e FROM l)
    SELECT n AS weekly_new, e AS weekly_exits, round(e / nullif(n, 0), 2) AS absorption, format('{:,}', n) || ' new and ' || format('{:,}', e) || ' gone this week' || coalesce(', ratio ' || printf('%.2f', round(e / nullif(n, 0), 2)), '') AS line FROM g"""
)
def city_absorption(spark, d):
    """The same for the whole city, with one sentence of it."""
    g = _exits(spark, d).agg(F.count_if("is_new").alias("weekly_new"), F.count_if("is_exit").alias("weekly_exits"))
    ratio = F.round(F.col("weekly_exits") / F.nullif("weekly_new", F.lit(0)), 2)
    return g.withColumn("absorption", ratio).withColumn("line", S.pulse(F.col("weekly_new"), F.col("weekly_exits"), F.col("absorption")))


_WORDS = "lower(coalesce(title, '') || ' ' || coalesce(description_full, ''))"


@query(
    f"""WITH t AS (SELECT id, {_WORDS} AS t FROM listings)
    SELECT id, CASE WHEN regexp_matches(t, '1-стаен|едностаен') THEN 1 WHEN regexp_matches(t, '2-стаен|двустаен') THEN 2 WHEN regexp_matches(t, '3-стаен|тристаен') THEN 3 WHEN regexp_matches(t, '4-стаен|четиристаен') THEN 4 WHEN regexp_matches(t, 'многостаен') THEN 5 END AS rooms,
        CASE WHEN contains(t, 'партер') THEN 0 ELSE TRY_CAST(nullif(regexp_extract(t, '([0-9]+)(?:-ти|-ви|-ри)?\\s*ет\\.?\\s*от\\s*([0-9]+)', 1), '') AS INT) END AS floor,
        TRY_CAST(nullif(CASE WHEN contains(t, 'партер') THEN regexp_extract(t, 'от\\s*([0-9]+)', 1) ELSE regexp_extract(t, '([0-9]+)(?:-ти|-ви|-ри)?\\s*ет\\.?\\s*от\\s*([0-9]+)', 2) END, '') AS INT) AS total_floors,
        CASE WHEN contains(t, 'тухла') THEN 'brick' WHEN contains(t, 'панел') THEN 'panel' WHEN contains(t, 'епк') THEN 'epk' END AS construction,
        CASE WHEN contains(t, 'тец') THEN 'central' WHEN contains(t, 'лок') AND contains(t, 'отопл') THEN 'local' WHEN contains(t, 'газ') THEN 'gas' WHEN contains(t, 'електр') THEN 'electric' END AS heating,
        CASE WHEN TRY_CAST(nullif(regexp_extract(t, '(?:експлоатация|въведен в)\\s*([0-9]{{4}})\\s*г', 1), '') AS INT) BETWEEN 1950 AND 2030 THEN TRY_CAST(nullif(regexp_extract(t, '(?:експлоатация|въведен в)\\s*([0-9]{{4}})\\s*г', 1), '') AS INT) END AS year,
        CASE WHEN contains(t, 'необзаведен') THEN 'unfurnished' WHEN contains(t, 'обзаведен') AND contains(t, 'полу') THEN 'partial' WHEN contains(t, 'обзаведен') THEN 'furnished' END AS furnishing FROM t""",
    base=False,
)
def text_attributes(spark, d):
    """Rooms, floors, construction, heating, year and furnishing as the words of title and description tell them."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description_full", F.lit(""))))
    return table(spark, d, "listings").select("id", text.alias("_t")).select("id", *S.attributes_in_text(F.col("_t")))


@query(
    """WITH t AS (SELECT id, coalesce(json_valid(llm_extract), false) AS valid, CASE WHEN json_valid(llm_extract) THEN llm_extract END AS j FROM listings)
    SELECT id, valid, CASE WHEN length(json_extract_string(j, '$.view')) > 160 THEN left(json_extract_string(j, '$.view'), 157) || '...' ELSE json_extract_string(j, '$.view') END AS view, len(json_keys(j)) AS keys FROM t""",
    base=False,
)
def extract_fields(spark, d):
    """What the stored extraction holds; a malformed one is not valid and empty."""
    parsed = F.try_parse_json("llm_extract")
    rows = table(spark, d, "listings").select("id", parsed.isNotNull().alias("valid"), F.when(parsed.isNotNull(), F.col("llm_extract")).alias("_j"))
    return rows.select("id", "valid", S.clipped(F.get_json_object("_j", "$.view"), 160).alias("view"), F.size(F.json_object_keys("_j")).alias("_n"), F.col("_j").isNotNull().alias("_there")).select("id", "valid", "view", F.when(F.col("_there"), F.col("_n")).alias("keys"))


@query(
    """WITH t AS (SELECT id, CASE WHEN json_valid(exposure) THEN CAST(exposure AS VARCHAR[]) ELSE [] END AS l FROM listings WHERE exposure IS NOT NULL)
    SELECT id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '+') AS sides, list_contains(l, 'south') AS has_south, coalesce(list_has_all(l, ['east', 'west']), false) AS both_ends FROM t""",
    base=False,
)
def exposure_arrays(spark, d):
    """Different sides in their order, and membership."""
    rows = table(spark, d, "listings").filter("exposure is not null").select("id", S.json_list(F.col("exposure")).alias("l"))
    both = F.size(F.array_intersect("l", F.array(F.lit("east"), F.lit("west")))) == 2
    return rows.select("id", F.array_join(F.array_distinct("l"), "+").alias("sides"), F.array_contains("l", "south").alias("has_south"), both.alias("both_ends"))


@query(
    ref._FP
    + f", w AS (SELECT source, row_number() OVER (PARTITION BY fp ORDER BY {ref._PRIO}, {ref._FILLED} DESC, id) = 1 AS won FROM fp) SELECT source, count(*) AS listings, count(*) FILTER (WHERE NOT won) AS lost FROM w GROUP BY 1"
)
def dedup_by_source(spark, d):
    """How many rows of each source lose to another row of their property."""
    rows = ref.fingerprinted(spark, d)
    rows = rows.withColumns({"_p": dedup.priorities(F.col("source"), ref.PRIORITY), "_f": dedup.filled_count(rows, ref.FILL)})
    judged = dedup.winners(rows, "fp", "_p", "_f", "id").select("id", "is_winner")
    return rows.select("id", "source").join(judged, "id").groupBy("source").agg(F.count("*").alias("listings"), F.count_if(~F.col("is_winner")).alias("lost"))


@query(
    """SELECT id, round((price_per_sqm_eur - predicted_price_per_sqm) / predicted_price_per_sqm * 100, 3) AS gap_pct, residual_pct <= -15 AS is_deal FROM sale
    WHERE property_type IN ('apartment', 'studio', 'maisonette') AND price_eur >= 5000 AND area_sqm BETWEEN 20 AND 500 AND predicted_price_per_sqm <> 0 AND residual_pct IS NOT NULL"""
)
def model_gaps(spark, d):
    """Gap between price and stored prediction of each home, and whether the stored residual makes it a deal."""
    rows = ref.sale(spark, d).filter(F.col("property_type").isin(*R.apartment_like) & (F.col("price_eur") >= R.min_price) & ref.plausible() & (F.col("predicted_price_per_sqm") != 0) & F.col("residual_pct").isNotNull())
    gap = (F.col("price_per_sqm_eur") - F.col("predicted_price_per_sqm")) / F.col("predicted_price_per_sqm") * 100
    return rows.select("id", F.round(gap, 3).alias("gap_pct"), (F.col("residual_pct") <= R.deal_residual).alias("is_deal"))


@query(
    """, train AS (SELECT * FROM uniq WHERE listing_kind = 'sale' AND property_type IN ('apartment', 'studio', 'maisonette') AND area_sqm BETWEEN 20 AND 500 AND price_per_sqm_eur BETWEEN 700 AND 15000 AND first_seen IS NOT NULL),
    cut AS (SELECT max(first_seen) - INTERVAL 30 DAY AS c FROM train), early AS (SELECT train.* FROM train, cut WHERE first_seen < c), late AS (SELECT train.* FROM train, cut WHERE first_seen >= c AND predicted_price_per_sqm > 0),
    m3 AS (SELECT neighborhood, property_type, construction_type, median(price_per_sqm_eur) AS m FROM early GROUP BY ALL), m2 AS (SELECT neighborhood, property_type, median(price_per_sqm_eur) AS m FROM early GROUP BY ALL),
    m1 AS (SELECT neighborhood, median(price_per_sqm_eur) AS m FROM early GROUP BY ALL),
    b AS (SELECT t.price_per_sqm_eur AS p, t.predicted_price_per_sqm AS q, coalesce(m3.m, m2.m, m1.m, (SELECT median(price_per_sqm_eur) FROM early)) AS m FROM late t
        LEFT JOIN m3 ON m3.neighborhood IS NOT DISTINCT FROM t.neighborhood AND m3.property_type IS NOT DISTINCT FROM t.property_type AND m3.construction_type IS NOT DISTINCT FROM t.construction_type
        LEFT JOIN m2 ON m2.neighborhood IS NOT DISTINCT FROM t.neighborhood AND m2.property_type IS NOT DISTINCT FROM t.property_type LEFT JOIN m1 ON m1.neighborhood IS NOT DISTINCT FROM t.neighborhood)
    SELECT count(*) AS n, round(avg(abs(q - p) / p) * 100, 3) AS model_mae_pct, round(avg(abs(m - p) / p) * 100, 3) AS baseline_mae_pct, coalesce(avg(abs(q - p) / p) < avg(abs(m - p) / p), false) AS gate_passed FROM b"""
)
def holdout_gate(spark, d):
    """Stored predictions of the last 30 days against the medians of the days before: the model ships only if it errs less."""
    train = ref.training(spark, d)
    last = train.agg(F.max("first_seen").alias("_last"))
    dated = train.join(F.broadcast(last), F.col("first_seen") <= F.col("_last")).withColumn("_late", F.col("first_seen") >= F.col("_last") - F.expr("INTERVAL 30 DAYS")).drop("_last")
    late = dated.filter("_late and predicted_price_per_sqm > 0")
    judged = hedonic.baseline(late, dated.filter("not _late"), ref.TIERS, "price_per_sqm_eur")
    p = F.col("price_per_sqm_eur")
    model, base = F.avg(F.abs(F.col("predicted_price_per_sqm") - p) / p), F.avg(F.abs(F.col("baseline") - p) / p)
    return judged.agg(F.count("*").alias("n"), F.round(model * 100, 3).alias("model_mae_pct"), F.round(base * 100, 3).alias("baseline_mae_pct"), F.coalesce(model < base, F.lit(False)).alias("gate_passed"))


_CATEGORY = ", ".join(f"coalesce(nullif(lower(trim({c})), ''), 'unknown') AS {c}" for c in hedonic.CATEGORICAL if c != "decade")
_NULL = lambda c: f"CAST(nullif({c}, 0) AS DOUBLE)"


@query(
    f""", train AS (SELECT * FROM uniq WHERE listing_kind = 'sale' AND property_type IN ('apartment', 'studio', 'maisonette') AND area_sqm BETWEEN 20 AND 500 AND price_per_sqm_eur BETWEEN 700 AND 15000 AND first_seen IS NOT NULL),
    enc AS (SELECT neighborhood, (avg(price_per_sqm_eur) * count(*) + (SELECT median(price_per_sqm_eur) FROM train) * 20.0) / (count(*) + 20.0) AS e FROM train GROUP BY 1)
    SELECT id, round(ln(area_sqm), 6) AS log_area, round(area_sqm * area_sqm, 4) AS area_sq, {_NULL("rooms")} AS rooms, CAST(floor AS DOUBLE) AS floor, CAST(floor AS DOUBLE) * floor AS floor_sq, {_NULL("total_floors")} AS total_floors,
        round(floor / {_NULL("total_floors")}, 6) AS floor_share, CAST(floor = nullif(total_floors, 0) AS DOUBLE) AS top_floor, CAST(floor = 0 AS DOUBLE) AS ground_floor, 2026 - {_NULL("year_built")} AS age,
        round(area_sqm * {_NULL("rooms")}, 4) AS area_rooms, CAST(coalesce(has_elevator, false) AS DOUBLE) AS has_elevator, CAST(coalesce(act16, false) AS DOUBLE) AS act16, round(e, 4) AS encoded_place, CAST(image_count AS DOUBLE) AS photos, {_CATEGORY},
        CASE WHEN coalesce(year_built, 0) = 0 THEN 'unknown' WHEN year_built < 1960 THEN '<1960' WHEN year_built >= 2020 THEN '>=2020' ELSE CAST(CAST(floor(year_built / 10) AS INT) * 10 AS VARCHAR) || 's' END AS decade
    FROM train LEFT JOIN enc USING (neighborhood)"""
)
def hedonic_features(spark, d):
    """The feature matrix of the value model over the training rows."""
    train = ref.training(spark, d)
    encoded = hedonic.smoothed_target(train, "neighborhood", "price_per_sqm_eur", R.smoothing)
    rows = hedonic.features(train, encoded, "neighborhood", 2026)
    names = [c for c in hedonic.NUMERIC if c not in ("area", "age_sq")]
    digits = {"log_area": 6, "area_sq": 4, "floor_share": 6, "area_rooms": 4, "encoded_place": 4}
    return rows.select("id", *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in names], *hedonic.CATEGORICAL)


@query(
    """WITH w AS (SELECT id, regexp_extract_all(lower(description_full), '([\\p{L}\\p{N}_]+)') AS ws FROM listings WHERE description_full IS NOT NULL),
    s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS t FROM w WHERE len(ws) >= 5),
    h AS (SELECT id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM s),
    b AS (SELECT id, r.i AS i, sum(CAST((h >> r.i) & 1 AS BIGINT) * 2 - 1) >= 0 AS one FROM h, range(64) r(i) GROUP BY ALL),
    d AS (SELECT id, i // 4 AS digit, sum(CASE WHEN one THEN 1 << (i % 4) ELSE 0 END) AS v FROM b GROUP BY ALL)
    SELECT id, string_agg(substr('0123456789abcdef', CAST(v AS INT) + 1, 1), '' ORDER BY digit DESC) AS simhash FROM d GROUP BY 1""",
    base=False,
)
def text_simhash(spark, d):
    """64-bit SimHash of the five-word runs of each description."""
    return neardup.simhash(table(spark, d, "listings"), "id", series.shingles(F.col("description_full"), R.text_shingle))


@query("SELECT neighborhood, count(*) AS listings, median(price_per_sqm_eur) AS median FROM sane WHERE neighborhood IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, neighborhood LIMIT 40")
def places_by_count(spark, d):
    """The forty places with the most listings."""
    rows = ref.sane(spark, d).filter("neighborhood is not null").groupBy("neighborhood").agg(F.count("*").alias("listings"), F.median("price_per_sqm_eur").alias("median"))
    return rows.filter(F.col("listings") >= R.min_group).orderBy(F.desc("listings"), "neighborhood").limit(40)


@query(", z AS (SELECT listing_id, min(zscore) AS z FROM al WHERE alert_type = 'underpriced' AND zscore IS NOT NULL GROUP BY 1) SELECT s.id, z.z AS zscore FROM sale s JOIN z ON z.listing_id = s.id ORDER BY z.z, s.id LIMIT 3")
def strongest_deals(spark, d):
    """The three lowest z-scores among active sales, one for each listing."""
    z = ref.alerts(spark, d).filter("alert_type = 'underpriced' and zscore is not null").groupBy(F.col("listing_id").alias("_l")).agg(F.min("zscore").alias("zscore"))
    return ref.sale(spark, d).select("id").join(z, F.col("id") == F.col("_l")).orderBy("zscore", "id").limit(3).select("id", "zscore")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC, id DESC) AS rn FROM ph WHERE recorded_at >= TIMESTAMP '2026-03-26' - INTERVAL 7 DAY)
    SELECT s.id, round((r.price_eur - s.price_eur) / r.price_eur * 100, 3) AS drop_pct FROM sale s JOIN r ON r.listing_id = s.id AND rn = 1 WHERE s.price_eur < r.price_eur AND (r.price_eur - s.price_eur) / r.price_eur * 100 >= 5
    ORDER BY (r.price_eur - s.price_eur) / r.price_eur DESC, s.id LIMIT 8"""
)
def largest_recent_drops(spark, d):
    """The eight largest price drops of the week."""
    rows = ref.recent_price_drops(spark, d)
    exact = (F.col("old_price") - F.col("new_price")) / F.col("old_price")
    return rows.orderBy(exact.desc(), "id").limit(8).select("id", "drop_pct")


@query(
    """SELECT n.name AS neighborhood, count(*) AS n, round((avg(predicted_price_per_sqm) - n.avg_price_per_sqm) / n.avg_price_per_sqm * 100, 3) AS delta_pct FROM sale s JOIN neighborhoods n ON n.name = s.neighborhood
    WHERE predicted_price_per_sqm IS NOT NULL AND n.avg_price_per_sqm > 0 GROUP BY n.name, n.avg_price_per_sqm HAVING count(*) >= 5"""
)
def predictions_against_benchmark(spark, d):
    """Mean stored prediction of each place against the benchmark's mean."""
    bench = ref.clean(table(spark, d, "neighborhoods")).filter("avg_price_per_sqm > 0").select(F.col("name").alias("_n"), "avg_price_per_sqm")
    ours = ref.sale(spark, d).filter("predicted_price_per_sqm is not null").groupBy("neighborhood").agg(F.count("*").alias("n"), F.avg("predicted_price_per_sqm").alias("_p")).filter(F.col("n") >= R.min_group)
    delta = (F.col("_p") - F.col("avg_price_per_sqm")) / F.col("avg_price_per_sqm") * 100
    return ours.join(bench, F.col("neighborhood") == F.col("_n")).select("neighborhood", "n", F.round(delta, 3).alias("delta_pct"))


@query("SELECT a.id AS alert_id, s.id, a.alert_type, s.price_eur FROM al a JOIN sale s ON s.id = a.listing_id WHERE a.sent_at IS NULL")
def unsent_alerts(spark, d):
    """Alerts that weren't sent yet, of active sales."""
    a = ref.alerts(spark, d).filter("sent_at is null").select(F.col("id").alias("alert_id"), "listing_id", "alert_type")
    return ref.sale(spark, d).select("id", "price_eur").join(a, F.col("id") == F.col("listing_id")).select("alert_id", "id", "alert_type", "price_eur")


@query(
    """WITH c AS (SELECT CAST(snapshot_date AS DATE) AS day, source, count(*) AS n, count(DISTINCT lower(trim(source_id))) AS ads FROM listing_snapshots WHERE snapshot_date IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS before FROM c) SELECT day, source, n, ads, coalesce(n < 0.5 * before, false) AS thin FROM p""",
    base=False,
)
def write_checks(spark, d):
    """Rows and ads that each source delivered on each date, and whether it was less than half of the delivery before."""
    rows = table(spark, d, "listing_snapshots").filter("snapshot_date is not null").groupBy(F.to_date("snapshot_date").alias("day"), "source")
    counted = rows.agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("source_id"))).alias("ads"))
    before = F.lag("n").over(Window.partitionBy("source").orderBy("day"))
    return counted.select("day", "source", "n", "ads", F.coalesce(F.col("n") < F.lit(0.5) * before, F.lit(False)).alias("thin"))


@query("SELECT id FROM uniq WHERE is_active OR last_seen >= TIMESTAMP '2026-03-26' - INTERVAL 90 DAY")
def seen_recently(spark, d):
    """Rows that are active or were seen within ninety days: the pool of comparisons."""
    return ref.uniq(spark, d).filter(F.col("is_active") | (F.col("last_seen") >= ref.now() - F.expr("INTERVAL 90 DAYS"))).select("id")
