"""Queries over landing files, nested documents and streams.

The landing pages and answers are rendered from the listings, so that parsing them has a
known result for every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickstream.functions import scalars as S
from brickstream.plans import payload
from brickstream.plans import reference as ref
from brickstream.rules import DEFAULT as R
from brickstream.session import shared_dir, table
from brickstream.sources import landing
from brickstream.streaming import streams

CARDS = landing.CardSpec(
    source="portal",
    card="div.card",
    fields={
        "source_id": ("div.card@data-id", "(.+)"),
        "url": ("a@href", "(.+)"),
        "title": ("a.title", "(.+)"),
        "price": ("span.price", "([0-9][0-9 .,]*)"),
        "currency": ("span.price", "(€|EUR|лв)"),
        "area_sqm": ("param:площ", "([0-9][0-9 .,]*)"),
        "rooms": ("param:стаи", "(\\d+)"),
        "floor": ("param:етаж", "(.+)"),
        "image_url": ("img@src", "(.+)"),
    },
    params=("td.label", "td.value"),
)


def _escaped(c):
    return F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """List pages of twenty cards."""
    c, e = F.col, _escaped
    price = F.format_string("%.2f", c("price_eur"))
    card = F.concat(
        F.lit('<div class="card big" data-id="'), e(c("source_id")), F.lit('"><a class="title" href="'), e(c("url")), F.lit('">'), e(c("title")), F.lit("</a><br>"),
        F.when(c("image_url").isNotNull(), F.concat(F.lit('<img src="'), e(c("image_url")), F.lit('">'))).otherwise(""), F.lit('<span class="price">'), F.coalesce(price, F.lit("при запитване")), F.lit(" €</span><table>"),
        F.lit('<tr><td class="label">Площ:</td><td class="value">'), F.coalesce(c("area_sqm").cast("string"), F.lit("-")), F.lit(" кв.м</td></tr>"),
        F.lit('<tr><td class="label">Стаи</td><td class="value">'), e(c("rooms")), F.lit("</td></tr>"), F.lit('<tr><td class="label">Етаж</td><td class="value">'), e(c("floor")), F.lit("</td></tr></table></div>"),
    )
    rows = ref.base(spark, d).select(F.floor(c("id") / 20).alias("page"), card.alias("card"))
    return rows.groupBy("page").agg(F.concat(F.lit("<html><style>.x{}</style><body>"), F.array_join(F.collect_list("card"), "<hr>"), F.lit("</body></html>")).alias("html")).select(F.encode("html", "UTF-8").alias("content"))


def source_html_cards(spark: SparkSession, d: str) -> DataFrame:
    return landing.html_cards(pages(spark, d), CARDS).select("source_id", "url", "title", F.round("price", 2).alias("price"), F.round("area_sqm", 2).alias("area_sqm"), "rooms", "floor", "image_url", "reject")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """API answers of fifty offers with key and value parameters."""
    c = F.col
    param = lambda name, **v: F.struct(F.lit(name).alias("key"), F.struct(*[v.get(f, F.lit(None).cast("double" if f == "value" else "string")).alias(f) for f in ("key", "label", "value", "currency")]).alias("value"))
    offer = F.struct(
        c("source_id").alias("id"), c("url"), c("title"), (c("seller_type") == "agency").alias("business"), F.struct(F.struct(c("neighborhood").alias("name")).alias("district")).alias("location"),
        F.array(
            param("price", value=c("price_eur"), currency=F.lit("EUR")), param("space", label=F.concat(c("area_sqm").cast("string"), F.lit(" м²"))), param("rooms", label=c("rooms").cast("string")), param("type", key=c("property_type"))
        ).alias("params"),
    )
    rows = ref.base(spark, d).select(F.floor(c("id") / 50).alias("page"), F.to_json(offer).alias("o"))
    text = rows.groupBy("page").agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list("o"), ","), F.lit("]}")).alias("value"))
    return text.select(F.from_json("value", f"struct<data:array<{landing.OFFER}>>").alias("j")).select("j.data")


def source_api_offers(spark: SparkSession, d: str) -> DataFrame:
    return landing.api_offers(answers(spark, d), "api").select("source_id", F.round("price", 2).alias("price"), F.round("area_sqm", 2).alias("area_sqm"), "neighborhood", "property_type", "rooms", "seller_type")


def source_rejects(spark: SparkSession, d: str) -> DataFrame:
    return landing.reject_counts(landing.html_cards(pages(spark, d), CARDS)).select("source", "rows", "no_price", "no_area")


def listing_documents(spark: SparkSession, d: str) -> DataFrame:
    """Public documents of active listings with history, links and z-score nested."""
    history = payload.price_points(ref.price_runs(spark, d))
    z = ref.latest_alert_values(spark, d)
    columns = ["id", "source", "url", "title", "price_eur", "area_sqm", "neighborhood", "exposure", "contact_phone"]
    docs = payload.listing_documents(ref.active(spark, d), history, payload.links(ref.cross_source_links(spark, d)), z, columns)
    return docs.select("id", "price_eur", F.size(F.coalesce("price_history", F.array())).alias("points"), F.size(F.coalesce("cross_source_links", F.array())).alias("links"), "zscore", F.size("exposure").alias("sides"))


def place_documents(spark: SparkSession, d: str) -> DataFrame:
    """Market document of each place, with the size of its history."""
    places = ref.clean(table(spark, d, "neighborhoods")).select(F.col("name").alias("neighborhood"), "median_price_per_sqm", "listing_count")
    docs = payload.market_documents(places, table(spark, d, "neighborhood_stats_history"), ref.rents(spark, d), ref.days_on_market(spark, d))
    return docs.select("neighborhood", "listing_count", F.size("history").alias("points"), F.round("median_rent_per_sqm", 4).alias("median_rent_per_sqm"), "median_days")


def deal_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Channels of the best 500 deals by savings."""
    deals = ref.alerts(spark, d).filter("savings_pct is not null").groupBy(F.col("listing_id").alias("id")).agg(F.max("savings_pct").alias("savings_pct"))
    return payload.contact_documents(deals, ref.contacts(spark, d), 500)


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily event counts, kept by a stream over files that arrive one after the other.

    The events arrive in ``ARRIVALS`` files in the order of their time, each a batch of its
    own; a day that lies on the edge of two is counted on from its state, days older than
    the watermark leave it, and changed days are merged into the table.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("ts", "event_type", "value")
    ends = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    low, step = (ends[0] or 0), max(((ends[1] or 0) - (ends[0] or 0)) // ARRIVALS + 1, 1)
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) / step)
    for k in range(ARRIVALS):
        events.filter(part == k).write.mode("append").parquet(f"{folder}/in/{k}")
    daily = streams.tumbling(streams.read_stream(spark, f"{folder}/in/*", events.schema), "ts", "1 day", ["event_type"], "value", late="1 day")
    last: list[int] = []
    sink = streams.upserting(f"{folder}/table", streams.merged_by("start", "event_type"))
    streams.run_available(daily, f"{folder}/checkpoint", lambda batch, number: (sink(batch, number), last.append(number)), mode="update")
    if not last:
        return spark.createDataFrame([], "day timestamp_ntz, event_type string, n long, total double")
    return spark.read.parquet(f"{folder}/table/{max(last)}").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def value_forms(spark: SparkSession, d: str) -> DataFrame:
    """Rent buckets, bands, opening hours and other scalar forms of each listing."""
    c = F.col
    return ref.base(spark, d).select(
        "id", S.rooms_bucket(c("rooms")).alias("rooms_bucket"), S.price_band(c("price_eur")).alias("price_band"), S.round_area(c("area_sqm")).alias("round_area"),
        S.whole_days(F.lit(R.now).cast("timestamp_ntz"), c("first_seen")).alias("age_days"), S.change_pct(c("price_eur"), c("first_price_eur"), 3).alias("change_pct"),
    )


ARRIVALS = 4

QUERIES = {f.__name__: f for f in (source_html_cards, source_api_offers, source_rejects, listing_documents, place_documents, deal_contacts, stream_daily, value_forms)}
B = ref._BASE
ORACLES = {
    "source_html_cards": B
    + """SELECT source_id, url, title, round(price_eur, 2) AS price, round(area_sqm, 2) AS area_sqm, rooms, floor, image_url,
    CASE WHEN price_eur IS NULL OR price_eur <= 0 THEN 'no price' WHEN area_sqm IS NULL OR area_sqm <= 0 THEN 'no area' END AS reject FROM base""",
    "source_api_offers": B + "SELECT source_id, round(price_eur, 2) AS price, round(coalesce(area_sqm, CAST(nullif(regexp_extract(title, '([0-9]+) ?(?:m²|кв)', 1), '') AS DOUBLE)), 2) AS area_sqm, neighborhood, lower(property_type) AS property_type, rooms, CASE WHEN seller_type = 'agency' THEN 'agency' ELSE 'private' END AS seller_type FROM base",
    "source_rejects": B + "SELECT 'portal' AS source, count(*) AS rows, count(*) FILTER (WHERE price_eur IS NULL OR price_eur <= 0) AS no_price, count(*) FILTER (WHERE price_eur > 0 AND (area_sqm IS NULL OR area_sqm <= 0)) AS no_area FROM base",
    "deal_contacts": B + f""", s AS (SELECT listing_id AS id, max(savings_pct) AS savings_pct FROM al WHERE savings_pct IS NOT NULL GROUP BY 1),
    c AS (SELECT id, CASE WHEN n LIKE '359%' AND length(n) BETWEEN 11 AND 12 THEN '+' || n END AS phone, CASE WHEN regexp_full_match(lower(trim(contact_email)), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(trim(contact_email)) END AS email FROM (SELECT *, {ref._DIGITS} AS n FROM base))
    SELECT id, phone, email FROM s JOIN c USING (id) WHERE phone IS NOT NULL OR email IS NOT NULL ORDER BY savings_pct DESC, id LIMIT 500""",
    "stream_daily": ref.ORACLES["events_daily"],
    "value_forms": B + """SELECT id, CASE WHEN rooms IS NULL THEN 'all' WHEN rooms >= 4 THEN '4+' ELSE CAST(greatest(rooms, 1) AS VARCHAR) END AS rooms_bucket,
    CASE WHEN coalesce(price_eur, 0) <= 0 THEN 'unknown' ELSE CAST(CAST(round_even(price_eur / greatest(5000.0, round_even(price_eur * 0.05 / 5000, 0) * 5000), 0) * greatest(5000.0, round_even(price_eur * 0.05 / 5000, 0) * 5000) AS BIGINT) AS VARCHAR) END AS price_band,
    CASE WHEN coalesce(area_sqm, 0) <= 0 THEN 0 ELSE CAST(round_even(area_sqm / 5, 0) AS INT) * 5 END AS round_area,
    CAST(greatest(0, datesub('day', first_seen, TIMESTAMP '2026-03-26')) AS INT) AS age_days, round((price_eur - first_price_eur) / nullif(first_price_eur, 0) * 100, 3) AS change_pct FROM base""",
    "place_documents": B + ref._RENT.replace("WITH", "") + ref._DOM + """, dmed AS (SELECT neighborhood, CASE WHEN count(dom) FILTER (WHERE property_type = 'apartment') >= 5 THEN median(dom) FILTER (WHERE property_type = 'apartment') ELSE median(dom) END AS m FROM dm GROUP BY 1),
    h AS (SELECT neighborhood, count(*) AS points FROM neighborhood_stats_history GROUP BY 1)
    SELECT n.name AS neighborhood, n.listing_count, h.points, round(r.rent, 4) AS median_rent_per_sqm, dmed.m AS median_days FROM neighborhoods n LEFT JOIN h ON h.neighborhood = n.name LEFT JOIN rents r ON r.neighborhood = n.name AND r.bucket = 'all' LEFT JOIN dmed ON dmed.neighborhood = n.name""",
    "listing_documents": B + """, r AS (SELECT listing_id, id, recorded_at, round(price_eur, 2) AS price, lead(round(price_eur, 2)) OVER w AS nx, lead(id) OVER w AS ni FROM ph WHERE recorded_at IS NOT NULL WINDOW w AS (PARTITION BY listing_id ORDER BY recorded_at, id)),
    k AS (SELECT listing_id, count(*) AS n FROM r WHERE ni IS NULL OR nx <> price GROUP BY 1 HAVING count(*) > 1),
    x AS (SELECT canonical_id, count(DISTINCT source) AS n FROM base WHERE canonical_id IS NOT NULL AND url IS NOT NULL AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1),
    z AS (SELECT listing_id, arg_max(zscore, id) FILTER (WHERE zscore IS NOT NULL) AS zscore FROM al GROUP BY 1)
    SELECT a.id, a.price_eur, coalesce(k.n, 0) AS points, coalesce(x.n, 0) AS links, z.zscore, CASE WHEN json_valid(exposure) AND json_type(exposure::JSON) = 'ARRAY' THEN json_array_length(exposure::JSON) ELSE 0 END AS sides
    FROM active a LEFT JOIN k ON k.listing_id = a.id LEFT JOIN x ON x.canonical_id = a.canonical_id LEFT JOIN z ON z.listing_id = a.id""",
}
