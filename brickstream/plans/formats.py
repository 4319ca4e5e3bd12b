"""Queries over further source forms, rendered from the listings so that every row has a known result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickstream.plans import reference as ref
from brickstream.sources import formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PAGE = 20
CATEGORIES = {"Двустаен апартамент": ("apartment", 2), "Тристаен апартамент": ("apartment", 3), "Къща": ("house", None)}
OFFER = "struct<offersCount:bigint,startIndex:bigint,hasMoreItems:boolean,result:array<struct<id:string,title:string,place:string,price:struct<value:double,currency:string>>>>"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, ref._BASE + sql
        return f

    return register


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Stored API answers of each source as JSON texts, twenty offers a page."""
    rows = ref.base(spark, d).select("id", F.coalesce("source", F.lit("unknown")).alias("source"), "source_id", "title", "neighborhood", "price_eur")
    totals = rows.groupBy("source").agg(F.count("*").alias("_n"))
    offer = F.struct(F.col("source_id").alias("id"), "title", F.concat("neighborhood", F.lit(", Дъбринград")).alias("place"), F.struct(F.col("price_eur").alias("value"), F.lit("EUR").alias("currency")).alias("price"))
    pages = rows.select("source", F.floor(F.col("id") / PAGE).alias("page"), offer.alias("o")).groupBy("source", "page").agg(F.collect_list("o").alias("result")).join(totals, "source")
    body = F.struct(F.col("_n").alias("offersCount"), (F.col("page") * PAGE).alias("startIndex"), F.lit(None).cast("boolean").alias("hasMoreItems"), "result")
    return pages.select("source", F.to_json(body).alias("body"))


def read(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("source", F.from_json("body", OFFER).alias("b")).select("source", "b.*")


@query("SELECT source_id, title, neighborhood AS place, price_eur AS price, TRY_CAST(nullif(regexp_extract(title, '([0-9]+) ?(?:m²|кв)', 1), '') AS INT) AS area FROM base")
def source_paged_offers(spark, d):
    """Offers of paged answers: place without the city behind it, area from the title."""
    o = read(spark, d).select(F.explode("result").alias("o")).select("o.*")
    area = F.nullif(F.regexp_extract("title", "([0-9]+) ?(?:m²|кв)", 1), F.lit("")).try_cast("int")
    return o.select(F.col("id").alias("source_id"), "title", F.regexp_replace("place", ", Дъбринград$", "").alias("place"), F.col("price.value").alias("price"), area.alias("area"))


@query("SELECT coalesce(source, 'unknown') AS source, count(DISTINCT CAST(floor(id / 20) AS BIGINT)) AS pages, count(*) AS items, max(CAST(floor(id / 20) AS BIGINT) * 20 + n >= total) AS exhausted FROM (SELECT *, count(*) OVER (PARTITION BY coalesce(source, 'unknown'), CAST(floor(id / 20) AS BIGINT)) AS n, count(*) OVER (PARTITION BY coalesce(source, 'unknown')) AS total FROM base) GROUP BY 1")
def source_pages_done(spark, d):
    """Pages and offers of each source, and whether its own totals say that all are there."""
    return formats.page_progress(read(spark, d), "source")


@query("""SELECT id, round(price_eur, 0) AS price, coalesce(rooms, 0) AS bedrooms, CASE WHEN regexp_full_match(neighborhood, '[А-Я][а-я]+( [А-Я][а-я]+| [0-9])?') THEN neighborhood END AS place
    FROM base WHERE price_eur >= 1""")
def source_offer_texts(spark, d):
    """Current price after a discount, bedrooms and the place that a title names, from running text."""
    c = F.col
    simple = c("neighborhood").rlike("^[А-Я][а-я]+( [А-Я][а-я]+| [0-9])?$")
    rows = ref.base(spark, d).filter("price_eur >= 1")
    text = F.concat(F.lit("Was € 999,000 now € "), F.format_number(F.bround("price_eur", 0).cast("long"), 0), F.lit(" - "), F.coalesce(c("rooms"), F.lit(0)).cast("string"), F.lit(" Bedroom flat"))
    title = F.concat(F.lit("Парцел в с. Друго, в "), F.coalesce("neighborhood", F.lit("?")))
    rows = rows.select("id", text.alias("text"), title.alias("title"), simple.alias("_simple"))
    return rows.select("id", formats.current_amount(c("text")).alias("price"), formats.bedrooms(c("text")).alias("bedrooms"), F.when(c("_simple"), formats.place_in_title(c("title"))).alias("place"))


@query("SELECT id, replace(coalesce(title, ''), '\"', '') AS name, price_eur AS price, nullif(image_url, '') AS image, NOT coalesce(has_elevator, false) AS valid FROM base WHERE price_eur IS NOT NULL AND title IS NOT NULL AND title <> ''")
def source_linked_data(spark, d):
    """Name, price and image from the linked data of detail pages; some of it is cut off and read by patterns."""
    c = F.col
    rows = ref.base(spark, d).filter("price_eur is not null and title is not null and title != ''")
    body = F.to_json(F.struct(F.replace("title", F.lit('"'), F.lit("")).alias("name"), F.struct(F.format_string("%.9f", "price_eur").alias("price")).alias("offers"), F.when(F.coalesce("image_url", F.lit("")) != "", F.array("image_url")).alias("image")))
    cut = F.when(F.coalesce("has_elevator", F.lit(False)), F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    pages = rows.select("id", F.concat(F.lit('<html><script type="application/ld+json">'), cut, F.lit("</script></html>")).alias("content"))
    return formats.linked_data(pages, "id")


@query("SELECT id, CASE WHEN is_sold IS NOT NULL AND coalesce(construction_type, '') NOT IN ('', 'Unknown', '-') THEN construction_type ELSE seller_type END AS kind, CASE WHEN is_sold IS NOT NULL THEN address END AS address FROM base WHERE address IS NULL OR address NOT IN ('', 'Unknown', '-')")
def source_detail_join(spark, d):
    """Cards with the fields of their detail pages where those know something."""
    rows = ref.base(spark, d).filter("address is null or address not in ('', 'Unknown', '-')")
    cards = rows.select("id", F.col("seller_type").alias("kind"))
    details = rows.filter("is_sold is not null").select("id", F.col("construction_type").alias("kind"), "address")
    return formats.with_details(cards, details, "id")


@query("""SELECT id, CASE WHEN rooms IN (2, 3) THEN 'apartment' ELSE 'house' END AS property_type, CASE WHEN rooms IN (2, 3) THEN rooms END AS rooms, CAST(CAST(first_seen AS DATE) AS TIMESTAMP) AS auction_start, CAST(CAST(last_seen AS DATE) AS TIMESTAMP) + INTERVAL 30 DAY + INTERVAL 86399 SECOND AS auction_end
    FROM base WHERE (rooms IN (2, 3) OR rooms = 5) AND first_seen IS NOT NULL AND last_seen IS NOT NULL AND CAST(CAST(last_seen AS DATE) AS TIMESTAMP) + INTERVAL 30 DAY + INTERVAL 86399 SECOND >= TIMESTAMP '2026-03-26'""")
def source_auctions(spark, d):
    """Auctions of residential categories whose window hasn't ended."""
    rows = ref.base(spark, d).filter("first_seen is not null and last_seen is not null")
    category = F.when(F.col("rooms") == 2, " Двустаен апартамент").when(F.col("rooms") == 3, "Тристаен апартамент").when(F.col("rooms") == 5, "Къща").otherwise("Гараж")
    text = F.concat(F.lit("Срок: от "), F.date_format("first_seen", "dd.MM.yyyy"), F.lit(" до "), F.date_format(F.date_add("last_seen", 30), "d.M.yyyy"), F.lit(" г."))
    cards = rows.select("id", category.alias("category"), text.alias("text"))
    return formats.auctions(cards, "category", "text", ref.now(), CATEGORIES).select("id", "property_type", "rooms", "auction_start", "auction_end")


@query("""SELECT id, CASE WHEN act16 AND coalesce(image_count, 0) < 13 THEN 'attachment' ELSE 'page' END AS told_by, CAST(id AS VARCHAR) || '-А' AS decision, CAST(last_seen AS DATE) AS decided_on FROM base WHERE last_seen IS NOT NULL AND (listing_kind = 'auction' OR listing_kind = 'sale')""")
def source_notices(spark, d):
    """Notices by their attachment where it can be read, else by their page: decision, date; only those of wanted words."""
    rows = ref.base(spark, d).filter("last_seen is not null")
    words = F.when(F.col("listing_kind") == "auction", "търг").when(F.col("listing_kind") == "sale", "продажба").otherwise("друго")
    body = F.concat(F.lit(" Решение № "), F.col("id").cast("string"), F.lit("-А от "), F.date_format("last_seen", "d.MM.yyyy"), F.lit(" за "), words)
    made = rows.select("id", F.concat(F.lit("page"), body).alias("page"), F.when(F.col("act16"), F.concat(F.lit("attachment"), body)).alias("attachment"), (F.coalesce("image_count", F.lit(0)).cast("long") * 1024 * 1024).alias("size"))
    out = formats.notices(made, "id", "page", "attachment", "size", ("търг", "продажба"))
    return out.select("id", F.split("text", " ")[0].alias("told_by"), "decision", "decided_on")
