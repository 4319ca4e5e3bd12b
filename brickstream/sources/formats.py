"""Further forms that sources deliver: paged answers, amounts and places in texts, linked data, details, auctions, notices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.functions import scalars as S

# How linked data stands in a page, and what a detail says where it knows nothing.
LINKED_DATA = "(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"
UNKNOWN = ("", "Unknown", "-")
LARGEST_ATTACHMENT = 12 * 1024 * 1024


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern in a text; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def current_amount(text: Column) -> Column:
    """Amount in euro of a text, of several the last, which is the one after a discount; the sign stands before or after it."""
    plain = lambda c: F.regexp_replace(c, "[, ]", "").try_cast("double")
    return F.coalesce(plain(last_match(text, "€\\s*([0-9][0-9, ]*)")), plain(F.nullif(F.regexp_extract(text, "([0-9][0-9, ]*)\\s*€", 1), F.lit(""))))


def bedrooms(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)([0-9]+)\\s*bedroom", 1), F.lit("")).try_cast("int")


def place_in_title(title: Column) -> Column:
    """The last place that a title names after the words for in or village; null if none."""
    return F.trim(last_match(title, "(?:(?:^|\\s)в\\s+(?:с\\.\\s*)?|(?:^|\\s)с\\.\\s*)([А-Я][а-я]+(?:\\s+[А-Я][а-я]+|\\s+[0-9]+)?)"))


def page_progress(answers: DataFrame, source: str, items: str = "result", start: str = "startIndex", total: str = "offersCount", more: str = "hasMoreItems") -> DataFrame:
    """``source, pages, items, exhausted``: whether the answers' own totals say that nothing is left, whatever could be parsed of them."""
    size = F.size(F.coalesce(items, F.array()))
    done = (size == 0) | F.coalesce(~F.col(more), F.lit(False)) | F.coalesce(F.col(start) + size >= F.col(total), F.lit(False))
    return answers.groupBy(source).agg(F.count("*").alias("pages"), F.sum(size).alias("items"), F.max(done).alias("exhausted"))


def linked_data(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, name, price, image, valid`` of the linked data of each page; from malformed data what patterns find."""
    text = F.col(content).cast("string")
    raw = F.nullif(F.trim(F.regexp_extract(text, LINKED_DATA, 1)), F.lit(""))
    rows = pages.select(key, raw.alias("_raw")).withColumn("valid", F.col("_raw").isNotNull() & F.try_parse_json("_raw").isNotNull())
    read = lambda path, pattern: F.when(F.col("valid"), F.get_json_object("_raw", path)).otherwise(F.nullif(F.regexp_extract("_raw", pattern, 1), F.lit("")))
    return rows.select(
        key, read("$.name", '"name"\\s*:\\s*"([^"]*)"').alias("name"), read("$.offers.price", '"price"\\s*:\\s*"?([0-9.]+)').try_cast("double").alias("price"),
        read("$.image[0]", '"image"\\s*:\\s*\\[?\\s*"([^"]*)"').alias("image"), "valid",
    )


def with_details(cards: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """``cards`` with the fields of their detail pages where those know something; cards without details stay as they are."""
    fields = [c for c in details.columns if c != key]
    named = details.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    text = dict(details.dtypes)
    known = lambda c: F.when(~F.col(f"_{c}").isin(*UNKNOWN), F.col(f"_{c}")) if text[c] == "string" else F.col(f"_{c}")
    merged = {c: F.coalesce(known(c), F.col(c)) if c in cards.columns else known(c) for c in fields}
    return cards.join(named, F.col(key) == F.col("_key"), "left").withColumns(merged).drop("_key", *[f"_{c}" for c in fields])


def auctions(cards: DataFrame, category: str, text: str, now: Column, categories: Mapping[str, tuple[str, int | None]]) -> DataFrame:
    """``cards`` of the listed categories that haven't ended: with ``property_type, rooms, auction_start, auction_end``.

    A card without a readable window has no end and stays.
    """
    kinds = F.create_map(*[F.lit(x) for name, (kind, _) in categories.items() for x in (name, kind)])
    rooms = F.create_map(*[F.lit(x) for name, (_, n) in categories.items() if n is not None for x in (name, n)])
    rows = cards.withColumns({"property_type": F.try_element_at(kinds, F.trim(category)), "rooms": F.try_element_at(rooms, F.trim(category)), "_w": S.date_window(F.col(text))})
    rows = rows.withColumn("auction_start", F.col("_w.start")).withColumn("auction_end", F.col("_w.end")).drop("_w")
    return rows.filter(F.col("property_type").isNotNull() & (F.col("auction_end").isNull() | (F.col("auction_end") >= now)))


def notice_text(page: Column, attachment: Column, size: Column) -> Column:
    """The attachment's text where there is one of a size that is read, else that of the page."""
    return F.coalesce(F.nullif(F.trim(F.when(F.coalesce(size, F.lit(0)) <= LARGEST_ATTACHMENT, attachment)), F.lit("")), page)


def notices(rows: DataFrame, key: str, page: str, attachment: str, size: str, wanted: Sequence[str]) -> DataFrame:
    """``key, text, decision, decided_on`` of the notices whose text has one of the ``wanted`` words."""
    text = rows.select(key, notice_text(F.col(page), F.col(attachment), F.col(size)).alias("text"))
    return text.filter(F.lower("text").rlike("|".join(wanted))).select(key, "text", S.decision_number(F.col("text")).alias("decision"), S.notice_date(F.col("text")).alias("decided_on"))
