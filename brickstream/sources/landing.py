"""Sources as landing files: pages and API answers become one bronze table of listings.

Crawling stays outside; what a crawler stored is read with Spark's binary, text and JSON
readers.  Pages are parsed in Arrow batches by declarative specifications; JSON answers
stay in the JVM.  Rows that can't be used come out with a reason instead of vanishing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickstream.functions import scalars as S

BRONZE = "source string, source_id string, url string, title string, price double, currency string, area_sqm double, neighborhood string, property_type string, rooms int, floor int, construction_type string, year_built int, image_url string, seller_type string, reject string"


@dataclass(frozen=True)
class CardSpec:
    """How the cards of one source's list pages are read.

    ``card`` is ``tag.class`` of a card (``*`` in the class for any ending); ``fields`` gives
    for each bronze column where its text stands (``tag.class``, ``@attribute`` or
    ``param:label``) and a pattern whose first group is the value.
    """

    source: str
    card: str
    fields: Mapping[str, tuple[str, str]]
    encoding: str = "utf-8"
    params: tuple[str, str] | None = None  # selectors of label and value cells
    types: Mapping[str, str] = field(default_factory=dict)


class _Tree(HTMLParser):
    """Flat list of elements with their text, attributes and extent; void and unclosed tags are tolerated."""

    VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[int] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.elements.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": [], "end": None})
        if tag in ("script", "style"):
            self.skip += tag == "style"
        if tag not in self.VOID:
            self.open.append(len(self.elements) - 1)
        else:
            self.elements[-1]["end"] = len(self.elements)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[k]]["tag"] == tag:
                for i in self.open[k:]:
                    self.elements[i]["end"] = len(self.elements)
                del self.open[k:]
                break
        self.skip -= tag == "style" and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            for i in self.open:
                self.elements[i]["text"].append(data)

    def finish(self) -> list[dict]:
        self.close()
        for e in self.elements:
            e["end"] = len(self.elements) if e["end"] is None else e["end"]
            e["text"] = re.sub(r"\s+", " ", " ".join(e["text"])).strip()
        return self.elements


def _fits(element: dict, selector: str) -> bool:
    tag, _, wanted = selector.partition(".")
    if tag and element["tag"] != tag:
        return False
    classes = element["attrs"].get("class", "").split() + [element["attrs"].get("id", "")]
    return not wanted or any(c.startswith(wanted[:-1]) if wanted.endswith("*") else c == wanted for c in classes)


def _value(elements: Sequence[dict], params: Mapping[str, str], where: str, pattern: str) -> str | None:
    texts: list[str] = []
    if where.startswith("param:"):
        texts = [params.get(where[6:].lower(), "")]
    elif "@" in where:
        selector, attribute = where.split("@")
        texts = [e["attrs"].get(attribute, "") for e in elements if _fits(e, selector) and e["attrs"].get(attribute)]
    else:
        texts = [e["text"] for e in elements if _fits(e, where)]
    for text in texts:
        if m := re.search(pattern, text, re.I):
            return (m.group(1) if m.groups() else m.group(0)).strip()
    return None


def parse_cards(html: str, spec: CardSpec) -> Iterator[dict[str, str | None]]:
    """Text of every field of every card of one page; repeated ids come out once, the first; cards without an id all do."""
    tree = _Tree()
    tree.feed(html or "")
    elements, seen = tree.finish(), set()
    for i, e in enumerate(elements):
        if not _fits(e, spec.card):
            continue
        inside = elements[i : e["end"]]
        params: dict[str, str] = {}
        if spec.params:
            labels = [x["text"].rstrip(":").lower() for x in inside if _fits(x, spec.params[0])]
            params = dict(zip(labels, [x["text"] for x in inside if _fits(x, spec.params[1])], strict=False))
        row = {name: _value(inside, params, *where) for name, where in spec.fields.items()}
        if row.get("source_id") is None or row["source_id"] not in seen:
            seen.add(row.get("source_id"))
            yield row


def _typed(rows: DataFrame, source: str, types: Mapping[str, str]) -> DataFrame:
    """Bronze columns from texts, with the reason for which a row can't be used."""
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    kind = F.lower(text("property_type"))
    mapped = F.coalesce(*[F.when(kind.contains(word), F.lit(to)) for word, to in types.items()], kind) if types else kind
    price, area = S.localized_number(text("price")), S.localized_number(text("area_sqm"))
    reject = F.when(text("source_id").isNull(), "no id").when(price.isNull() | (price <= 0), "no price").when(area.isNull() | (area <= 0), "no area")
    return rows.select(
        F.lit(source).alias("source"), text("source_id").alias("source_id"), text("url").alias("url"), text("title").alias("title"), price.alias("price"),
        F.when(F.lower(text("currency")).rlike("лв|bgn"), "BGN").otherwise("EUR").alias("currency"), area.alias("area_sqm"), text("neighborhood").alias("neighborhood"),
        mapped.alias("property_type"), S.first_int(text("rooms")).alias("rooms"),
        F.when(F.lower(text("floor")).contains("партер"), 0).otherwise(S.first_int(text("floor"))).alias("floor"), F.lower(text("construction_type")).alias("construction_type"),
        S.first_int(text("year_built")).alias("year_built"), text("image_url").alias("image_url"), text("seller_type").alias("seller_type"), reject.alias("reject"),
    )


def html_cards(pages: DataFrame, spec: CardSpec, content: str = "content", page: str | None = None) -> DataFrame:
    """Bronze rows of stored list pages (``content`` as bytes or text), one Arrow pass without a shuffle.

    With ``page``, a column that orders the pages, a repeated id comes out once over all of
    them, as on the first page that has it; otherwise once on each page.
    """
    names = list(spec.fields)
    if page is not None:
        keyed = [*names, "_page", "_position"]

        def parse_keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, html in zip(batch[page], batch[content], strict=True):
                    text = html.decode(spec.encoding, "replace") if isinstance(html, (bytes, bytearray)) else html
                    rows += [{**r, "_page": str(key), "_position": i} for i, r in enumerate(parse_cards(text, spec))]
                yield pd.DataFrame(rows, columns=keyed)

        texts = pages.select(page, content).mapInPandas(parse_keyed, ", ".join(f"{n} string" for n in names) + ", _page string, _position long")
        return _typed(first_of_each(texts, "source_id", ["_page", "_position"]), spec.source, spec.types)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for page in batch[content] for r in parse_cards(page.decode(spec.encoding, "replace") if isinstance(page, (bytes, bytearray)) else page, spec)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    texts = pages.select(content).mapInPandas(parse, ", ".join(f"{n} string" for n in names))
    return _typed(texts, spec.source, spec.types)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as bytes, so that any encoding can be read."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def embedded_json(pages: DataFrame, content: str, pattern: str, schema: str) -> DataFrame:
    """Struct of the JSON that a page holds in a script, by the first group of ``pattern``; null if malformed."""
    return pages.withColumn("data", F.from_json(F.nullif(F.regexp_extract(F.col(content).cast("string"), pattern, 1), F.lit("")), schema))


OFFER = "struct<id:string,url:string,title:string,description:string,business:boolean,category:struct<id:int>,location:struct<district:struct<name:string>>,photos:array<struct<link:string>>,params:array<struct<key:string,value:struct<key:string,label:string,value:double,currency:string>>>>"


def api_offers(answers: DataFrame, source: str, offers: str = "data", types: Mapping[str, str] | None = None) -> DataFrame:
    """Bronze rows of stored API answers with an array of offers whose parameters are key and value pairs."""
    rows = answers.select(F.explode(offers).alias("o"))
    by_key = F.map_from_entries(F.transform(F.filter("o.params", lambda p: p["key"].isNotNull()), lambda p: F.struct(p["key"], p["value"])))
    rows = rows.withColumn("p", by_key)
    get = lambda k: F.element_at("p", k)
    texts = rows.select(
        F.col("o.id").alias("source_id"), F.col("o.url").alias("url"), F.col("o.title").alias("title"), get("price")["value"].cast("string").alias("price"), get("price")["currency"].alias("currency"),
        F.coalesce(F.nullif(F.regexp_extract(get("space")["label"], "([0-9][0-9 .,]*)", 1), F.lit("")), F.nullif(F.regexp_extract("o.title", "([0-9]+) ?(?:m²|кв)", 1), F.lit(""))).alias("area_sqm"),
        F.col("o.location.district.name").alias("neighborhood"), get("type")["key"].alias("property_type"), get("rooms")["label"].alias("rooms"), get("floor")["label"].alias("floor"),
        get("construction")["label"].alias("construction_type"), F.when(F.col("o.business"), "agency").otherwise("private").alias("seller_type"), F.get("o.photos", F.lit(0))["link"].alias("image_url"),
    )
    return _typed(texts, source, types or {})


def table_rows(pages: DataFrame, page: str, content: str = "content", encoding: str = "utf-8") -> DataFrame:
    """``page, position, cells``: the texts of every row of every table of stored pages, in the order of each page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in zip(batch[page], batch[content], strict=True):
                tree = _Tree()
                tree.feed(html.decode(encoding, "replace") if isinstance(html, (bytes, bytearray)) else html or "")
                elements = tree.finish()
                out += [(str(key), i, [x["text"] for x in elements[i : e["end"]] if x["tag"] in ("td", "th")]) for i, e in enumerate(elements) if e["tag"] == "tr"]
            yield pd.DataFrame(out, columns=["page", "position", "cells"])

    return pages.select(page, content).mapInPandas(parse, "page string, position long, cells array<string>")


@dataclass(frozen=True)
class TableSpec:
    """Which rows of a table are read: the fewest cells, and the cells (from 0, negative from the end) of key and number."""

    cells: int
    key: int
    value: int
    digits: tuple[int, int] = (1, 18)
    without: tuple[str, ...] = ()


BENCHMARK = TableSpec(cells=8, key=0, value=-1, digits=(3, 5), without=("Unknown",))


def first_of_each(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each ``key`` over all pages; rows without a key all stay.  Combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    named = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return named.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))


def benchmark_table(pages: DataFrame, page: str, content: str = "content", encoding: str = "utf-8", spec: TableSpec = BENCHMARK) -> DataFrame:
    """``neighborhood, price`` of the rows that fit ``spec``; of a name that comes again the first one counts, on whichever page."""
    cell = lambda k: F.get("cells", F.size("cells") + k if k < 0 else F.lit(k))
    number = F.regexp_replace(cell(spec.value), "[\\s\u00a0]", "")
    fits = (F.size("cells") >= spec.cells) & number.rlike(f"^[0-9]{{{spec.digits[0]},{spec.digits[1]}}}$") & (cell(spec.key) != "")
    named = table_rows(pages, page, content, encoding).filter(fits).filter(~cell(spec.key).isin(*spec.without) if spec.without else F.lit(True))
    return first_of_each(named.select(cell(spec.key).alias("neighborhood"), number.cast("double").alias("price"), "page", "position"), "neighborhood", ["page", "position"]).select("neighborhood", "price")


def detail_contacts(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, phone, email, latitude, longitude`` of detail pages: tel and mailto links and map positions (0 is null)."""
    text = F.col(content).cast("string")
    position = lambda k: F.nullif(F.regexp_extract(text, "(?:q=|\\[)(-?[0-9]+\\.[0-9]+),\\s*(-?[0-9]+\\.[0-9]+)", k).try_cast("double"), F.lit(0.0))
    return pages.select(
        key, S.phone(F.nullif(F.regexp_extract(text, "tel:([+0-9 ()/-]+)", 1), F.lit(""))).alias("phone"), S.email(F.nullif(F.regexp_extract(text, "mailto:([^\"'?>\\s]+)", 1), F.lit(""))).alias("email"),
        position(1).alias("latitude"), position(2).alias("longitude"),
    )


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources in one table; a column that one lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def reject_counts(bronze: DataFrame) -> DataFrame:
    """Rows, rejects by reason and their share, per source."""
    return bronze.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(F.col("reject") == "no price").alias("no_price"), F.count_if(F.col("reject") == "no area").alias("no_area"),
        F.round(100 * F.count("reject") / F.count("*"), 2).alias("reject_pct"),
    )


def to_listings(bronze: DataFrame, rate: float) -> DataFrame:
    """Usable bronze rows with the price in euro and per square metre."""
    price = S.to_eur(F.col("price"), F.col("currency"), rate)
    rows = bronze.filter("reject is null").withColumn("price_eur", F.round(price, 2))
    return rows.withColumn("price_per_sqm_eur", S.per_sqm(F.col("price_eur"), F.col("area_sqm"))).drop("price", "currency", "reject")
