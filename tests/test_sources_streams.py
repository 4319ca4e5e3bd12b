import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from brickstream.plans import landing as plans
from brickstream.plans import payload
from brickstream.rules import Rules
from brickstream.sources import landing, sinks
from brickstream.streaming import streams

T = dt.datetime
SPEC = landing.CardSpec(
    source="s",
    card="div.ad*",
    fields={"source_id": ("div.ad*@id", "_(\\d+)"), "title": ("a.t", "(.+)"), "price": ("p", "([0-9 .,]+)"), "currency": ("p", "(€|лв)"), "area_sqm": ("param:площ", "^([0-9.,]+)"), "floor": ("param:етаж", "(.+)"), "property_type": ("a.t", "(.+)")},
    encoding="windows-1251",
    params=("td.l", "td.v"),
    types={"апартамент": "apartment"},
)


def page(*cards):
    return ("<html><body>" + "".join(cards) + "<script>var x = '<div class=\"ad\">';</script></body></html>").encode("windows-1251")


def card(i, price="195 583,00 лв.", area="65,5", floor="Партер"):
    return f'<div class="ad-big" id="row_{i}"><a class="t">Апартамент №{i}</a><br><p>{price}<table><tr><td class="l">Площ:</td><td class="v">{area} м2</td></tr><tr><td class="l">Етаж</td><td class="v">{floor}</td></tr></table></div>'


def test_cards_in_windows_1251_with_rejects_and_repeats(spark):
    pages = spark.createDataFrame([(bytearray(page(card(1), card(1, price="1"), card(2, price="при запитване"), card(3, area="-", floor="3 от 8"))),), (bytearray(b""),)], "content binary")
    got = {r["source_id"]: r for r in landing.html_cards(pages, SPEC).collect()}
    assert set(got) == {"1", "2", "3"}
    r = got["1"]
    assert (r["price"], r["currency"], r["area_sqm"], r["floor"], r["property_type"], r["reject"]) == (195583.0, "BGN", 65.5, 0, "apartment", None)
    assert got["2"]["reject"] == "no price" and got["3"]["reject"] == "no area" and got["3"]["floor"] == 3
    priced = landing.to_listings(landing.html_cards(pages, SPEC), Rules().eur_rate).collect()
    assert [(r["price_eur"], r["price_per_sqm_eur"]) for r in priced] == [(100001.53, 1526.74)]
    c = landing.reject_counts(landing.html_cards(pages, SPEC)).first()
    assert (c["rows"], c["no_price"], c["no_area"]) == (3, 1, 1)


def test_cards_without_an_id_all_come_out():
    spec = landing.CardSpec(**{**SPEC.__dict__, "fields": {k: v for k, v in SPEC.fields.items() if k != "source_id"}})
    assert len(list(landing.parse_cards(page(card(1), card(2), card(3)).decode("windows-1251"), spec))) == 3
    assert len(list(landing.parse_cards(page(card(1), card(1), card(3)).decode("windows-1251"), SPEC))) == 2


def test_benchmark_table_takes_the_first_of_a_name(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<table>" + row("A", *"123456", "1500") + row("A", *"123456", "9999") + row("Unknown", *"123456", "1500") + row("B", "1", "2000") + row("C", *"123456", "12") + "</table>"
    later = "<table>" + row("A", *"123456", "1111") + row("D", *"123456", "1 700") + "</table>"
    pages = spark.createDataFrame([("p2", later), ("p1", html), ("p3", None)], "page string, content string").repartition(3)
    assert sorted(tuple(r) for r in landing.benchmark_table(pages, "page").collect()) == [("A", 1500.0), ("D", 1700.0)]


def test_cards_that_come_again_on_another_page_come_out_once(spark):
    pages = spark.createDataFrame([("b", page(card(1), card(2))), ("a", page(card(1), card(3)))], "path string, content binary").repartition(2)
    got = landing.html_cards(pages, SPEC, page="path")
    assert sorted(r["source_id"] for r in got.collect()) == ["1", "2", "3"] and got.columns == landing.html_cards(pages, SPEC).columns


def test_embedded_json_and_contacts(spark):
    html = '<script>window.__STATE__ = {"items":[{"id":1}]};</script><a href="tel:+359 888 000 000">x</a><a href="mailto:A@b.bg?x">y</a><iframe src="maps?q=0.0,23.3">'
    df = spark.createDataFrame([("k", html), ("z", "<script>window.__STATE__ = {bad;</script>")], "key string, content string")
    got = landing.embedded_json(df, "content", "__STATE__ = (\\{.*?\\});", "struct<items:array<struct<id:int>>>").collect()
    assert got[0]["data"]["items"][0]["id"] == 1 and (got[1]["data"] is None or got[1]["data"]["items"] is None)
    c = landing.detail_contacts(df, "key").collect()[0]
    assert tuple(c) == ("k", "+359888000000", "a@b.bg", None, 23.3)


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([(2,)], "id int")
    assert sorted(map(tuple, landing.union_sources([a, b]).collect())) == [(1, "x"), (2, None)]


def test_read_pages(spark, tmp_path):
    (tmp_path / "p1.html").write_bytes(page(card(5)))
    assert landing.html_cards(landing.read_pages(spark, str(tmp_path)), SPEC).first()["source_id"] == "5"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 3.0)], "id int, k string, v double")
    sinks.write_json(df, str(tmp_path / "j"))
    docs = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(docs, key=lambda x: x["id"]) == [{"id": 1, "k": "a"}, {"id": 2, "k": "b", "v": 3.0}]
    for day in ("2026-01-01", "2026-01-02"):
        sinks.append_snapshot(df, str(tmp_path / "s"), F.lit(day))
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert rows.count() == 4 and sinks.retained(rows, "snapshot_date", 1).count() == 2
    sinks.replace_partitions(df.withColumn("d", F.lit("x")), str(tmp_path / "r"), "d")
    sinks.replace_partitions(df.limit(1).withColumn("d", F.lit("y")), str(tmp_path / "r"), "d")
    sinks.replace_partitions(df.limit(1).withColumn("d", F.lit("x")), str(tmp_path / "r"), "d")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    known, new = spark.createDataFrame([("a", 1.0, "z1"), ("b", 2.0, "z2")], "k string, v double, zone string"), spark.createDataFrame([("b", 5.0), ("c", 6.0)], "k string, v double")
    assert sorted(map(tuple, sinks.current_stats(known, new, "k", ["v"]).collect())) == [("a", None, "z1"), ("b", 5.0, "z2"), ("c", 6.0, None)]
    assert sinks.latest_metrics(str(tmp_path / "m")) is None
    sinks.save_model({"w": 1}, {"mae": 2}, str(tmp_path / "m"), "20260101")
    assert sinks.latest_metrics(str(tmp_path / "m")) == {"mae": 2}


def test_private_columns_stay_out(spark):
    rows = spark.createDataFrame([(1, "c", "+359")], "id long, canonical_id string, contact_phone string")
    z, h, x = (spark.createDataFrame([], s) for s in ("listing_id long, zscore double", "id long, price_history array<string>", "canonical_id string, cross_source_links array<string>"))
    assert "contact_phone" not in payload.listing_documents(rows, h, x, z, ["id", "contact_phone"]).columns
    flags = spark.range(1).select(payload.trap_flags(F.lit('{"a": true, "b": false, "c": "true"}'), ("c", "b", "a")).alias("f")).first()["f"]
    assert flags == ["c", "a"]


EVENTS = "key string, at timestamp_ntz, price double"


@pytest.fixture
def events(spark, tmp_path):
    rows = [("a", T(2026, 1, 1, 1), 5.0), ("a", T(2026, 1, 1, 2), 4.0), ("b", T(2026, 1, 2), 1.0), ("a", T(2026, 1, 20), 4.0), ("b", T(2026, 1, 2), 1.0)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    return streams.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)


def drained(spark, df, tmp_path, mode):
    got = []
    streams.run_available(df, str(tmp_path / "cp"), lambda batch, n: got.extend(map(tuple, batch.collect())), mode)
    return got


def test_stream_windows(spark, events, tmp_path):
    got = drained(spark, streams.tumbling(events, "at", "1 day", ["key"], "price"), tmp_path, "complete")
    assert sorted((r[1], r[2], r[3]) for r in got) == [("a", 1, 4.0), ("a", 2, 9.0), ("b", 2, 2.0)]


def test_stream_sessions(spark, events, tmp_path):
    got = drained(spark, streams.sessions(events, "at", "14 days", "key"), tmp_path, "complete")
    assert sorted((r[2], r[3]) for r in got) == [("a", 1), ("a", 2), ("b", 2)]


def test_stream_ledger(spark, events, tmp_path):
    got = drained(spark, streams.ledger(events, "at", ["key"]), tmp_path, "append")
    assert sorted(r[0] for r in got) == ["a", "b"]


def test_stream_state(spark, events, tmp_path):
    got = {r[0]: r[1:3] for r in drained(spark, streams.track_prices(events, "key", "at", "price"), tmp_path, "update")}
    assert got == {"a": (4.0, 1), "b": (1.0, 0)}


def test_stream_upsert_versions(spark, events, tmp_path):
    merge = lambda last, batch: batch if last is None else last.unionByName(batch)
    sink = streams.upserting(str(tmp_path / "t"), merge)
    streams.run_available(events, str(tmp_path / "cp2"), sink, "append")
    sink(spark.createDataFrame([("z", T(2026, 1, 1), 1.0)], EVENTS), 1)
    assert spark.read.parquet(str(tmp_path / "t/1")).count() == 6


def test_landing_spec_of_the_queries():
    html = '<div class="card big" data-id="x1"><a class="title" href="u">T</a><span class="price">12.50 €</span></div>'
    row = next(landing.parse_cards(html, plans.CARDS))
    assert (row["source_id"], row["price"], row["currency"], row["area_sqm"]) == ("x1", "12.50", "€", None)
