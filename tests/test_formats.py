from pyspark.sql import functions as F

from brickstream.sources import formats


def one(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_amounts_bedrooms_and_places_in_texts(spark):
    assert one(spark, formats.current_amount, "€ 185,000", "175 000 €", "old € 200,000 new € 150,000", "price on request", None, "€") == [185000.0, 175000.0, 150000.0, None, None, None]
    assert one(spark, formats.bedrooms, "a 3 Bedroom flat", "studio", None) == [3, None, None]
    assert one(spark, formats.place_in_title, "Парцел в с. Долно Поле", "Къща в Град, с. Бистро 2", "Къща", None) == ["Долно Поле", "Бистро 2", None, None]


def test_progress_follows_the_metadata(spark):
    schema = "source string, offersCount long, startIndex long, hasMoreItems boolean, result array<string>"
    rows = [("a", 3, 0, None, ["x", "y"]), ("a", 3, 2, None, ["z"]), ("b", 9, 0, None, ["x"]), ("c", None, 0, False, ["x"]), ("d", None, 0, None, []), ("e", None, None, None, None), ("f", None, 0, None, ["x"])]
    got = {r["source"]: (r["pages"], r["items"], r["exhausted"]) for r in formats.page_progress(spark.createDataFrame(rows, schema), "source").collect()}
    assert got == {"a": (2, 3, True), "b": (1, 1, False), "c": (1, 1, True), "d": (1, 0, True), "e": (1, 0, True), "f": (1, 1, False)}


def test_linked_data_with_and_without_json(spark):
    page = lambda body: f'<script type="application/ld+json">{body}</script>'
    whole = '{"name": "A", "offers": {"price": "12.5"}, "image": ["i.jpg"]}'
    df = spark.createDataFrame([(1, page(whole)), (2, page(whole[:-1])), (3, "<p>"), (4, None)], "id int, content string")
    got = {r["id"]: tuple(r)[1:] for r in formats.linked_data(df, "id").collect()}
    assert got == {1: ("A", 12.5, "i.jpg", True), 2: ("A", 12.5, "i.jpg", False), 3: (None, None, None, False), 4: (None, None, None, False)}


def test_details_override_only_where_they_know(spark):
    cards = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, place string, n int")
    details = spark.createDataFrame([(1, "Unknown", 7, "new"), (3, "z", 1, "q")], "id int, place string, n int, more string")
    assert sorted(map(tuple, formats.with_details(cards, details, "id").collect())) == [(1, "x", 7, "new"), (2, "y", 6, None)]


def test_auctions_and_notices(spark):
    cards = spark.createDataFrame([(1, "Къща", "от 01.02.2026 до 05.03.2026 г."), (2, "Къща", "от 01.01.2026 до 02.01.2026"), (3, "Гараж", ""), (4, " Къща", None)], "id int, c string, t string")
    got = formats.auctions(cards, "c", "t", F.lit("2026-03-01").cast("timestamp_ntz"), {"Къща": ("house", None), "Двустаен": ("apartment", 2)}).collect()
    assert sorted((r["id"], r["property_type"], r["rooms"], str(r["auction_end"])) for r in got) == [(1, "house", None, "2026-03-05 23:59:59"), (4, "house", None, "None")]
    rows = [(1, "Търг стр.", "Търг № 5-А от 3 март 2026", 10), (2, "търг стр.", "търг файл", 13 * 1024 * 1024), (3, "друго", None, None), (4, None, " ", 1)]
    got = {r["id"]: (r["text"], r["decision"], str(r["decided_on"])) for r in formats.notices(spark.createDataFrame(rows, "id int, p string, a string, s long"), "id", "p", "a", "s", ("търг",)).collect()}
    assert got == {1: ("Търг № 5-А от 3 март 2026", "5-А", "2026-03-03"), 2: ("търг стр.", None, "None")}
