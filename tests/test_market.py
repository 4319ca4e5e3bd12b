from pyspark.sql import functions as F

from brickstream.functions import scalars as S
from brickstream.operators import tiers
from brickstream.plans import reference
from brickstream.sources import landing
from brickstream.streaming import streams


def values(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_place_forms(spark):
    got = values(spark, lambda c: S.place_form(c, "dabringrad"), "кв. Мостище", "Dabringrad Shtarkelovo", "Gotse Studentski", "Center East", "ЛЮЛИН  5.", "снимки 8 продава", "x" * 41, " ", None, "гр. ")
    assert got == ["Мостище", "щаркелово", "гоце студентски", "Център East", "ЛЮЛИН 5", None, None, None, None, "гр"]
    assert values(spark, S.sentence_case, "гоце ДЕЛЧЕВ", "", None) == ["Гоце делчев", "", None]


def test_motivation_of_sellers(spark):
    rows = [(0, 100.0, 100.0, None, 0, None), (4, 100.0, 70.0, 5, 200, 100.0), (1, None, None, 45, 150, 100.0), (None, 0.0, None, 3, 99, 100.0), (9, 100.0, 50.0, 61, 0, 0.0)]
    df = spark.createDataFrame(rows, "n int, f double, p double, d int, days int, m double")
    assert [r[0] for r in df.select(S.motivation(*[F.col(c) for c in ("n", "f", "p", "d", "days", "m")])).collect()] == [0, 100, 33, 0, 55]


def test_rows_of_unknown_type_are_plausible_and_homes_have_bounds(spark):
    df = spark.createDataFrame([(None, 7000.0), ("house", None), ("apartment", None), ("studio", 19.9), ("maisonette", 500.0)], "property_type string, area_sqm double")
    assert [r[0] for r in df.select(reference.plausible()).collect()] == [True, True, None, False, True]
    assert df.filter(reference.plausible()).count() == 3


def test_the_preferred_statistic_of_a_place(spark):
    rows = [("a", "all", 900.0, 9), ("a", "house", 800.0, 5), ("b", "all", 950.0, 7), ("c", "plot", 100.0, 7)]
    got = tiers.prefer(spark.createDataFrame(rows, "k string, t string, median double, count long"), "k", "t", ["apartment", "house", "all"], ["median"]).collect()
    assert sorted(map(tuple, got)) == [("a", 800.0, "house"), ("b", 950.0, "all")]


def test_attributes_and_lists(spark):
    text = "тристаен, 3-ти ет. от 8, тухла, лок. отопление, въведен в 1987 г., полуобзаведен"
    got = spark.createDataFrame([(text,), ("партер от 5, панел, тец, необзаведен",), ("",), (None,)], "t string").select(*S.attributes_in_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(3, 3, 8, "brick", "local", 1987, "partial"), (None, 0, 5, "panel", "central", None, "unfurnished"), (None,) * 7, (None,) * 7]
    assert values(spark, lambda c: S.clipped(c, 5), "abcdef", "abcde", None) == ["ab...", "abcde", None]


def test_first_of_each_key_and_merge(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "p"), (None, 1, "p")], "k string, n int, v string")
    assert sorted(map(tuple, landing.first_of_each(df, "k", ["n"]).collect()), key=str) == [("a", 1, "y"), (None, 1, "p"), (None, 1, "p")]
    new = spark.createDataFrame([("a", 5, "z"), (None, 7, "q")], "k string, n int, v string")
    assert sorted(map(tuple, streams.merged_by("k")(df, new).collect()), key=str) == [("a", 5, "z"), (None, 7, "q")]
    assert streams.merged_by("k")(None, new).count() == 2
