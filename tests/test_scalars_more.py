import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from brickstream.functions import images
from brickstream.functions import scalars as S


def test_more_scalars(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    lit = F.lit
    assert value(S.case_number(lit("по изп. дело № 2024 123-4, Дъбринград"))) == "2024123-4" and value(S.case_number(lit("нищо"))) is None
    assert value(S.decision_number(lit("Решение № 17-А от днес"))) == "17-А"
    assert tuple(value(S.date_window(lit("от 5.3.2026 до 06.04.2026 г.")))) == (dt.datetime(2026, 3, 5), dt.datetime(2026, 4, 6, 23, 59, 59))
    assert tuple(value(S.date_window(lit("-")))) == (None, None)
    names = ["Орешак", "Орешак 5", "Върбица"]
    assert [value(S.place_in_text(lit(t), names)) for t in ("жк орешак 5, бл. 2", "Орешакска ул.", "в Орешак!", "")] == ["Орешак 5", "Unknown", "Орешак", "Unknown"]
    assert value(S.image_link(lit("/a/b/"), lit("x"), "https://i.example/")) == "https://i.example/a/b/x.jpg" and value(S.image_link(lit("a"), lit(""), "h")) is None
    assert abs(value(S.token_cost(lit(1e6), lit(1e6), lit(1e6), lit(1e6), 1.0, 5.0)) - 7.35) < 1e-9
    assert [value(S.numbers_only(lit(x))) for x in ("1 234,5 €", "<500", None)] == [1234.5, None, None]
    assert value(S.backfilled_first_price(lit(float("nan")), lit(3.0))) == 3.0
    assert value(F.array_join(S.clip_list(F.array(lit("a"), lit("z"), lit("b")), ("a", "b"), 1), ",")) == "a"
    assert value(S.thousands(lit(1234567.0))) == "1 234 567"
    now = lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    assert [value(S.ago(lit(d).cast("timestamp_ntz"), now)) for d in ("2026-02-01 00:00:00", "2026-01-31 00:00:00", "2026-01-28 00:00:00", "2026-01-10 00:00:00", "2025-11-01 00:00:00")] == ["today", "yesterday", "4d ago", "3w ago", "3mo ago"]
    assert value(S.first_int(lit("3 от 8"))) == 3 and value(S.per_sqm(lit(100.0), lit(0.0))) is None
    assert value(S.photo_count(lit(None).cast("int"), lit('["a","b"]'), lit(None).cast("string"))) == 2
    assert [value(S.direction(lit(x).cast("double"), 0.5, "none")) for x in (None, 1.0, -1.0, 0.5)] == ["none", "up", "down", "stable"]


def test_image_hash_is_stable_under_brightness(spark):
    rng = np.random.default_rng(1)
    grey = rng.random((32, 32)) * 100
    a, b, c = (int(images.dct_hash(x), 16) for x in (grey, grey + 20 + rng.normal(0, 0.5, grey.shape), rng.random((32, 32)) * 100))
    assert (a ^ b).bit_count() <= 6 < (a ^ c).bit_count()
    df = spark.createDataFrame([(bytearray(b"no image"),), (None,)], "c binary")
    assert [r[0] for r in df.select(images.perceptual_hash(F.col("c"))).collect()] == [None, None]
