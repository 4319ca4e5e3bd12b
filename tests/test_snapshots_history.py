import datetime as dt
import random

from pyspark.sql import functions as F

from brickstream.operators import history, snapshots

T = dt.datetime
SNAP = "snapshot_date timestamp_ntz, source string, source_id string, price_eur double, area_sqm double, is_active boolean, is_sold boolean, loaded_at timestamp_ntz, extra string"
LIST = "source string, source_id string, extra string"


def changes_of(spark, rows, listings=()):
    snaps = spark.createDataFrame([(*r, "x") for r in rows], SNAP)
    known = spark.createDataFrame([(*r, "y") for r in listings], LIST)
    return {tuple(r)[:4]: r["changed_fields"] for r in snapshots.listing_changes(snaps, known).collect()}


def row(day, sid, price=1.0, area=2.0, active=True, sold=False, load=1, source="a"):
    return (T(2026, 1, day), source, sid, price, area, active, sold, T(2026, 1, day, load) if load is not None else None)


def test_added_removed_changed_and_null_values(spark):
    got = changes_of(spark, [row(1, "k1"), row(1, "K2 "), row(8, "k1", price=1.001), row(8, "k3"), row(15, "k1", area=None), row(15, "k3", area=float("nan"))])
    assert got == {
        ("2026-01-08", "a", "k2", "removed"): [], ("2026-01-08", "a", "k3", "added"): [],
        ("2026-01-15", "a", "k1", "changed"): ["area_sqm"], ("2026-01-15", "a", "k3", "changed"): ["area_sqm"],
    }


def test_last_load_counts_and_skipped_dates_are_per_source(spark):
    got = changes_of(spark, [row(1, "k"), row(8, "k", price=9.0, load=1), row(8, "k", price=1.0, load=5), row(1, "z", source="b"), row(15, "z", price=3.0, source="b"), row(15, "k")], [("a", "K", ), ("b", "z")])
    assert got == {("2026-01-15", "b", "z", "changed"): ["price_eur"]}


def test_spelling_of_listings_and_nulls_in_keys(spark):
    got = changes_of(spark, [row(1, "x"), row(8, " ab-1 "), (None, "a", "q", 1.0, 1.0, True, False, None), (T(2026, 1, 8), None, "q", 1.0, 1.0, True, False, None), row(8, None)], [("a", "AB-1")])
    assert got == {("2026-01-08", "a", "AB-1", "added"): [], ("2026-01-08", "a", "x", "removed"): []}


def test_empty_snapshots(spark):
    assert changes_of(spark, []) == {}


def test_random_snapshots_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for s in "abc":
        for day in (1, 8, 15, 22):
            if rng.random() < 0.2:
                continue
            rows += [row(day, f"i{k}", price=float(rng.randint(1, 3)), sold=rng.random() < 0.3, load=n, source=s) for k in range(20) for n in range(1, rng.randint(1, 3)) if rng.random() < 0.8]
    by = {}
    for r in sorted(rows, key=lambda r: r[7]):
        by.setdefault((r[1], r[0]), {})[r[2]] = r[3:7]
    want = set()
    for s in "abc":
        days = sorted(d for x, d in by if x == s)
        for p, q in zip(days, days[1:], strict=False):
            a, b, day = by[s, p], by[s, q], q.strftime("%Y-%m-%d")
            want |= {(day, s, k, "added") for k in b.keys() - a.keys()} | {(day, s, k, "removed") for k in a.keys() - b.keys()} | {(day, s, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert set(changes_of(spark, rows)) == want


HIST = "id long, listing_id long, price_eur double, price_per_sqm_eur double, recorded_at timestamp_ntz, extra string"
LISTING = "id long, first_price_eur double, first_seen timestamp_ntz, extra string"


def periods(spark, hist, listings=()):
    h = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(hist, 1)], HIST)
    return sorted(map(tuple, history.price_periods(h, spark.createDataFrame([(*r, "y") for r in listings], LISTING)).collect()))


def test_periods_ties_returns_and_missing_prices(spark):
    a, b, c = T(2026, 1, 1), T(2026, 2, 1), T(2026, 2, 5)
    got = periods(spark, [(1, 100.0, None, a), (1, 100.004, None, b), (1, 90.0, None, c), (1, 95.0, None, c), (1, 0.0, None, T(2026, 3, 1)), (1, None, None, T(2026, 3, 2)), (1, 100.0, None, T(2026, 4, 1)), (1, float("nan"), None, T(2026, 5, 1)), (2, 7.0, None, None)])
    assert got == [(1, "2026-01-01 00:00:00", "2026-02-05 00:00:00"), (1, "2026-02-05 00:00:00", "2026-04-01 00:00:00"), (1, "2026-04-01 00:00:00", "9999-12-31 00:00:00")]


def test_first_price_yields_to_history_of_the_same_time(spark):
    a = T(2026, 1, 1)
    assert periods(spark, [(1, 5.0, None, T(2026, 1, 2)), (1, 8.0, None, a)], [(1, 5.0, a), (3, 0.0, a), (4, 9.0, None)]) == [(1, "2026-01-01 00:00:00", "2026-01-02 00:00:00"), (1, "2026-01-02 00:00:00", "9999-12-31 00:00:00")]


def test_empty_history(spark):
    assert periods(spark, []) == []


def test_store_folds_back_to_every_state(spark):
    rng = random.Random(1)
    rows = [(k, T(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 200), seconds=rng.randint(0, 9)), rng.choice([None, 1, 2]), rng.choice(["x", "y", None])) for k in range(4) for _ in range(60)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "_key long, _at timestamp_ntz, a int, b string")
    stored = history.store(df, ["a", "b"]).cache()
    assert {r[0] for r in stored.select("_kind").distinct().collect()} == {"full", "patch"}
    got = {(r["_key"], r["valid_from"]): (r["a"], r["b"], r["valid_to"]) for r in history.validity(stored, ["a", "b"]).collect()}
    want = {}
    for k in range(4):
        last = None
        for r in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            if last is None or want[last][:2] != r[2:]:
                if last:
                    want[last] = (*want[last][:2], r[1])
                last = (k, r[1])
                want[last] = (*r[2:], None)
    assert got == want
    moment = T(2026, 4, 1)
    state = {r["_key"]: (r["a"], r["b"]) for r in history.as_of(stored, ["a", "b"], F.lit(moment).cast("timestamp_ntz")).collect()}
    assert state == {k: max(((t, v) for (key, t), v in want.items() if key == k and t <= moment), key=lambda x: x[0])[1][:2] for k in range(4)}
