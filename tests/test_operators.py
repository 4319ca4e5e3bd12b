import datetime as dt
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from brickstream.functions import scalars as S
from brickstream.operators import components, dedup, hedonic, neardup, series, signals, state, tiers
from brickstream.plans import reference

T = dt.datetime
TIERS = ["hood", "kind", "build"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def stats_of(spark, rows, least=5):
    return tiers.tiered_stats(frame(spark, rows, "hood string, kind string, build string, p double"), TIERS, "p", least)


def test_tiers_drop_small_groups_and_tell_null_from_rolled_up(spark):
    rows = [("A", "flat", "brick", float(x)) for x in range(1, 6)] + [("A", "flat", None, 9.0)] * 5 + [("B", "flat", "brick", 1.0)] * 4
    got = {(r.hood, r.kind, r.build): r for r in stats_of(spark, rows).collect()}
    assert set(got) == {("A", "flat", "brick"), ("A", "flat", "unknown"), ("A", "flat", "all"), ("A", "all", "all")}
    r = got["A", "flat", "brick"]
    assert (r["median"], r["count"], r["min"], r["max"]) == (3.0, 5, 1.0, 5.0)
    assert abs(r["std"] - statistics.pstdev(range(1, 6))) < 1e-12 and abs(r["p20"] - np.percentile(range(1, 6), 20)) < 1e-12


def test_one_anomaly_and_none_without_deviation(spark):
    rows = [(i, "A", "flat", "brick", p) for i, p in enumerate([1000.0] * 4 + [500.0])] + [(9 + i, "B", "flat", "brick", 700.0) for i in range(5)]
    df = frame(spark, rows, "id long, hood string, kind string, build string, p double")
    got = tiers.anomalies(df, tiers.tiered_stats(df, TIERS, "p"), TIERS, "p", -1.5, 0.85).collect()
    assert [(r["id"], round(r["zscore"], 6)) for r in got] == [(4, -2.0)]


def test_lookup_falls_back_by_tier(spark):
    rows = [(i, "A", "flat", "brick", 10.0) for i in range(5)] + [(7, "A", "flat", "panel", 10.0), (8, "A", "plot", None, 10.0), (9, None, "flat", "brick", 1.0)]
    df = frame(spark, rows, "id long, hood string, kind string, build string, p double")
    out = {r["id"]: r["basis"] for r in tiers.tier_lookup(df, tiers.tiered_stats(df, TIERS, "p"), TIERS, ["median"]).collect()}
    assert (out[0], out[7], out[8], out[9]) == (0, 1, 2, None)


def test_empty_tables_everywhere(spark):
    empty = frame(spark, [], "id long, hood string, kind string, build string, p double, at timestamp_ntz, h string")
    assert stats_of(spark, []).count() == 0
    assert series.latest(empty, "hood", ["at"], ["p"]).count() == 0
    assert series.collapse_runs(empty, "hood", ["at"], "p").count() == 0
    assert neardup.near_pairs(empty, "id", "h", 3).count() == 0
    assert components.connected_components(empty, "hood", "kind").count() == 0
    assert dedup.duplicate_totals(empty, "hood").first()["unique_keys"] == 0
    assert signals.worst(frame(spark, [], "status string")).first()["status"] == "green"


def test_winner_and_backfill_order(spark):
    rows = [(1, "k", 2, 5, None, 0), (2, "k", 1, 3, "brick", 7), (3, "k", 1, 4, None, 0), (4, "z", 9, 1, "", None)]
    df = frame(spark, rows, "id long, fp string, prio int, filled int, build string, floor int")
    won = {r["id"] for r in dedup.winners(df, "fp", "prio", "filled", "id").filter("is_winner").collect()}
    assert won == {3, 4}
    got = {r["fp"]: (r["build"], r["floor"]) for r in dedup.backfilled(df, "fp", ["prio", "id"], ["build", "floor"]).collect()}
    assert got == {"k": ("brick", 7), "z": (None, None)}


def test_runs_keep_the_last_of_equal_values_and_nulls(spark):
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None), ("a", 4, None), ("a", 5, 5.0), ("b", 1, 1.0)]
    got = sorted((r["k"], r["t"]) for r in series.collapse_runs(frame(spark, rows, "k string, t int, v double"), "k", ["t"], "v").collect())
    assert got == [("a", 2), ("a", 4), ("a", 5), ("b", 1)]


def test_runs_and_asof_over_periods_equal_those_without(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), T(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 150)), i, float(rng.randint(1, 2))) for i in range(300)]
    df = frame(spark, rows, "k string, t timestamp_ntz, id long, v double")
    plain = sorted(map(tuple, series.collapse_runs(df, "k", ["t", "id"], "v").select("k", "t", "id").collect()))
    split = sorted(map(tuple, series.collapse_runs(df, "k", ["t", "id"], "v", period="month").select("k", "t", "id").collect()))
    assert plain == split
    left = frame(spark, [(i, rng.choice("abz"), T(2025, 12, 1) + dt.timedelta(days=rng.randint(0, 250))) for i in range(200)], "i long, k string, at timestamp_ntz")
    right = df.groupBy("k", "t").agg(F.max("id").alias("x"))
    want = {}
    facts = [tuple(r) for r in right.collect()]
    for r in left.collect():
        before = [(t, x) for k, t, x in facts if k == r["k"] and t <= r["at"]]
        want[r["i"]] = max(before)[1] if before else None
    assert {r["i"]: r["x_asof"] for r in series.asof_join(left, right, "k", "at", "t", ["x"]).collect()} == want


def test_percentile_counts_equals_and_keeps_repeated_rows(spark):
    rows = [("a", 1800.0), ("a", 2000.0), ("a", 2200.0), ("b", 1.0), ("b", 1.0), (None, 3.0), ("a", None)]
    got = sorted(((r["k"] or "", r["v"] or 0, r["p"]) for r in series.rank_pct(frame(spark, rows, "k string, v double"), "k", "v", "p").collect()), key=str)
    assert got == sorted([("", 3.0, 100.0), ("a", 0, None), ("a", 1800.0, 33.3), ("a", 2000.0, 66.7), ("a", 2200.0, 100.0), ("b", 1.0, 100.0), ("b", 1.0, 100.0)], key=str)


def test_asof_join_takes_the_last_before_or_at(spark):
    left = frame(spark, [(1, "a", T(2026, 1, 5)), (2, "a", T(2026, 1, 1)), (3, "b", T(2026, 1, 1))], "id long, k string, t timestamp_ntz")
    right = frame(spark, [("a", T(2026, 1, 1), 1.0), ("a", T(2026, 1, 5), 2.0), ("a", T(2026, 1, 9), 3.0)], "k string, t timestamp_ntz, v double")
    got = {r["id"]: r["v_asof"] for r in series.asof_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None}


def test_interleave_takes_turns(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "c")]
    got = [r["id"] for r in series.interleave(frame(spark, rows, "id long, lane string"), "lane", [F.col("id")], 3).collect()]
    assert got == [1, 3, 4]


def brute_pairs(hashes, bits):
    hs = sorted(set(hashes))
    return {(a, b) for i, a in enumerate(hs) for b in hs[i + 1 :] if (int(a, 16) ^ int(b, 16)).bit_count() <= bits}


def test_near_pairs_against_brute_force_and_with_a_hot_hash(spark):
    rng, hs = random.Random(2), []
    for _ in range(60):
        x = rng.getrandbits(64)
        hs += [f"{x:016x}"] + [f"{x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 8))):016x}" for _ in range(2)]
    rows = [(i, h) for i, h in enumerate(hs + [hs[0]] * 200)] + [(9999, None), (9998, "xyz")]
    df = frame(spark, rows, "id long, h string")
    for bits in (3, 6):
        got = {(r[0], r[1]) for r in neardup.near_pairs(df, "id", "h", bits).select("hash_a", "hash_b").collect()}
        assert got == brute_pairs(hs, bits)
    members = {r["id"]: r["members"] for r in neardup.hash_classes(df, "id", "h").collect()}
    assert members[0] == 201 and 9998 not in members


def test_cap_skips_crowded_hashes(spark):
    df = frame(spark, [(i, f"{1 << i:016x}") for i in range(5)], "id long, h string")
    assert neardup.near_pairs(df, "id", "h", 2).count() == 10
    assert neardup.capped_pairs(df, "id", "h", 2, 9).count() == 10
    assert neardup.capped_pairs(df, "id", "h", 2, 2).count() == 0


def test_near_pairs_keys_are_never_broadcast(spark):
    df = spark.range(3000).select("id", F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("h"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for bits in (3, 6):
            pairs = neardup.near_pairs(df, "id", "h", bits)
            pairs.collect()
            # the plan as it ran, after the hashes' size was known
            assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_composite_broadcasts_no_keys_of_near_pairs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        scores = reference.authenticity_composite(spark, "/root/testdata/sf0.01")
        scores.collect()
        joins = [line for line in scores._jdf.queryExecution().executedPlan().toString().splitlines() if "hash_a" in line and "hash_b" in line and "Join" in line]
        assert any("SortMergeJoin" in line for line in joins)
        assert not any("BroadcastHashJoin" in line for line in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_composite_broadcasts_nothing_that_grows(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: {(x := store.executionsList().apply(i)).executionId(): x.physicalPlanDescription() for i in range(store.executionsList().size())}
    before, old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), set(runs())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        reference.authenticity_composite(spark, "/root/testdata/sf0.01").collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        # the plans as they ran, those of the steps that are written, too
        ran = [plan for k, plan in runs().items() if k not in old]
        assert any("SortMergeJoin" in plan for plan in ran)
        assert not any("BroadcastExchange" in plan.partition("Initial Plan")[0] for plan in ran)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_simhash_is_near_for_near_texts(spark):
    a = " ".join(f"дума{i}" for i in range(60))
    df = frame(spark, [(1, a), (2, a + " край"), (3, " ".join(f"друго{i}" for i in range(60))), (4, None), (5, "къс")], "id long, t string")
    h = {r["id"]: int(r["simhash"], 16) for r in neardup.simhash(df, "id", series.shingles(F.col("t"), 4)).collect()}
    assert set(h) == {1, 2, 3} and (h[1] ^ h[2]).bit_count() < 8 < (h[1] ^ h[3]).bit_count()


def test_text_pairs_against_brute_force_and_beyond_three_bits(spark):
    rng, texts = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 90))]
        texts.append(" ".join(words))
        for _ in range(4):
            at = rng.randrange(len(words))
            texts.append(" ".join([*words[:at], *[f"x{rng.randint(0, 9)}"] * rng.randint(0, 2), *words[at + rng.randint(0, 1) :]]))
    texts += [texts[0].upper()] * 50 + ["one two three", "", None]
    df = frame(spark, list(enumerate(texts)), "id long, t string")
    sets = neardup.text_sets(df, "id", "t", 5)
    classes = {r["id"]: r["hash_class"] for r in sets.collect()}
    grams = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        if len(w) >= 5:
            grams[classes[i]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r[0], r[1]): r[2] for r in neardup.jaccard_pairs(sets, 0.8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    bits = {r["id"]: int(r["simhash"], 16) for r in neardup.simhash(df, "id", series.shingles(F.col("t"), 5)).collect()}
    one = {c: bits[i] for i, c in classes.items() if i in bits}
    assert len(want) > 20 and any((one[a] ^ one[b]).bit_count() > 3 for a, b in got)


def test_every_text_has_a_class(spark):
    texts = ["Следва обобщение.", "следва  обобщение", "следва", None, None, "", " \u00a0\n", "!!", " !! ", "a b c d e f", "A, b c d e f.", "a b c d e g"]
    df = frame(spark, list(enumerate(texts)), "id long, t string")
    got = {r["id"]: (r["hash_class"], r["members"]) for r in neardup.text_classes(df, "id", "t", 5).collect()}
    assert sorted(got) == list(range(len(texts))) and got[3][0] == "null" and got[5][0] == "blank"
    assert [got[i][1] for i in range(len(texts))] == [2, 2, 1, 2, 2, 2, 2, 2, 2, 2, 2, 1]
    assert len({c for c, _ in got.values()}) == 7


def test_components_chain_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 8), (5, 5), (None, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(frame(spark, edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


def test_upsert_changes_history_and_keeps_the_rest(spark):
    cur = frame(spark, [("s", "1", 10.0, 12.0, 1, T(2026, 1, 1), T(2026, 1, 1), False), ("s", "2", 5.0, 5.0, 0, T(2026, 1, 1), T(2026, 1, 1), True)], "source string, source_id string, price double, first_price double, price_changes int, first_seen timestamp_ntz, last_seen timestamp_ntz, is_active boolean")
    new = frame(spark, [("s", "1", 9.0), ("s", "3", 7.0)], "source string, source_id string, price double")
    now = F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    table, delta = state.upsert(cur, new, ["source", "source_id"], ["price"], "price", now)
    got = {r["source_id"]: (r["price"], r["first_price"], r["price_changes"], r["is_active"], r["last_seen"].month) for r in table.collect()}
    assert got == {"1": (9.0, 12.0, 2, True, 2), "2": (5.0, 5.0, 0, True, 1), "3": (7.0, 7.0, 0, True, 2)}
    assert sorted((r["source_id"], r["price"]) for r in delta.collect()) == [("1", 10.0), ("3", 7.0)]


def test_missing_spares_thin_sources(spark):
    active = frame(spark, [("a", str(i)) for i in range(5)] + [("b", str(i)) for i in range(5)], "source string, sid string")
    seen = frame(spark, [("a", "0"), ("a", "1")] + [("b", str(i)) for i in range(4)], "source string, sid string")
    assert [tuple(r) for r in state.missing(active, seen, "source", "sid", 0.5).collect()] == [("b", "4")]


def test_overlay_replaces_and_fills(spark):
    old = frame(spark, [(1, "x", ""), (2, "y", "keep")], "id long, a string, b string")
    new = frame(spark, [(1, None, "n"), (2, "z", "n")], "id long, a string, b string")
    assert sorted(map(tuple, state.overlay(old, new, "id", ["a"], ["b"]).collect())) == [(1, "x", "n"), (2, "z", "keep")]


def test_reposts_need_an_older_inactive_ad_of_another_id(spark):
    rows = [(1, "p", True, T(2026, 2, 1), "s1"), (2, "p", False, T(2026, 1, 1), "s2"), (3, "q", True, T(2026, 2, 1), "s3"), (4, "q", False, T(2026, 1, 1), "s3"), (5, None, True, T(2026, 2, 1), "s5"), (6, None, False, None, "s6")]
    df = frame(spark, rows, "id long, phone string, act boolean, seen timestamp_ntz, sid string")
    assert sorted(r[0] for r in signals.reposts(df, "id", ["phone"], F.col("act"), "seen", "sid").collect()) == [1, 5]


def test_reuse_against_brute_force(spark):
    rng = random.Random(9)
    hs = [f"{rng.getrandbits(64):016x}" for _ in range(12)]
    hs += [f"{int(h, 16) ^ 3:016x}" for h in hs[:6]]
    rows = [(i, rng.choice(hs + [None]), rng.choice("pqrstuvwxyz"), rng.choice(["A", "A", "B", "", None]), rng.choice([None, 0.0, 75.0, 90.0, 100.0, 110.0])) for i in range(60)]
    df = frame(spark, rows, "id long, h string, who string, hood string, p double")
    near = neardup.near_pairs(df, "id", "h", 3)
    close = lambda a, b: a[0] != b[0] and a[1] and b[1] and a[2] != b[2] and (int(a[1], 16) ^ int(b[1], 16)).bit_count() <= 3
    apart = lambda a, b: (a[3] and b[3] and a[3] != b[3]) or (a[4] and b[4] and abs(a[4] - b[4]) / max(a[4], b[4]) >= 0.25)
    ids = lambda *args: {r[0] for r in signals.reused(df, "id", "h", near, *args).collect()}
    assert ids("who") == {a[0] for a in rows if any(close(a, b) for b in rows)}
    want = {a[0] for a in rows if any(close(a, b) and apart(a, b) for b in rows)}
    assert ids("who", "hood", "p") == want and 5 < len(want) < 60


def test_flags_score_and_colours(spark):
    df = frame(spark, [(1, True, None), (2, True, True), (3, False, False)], "id long, a boolean, b boolean")
    flags = signals.flagged([("a", 70, F.col("a")), ("b", 50, F.col("b"))])
    assert {r[0]: r[1] for r in df.select("id", signals.penalty_score(flags)).collect()} == {1: 30, 2: 0, 3: 100}
    v = frame(spark, [(None,), (10.0,), (35.0,), (80.0,)], "v double").select(signals.coloured(F.col("v"), 30, 60).alias("status"))
    assert [r[0] for r in v.collect()] == ["amber", "green", "amber", "red"] and signals.worst(v).first()[0] == "red"


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()[0]

    assert [value(S.phone(F.lit(x))) for x in ("0888 000 000", "+359 2 000 0000", "00359888000000", "12", "888000000")] == ["+359888000000", "+35920000000", "+359888000000", None, "+359888000000"]
    assert [value(S.email(F.lit(x))) for x in (" A@B.bg ", "a@b", "x y@z.bg", None)] == ["a@b.bg", None, None, None]
    assert [value(S.localized_number(F.lit(x))) for x in ("195 583.00 лв.", "1.234,5 €", "abc", None)] == [195583.0, 1234.5, None, None]
    assert value(S.price_band(F.lit(100000.0))) == value(S.price_band(F.lit(102000.0))) != value(S.price_band(F.lit(112000.0)))
    assert [value(S.decade(F.lit(x).cast("int"))) for x in (None, 0, 1950, 1985, 2024)] == ["unknown", "unknown", "<1960", "1980s", ">=2020"]
    assert [str(value(S.notice_date(F.lit(x)))) for x in ("2026-07-12", "от 5.3.2026 г.", "12 Юли 2026", "99.99.2026", "?")] == ["2026-07-12", "2026-03-05", "2026-07-12", "None", "None"]
    assert [value(S.rooms_bucket(F.lit(x).cast("int"))) for x in (None, 0, 2, 7)] == ["all", "1", "2", "4+"]
    assert value(S.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    assert value(S.materially_different(F.lit("a"), F.lit("a"), F.lit(100.0), F.lit(75.0), 0.25)) is True
    assert value(S.json_list(F.lit("{bad"))) == [] and value(S.json_text(F.lit("{bad"), "$.view")) == "unknown"
    assert [value(S.response_state(F.lit(s).cast("int"), F.lit("обявата е изтрита"), "изтрита")) for s in (404, 500, None, 200)] == ["gone", "unknown", "unknown", "gone"]
    assert value(S.url_key(F.lit("https://a.bg/x/flat-1?q=1"))) == "flat-1"
    assert value(S.normalize_place(F.lit("  кв. Орешак "))) == "орешак" and value(S.normalize_place(F.lit(None).cast("string"))) == "unknown"
    assert value(S.whole_days(F.lit("2026-01-03 00:00:00").cast("timestamp_ntz"), F.lit("2026-01-01 12:00:00").cast("timestamp_ntz"))) == 1


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(0)
    n, rows = 220, []
    for i in range(n):
        area, floor, rooms = 35 + i % 90, i % 9, 1 + i % 4
        rows.append((i, "A" if i % 2 else "B", float(area), int(floor), 9, rooms, 1990 + i % 20, "apartment", "brick" if i % 3 else "panel", "private", "good", "none", True, False, 5, 1050 + (350 if i % 2 else 0) + 11 * area + 24 * floor + float(rng.normal(0, 5))))
    df = frame(spark, rows, "id long, hood string, area_sqm double, floor int, total_floors int, rooms int, year_built int, property_type string, construction_type string, seller_type string, renovation_state string, parking string, has_elevator boolean, act16 boolean, image_count int, p double")
    enc = hedonic.smoothed_target(df, "hood", "p", 20.0)
    ready = hedonic.features(df, enc, "hood", 2026).withColumn("target", F.log("p")).cache()
    model = hedonic.fit(ready, "target", 0.1)
    d, cols = hedonic.design(ready, model.means, model.stds, model.categories)
    x = np.array(d.orderBy("id").select(*cols).collect(), float)
    y = np.array([r[0] for r in d.orderBy("id").select("target").collect()])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 0.1 * np.eye(x.shape[1]), xc.T @ yc)
    want = np.exp(x @ w + (y.mean() - x.mean(0) @ w))
    scored = hedonic.score(ready, model, "p")
    got = np.array([r[0] for r in scored.orderBy("id").select("predicted_per_sqm").collect()])
    assert np.abs(got - want).max() < 0.02
    q = hedonic.quality(scored, "p", "predicted_per_sqm").first()
    assert q["r2"] > 0.95 and q["mae_pct"] < 2
    top = scored.select(hedonic.contributions(scored, model).alias("c")).first()["c"]
    assert len(top) == 5 and abs(top[0]["impact_pct"]) >= abs(top[-1]["impact_pct"])


def test_plan_has_pruned_scan_and_single_exchange(spark, tmp_path):
    frame(spark, [(1, "A", "x", "y", 1.0)], "id long, hood string, kind string, build string, p double").write.parquet(str(tmp_path / "t"))
    df = tiers.tiered_stats(spark.read.parquet(str(tmp_path / "t")).filter("p > 0"), TIERS, "p")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p,0.0)" in plan.split("PushedFilters")[1] and "ReadSchema: struct<hood:string,kind:string,build:string,p:double>" in plan and plan.count("Exchange hashpartitioning") == 1
