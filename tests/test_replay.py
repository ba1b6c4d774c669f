"""The whole replay on small trips whose truth is known, and its parts by themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.functions.route import Atlas, Route
from wayside.operators import folds, fusion, joins, replay
from wayside.plans import perturbations, trips
from wayside.plans.maps import ring
from wayside.schema import FLAGS, PREDICTION, Settings

S = Settings()
T0, STEP = 1_000_000_000, 50_000
LINE = Route(np.array([[0.0, 2000.0, 5.0], [150.0, 2000.0, 5.0], [200.0, 2000.0, 5.0]]))
ANGLES = np.linspace(0, 2 * np.pi, 181)
RING = Route(np.stack([400 * np.cos(ANGLES), 400 * np.sin(ANGLES), 0 * ANGLES], axis=1)[np.r_[:180, 0]], closed=True)


def trip(run, way, start, seconds=12, scale=1.0, fixes=True, late=0):
    """Ticks and fixes of a trip at 10 m/s; late: how much later than measured fixes come."""
    ticks = [(run, T0 + k * STEP, T0 + k * STEP, 10.0 * scale, 0, False) for k in range(20 * seconds)]
    seen = []
    for k in range(2 * seconds if fixes else 0):
        for side, x in enumerate((S.antenna_rear, S.antenna_front)):
            stamp = T0 + k * 500_000 + side * 10_000
            p = way.antenna(np.array([start + 10 * (stamp - T0) / 1e6]), x, S.antenna_height)[0]
            seen.append((run, 2 * k + side, side, stamp, stamp + late, *map(float, p)))
    return ticks, seen


def run_all(spark, trips, maps, s=S):
    ticks = spark.createDataFrame([r for t, _ in trips for r in t], "run string, stamp long, arrival long, velocity double, flags int, stale boolean")
    fixes = spark.createDataFrame([r for _, f in trips for r in f], "run string, id long, side int, stamp long, arrival long, x double, y double, z double")
    found = replay.replay(ticks, fixes, "run", maps, s)
    assert found.columns == ["run", *PREDICTION.names]
    assert [f.dataType for f in found.schema.fields[1:]] == [f.dataType for f in PREDICTION.fields]
    rows = {}
    for r in sorted(found.collect(), key=lambda r: r["stamp"]):
        rows.setdefault(r["run"], []).append(r)
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    trips = [
        trip("ring", RING, 100, scale=1.05),
        trip("line", LINE, 100),
        trip("blind", RING, 0, fixes=False),
        trip("stale", RING, 0, late=1_500_000),
    ]
    return run_all(spark, trips, [RING, LINE])


def test_every_tick_comes_out_once(rows):
    assert {k: len(v) for k, v in rows.items()} == dict.fromkeys(("ring", "line", "blind", "stale"), 240)


def test_each_run_finds_its_own_map(rows):
    assert {k: {r["route"] for r in v if r["route"] >= 0} for k, v in rows.items()} == {"ring": {0}, "line": {1}, "blind": set(), "stale": {0}}


def test_corrections_hold_a_run_whose_wheels_read_too_much(rows):
    truth = lambda r: RING.at(np.array([100 + 10 * (r["stamp"] - T0) / 1e6]))[0]
    off = [float(np.linalg.norm(np.array([r["x"], r["y"], r["z"]]) - truth(r))) for r in rows["ring"] if r["route"] >= 0]
    assert max(off) < 2.0
    # Fixes that are too old when they come match the first window but correct nothing: the wheels' error grows.
    stale = rows["stale"][-1]
    assert stale["route_s"] == pytest.approx(stale["distance"], abs=0.5)
    # 5 % of 119.5 m, less what the first window shares out.
    assert off[-1] < 0.5 * 0.05 * 119.5


def test_an_open_line_ends(rows):
    outside = [bool(r["flags"] & FLAGS["outside_map"]) for r in rows["line"]]
    crossed = outside.index(True)
    assert rows["line"][crossed]["route_s"] > LINE.end >= rows["line"][crossed - 1]["route_s"]
    assert all(outside[crossed:])
    assert not any(r["flags"] & FLAGS["outside_map"] for r in rows["ring"])


def test_velocity_is_in_the_axes_of_the_body(rows):
    last = rows["ring"][-1]
    assert (last["vx"], last["vz"]) == (pytest.approx(10.5, abs=0.02), pytest.approx(0.0, abs=1e-6))
    # A polygon turns at its corners only; over many of them it turns as its circle does.
    turns = [r["wz"] for r in rows["ring"] if r["route"] >= 0]
    assert np.mean(turns) == pytest.approx(10.5 / 400, rel=0.2)
    straight = rows["line"][100]
    assert [straight[c] for c in ("vx", "vy", "vz", "wx", "wy", "wz")] == pytest.approx([10, 0, 0, 0, 0, 0], abs=1e-6)
    assert straight["x"] - straight["mx"] == pytest.approx(-S.antenna_rear)
    assert straight["mz"] - straight["z"] == pytest.approx(S.antenna_height)


def test_without_a_place_the_way_counts_along_x(rows):
    for r in rows["blind"]:
        assert r["flags"] & FLAGS["not_initialized"]
        assert (r["x"], r["y"], r["route_s"]) == (r["distance"], 0.0, 0.0)


def test_windows_of_the_first_match_open_at_the_first_fix_after_the_last():
    stamps = np.array([0, 2, 3, 5, 7, 8, 8, 30, 33, 34])
    got, _ = folds.advance(replay.opening_fold(3), {"stamp": stamps, "begin": np.zeros(10, np.int64)}, np.zeros(1, int), np.array([10]))
    assert got["opened"].tolist() == [0, 0, 0, 5, 5, 5, 5, 30, 30, 34]


def test_an_atlas_corrects_each_run_by_its_own_map():
    """Lanes of two maps at once give what each map gives by itself."""
    rng = np.random.default_rng(3)
    n, ways = 12, (RING, LINE)
    parts = []
    for k, way in enumerate(ways):
        d = np.linspace(20, 140, n)
        at = way.antenna(d + 2.0, S.antenna_front, S.antenna_height) + rng.normal(0, 0.3, (n, 3))
        stamp = np.arange(n) * 1_000_000 + k
        parts.append({"stamp": stamp, "arrival": stamp + 200_000, "begin": np.zeros(n, np.int64), "distance": d, "x": at[:, 0], "y": at[:, 1], "ahead": np.full(n, S.antenna_front), "which": np.full(n, k), "side": np.ones(n, int)})
    both = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    got, _ = folds.advance(fusion.corrections_fold(Atlas(list(ways))), both, np.array([0, n]), np.array([n, n]))
    for k, way in enumerate(ways):
        alone, _ = folds.advance(fusion.corrections_fold(way), parts[k], np.zeros(1, int), np.array([n]))
        assert alone["taken"].all()
        for c, v in alone.items():
            np.testing.assert_allclose(got[c][k * n : (k + 1) * n], v, atol=1e-9)


def test_empty_inputs_give_no_rows(spark):
    assert run_all(spark, [([], [])], [RING]) == {}


def test_invariants_see_a_poisoned_replay(spark):
    """Negative controls: each fault is found by the invariant that is there for it, and by no other."""
    kinds = {f.name: f.dataType for f in PREDICTION.fields}
    first = {c: 0 if kinds[c].simpleString() == "bigint" else 0.0 for c in PREDICTION.names}
    clean = [(arm, 1, *({**first, "stamp": trips.BEGIN + k * 10_000_000}.values())) for arm in perturbations.ARMS for k in range(3)]
    schema = "arm string, run_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PREDICTION.fields)
    made = spark.createDataFrame(clean, schema).cache()
    late = (F.col("arm") == "outlier") & (F.col("stamp") == trips.BEGIN + 20_000_000)
    found = lambda df: {(r.arm, r.invariant) for r in trips.invariants(df).where("violations > 0").collect()}
    assert found(made) == set()
    assert found(made.withColumn("velocity", F.when(late, 9.0).otherwise(F.col("velocity")))) == {("outlier", "motion"), ("outlier", "rejected")}
    assert found(made.withColumn("flags", F.when(late, F.lit(8)).otherwise(F.col("flags")))) == {("outlier", "initialized"), ("outlier", "rejected")}
    assert found(made.withColumn("x", F.when(late, 9.0).otherwise(F.col("x")))) == {("outlier", "rejected")}
    assert found(made.withColumn("x", F.when((F.col("arm") == "bias") & (F.col("stamp") == trips.BEGIN), 9.0).otherwise(F.col("x")))) == {("bias", "early")}
    assert ("outlier", "stamps") in found(made.where(~late)) and ("outlier", "stamps") in found(made.unionByName(made.where(late)))


def test_arms_do_change_where_a_trip_is(spark):
    made = trips.replay_arms(spark, "/root/testdata/sf0.001").where("arm in ('provided', 'no_late', 'bias')")
    wide = made.groupBy("run_id", "stamp").pivot("arm", ["provided", "no_late", "bias"]).agg(F.first(F.struct("x", "y")))
    far = lambda arm: F.max(F.hypot(F.col(f"{arm}.x") - F.col("provided.x"), F.col(f"{arm}.y") - F.col("provided.y"))).alias(arm)
    assert all(1 < v < 20 for v in wide.agg(far("no_late"), far("bias")).first())


def test_fixes_that_arrive_after_a_later_window_closed_do_not_move_its_match(spark, tmp_path):
    spark.createDataFrame([(5,), (10,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    way = Route.of(ring(spark, "/root/testdata/sf0.001"), closed=True)
    ticks, fixes = trips.ticks(spark, str(tmp_path)), trips.fixes(spark, str(tmp_path), way)
    # Their window is of 3.02 to 6.02 s and closes at the tick of 6.05 s; fixes of 6.00 and 6.02 s arrive a tenth of a second later.
    late = F.when(F.col("stamp") >= trips.BEGIN + 5_900_000, 0.8).otherwise(0.0)
    made = [trips.replayed(ticks, rows, "run_id", [way], trips.S).where("init_rms > 0").groupBy("run_id").agg(F.min("stamp").alias("stamp"), F.min("init_rms").alias("low"), F.max("init_rms").alias("high")).collect() for rows in (fixes, fixes.withColumn("x", F.col("x") + late).withColumn("y", F.col("y") + late))]
    given, moved = (sorted(map(tuple, m)) for m in made)
    assert [r[:2] for r in given] == [(k, trips.BEGIN + 6_050_000) for k in (5, 10)]
    assert moved == given


def test_a_later_window_waits_for_fixes_measured_in_it(spark, tmp_path):
    """Of supplier 980 two pairs within the second window have come when it closes, both of a wrong length; the third comes 50 ms later."""
    spark.createDataFrame([(5,), (980,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    unplaced = lambda df: {r[0]: r[1] for r in df.groupBy("run_id").agg(F.count_if(F.col("flags").bitwiseAND(FLAGS["not_initialized"]) != 0)).collect()}
    assert unplaced(trips.replay(spark, str(tmp_path))) == {5: 121, 980: 121}
    assert unplaced(trips.replay(spark, str(tmp_path), waits=False)) == {5: 121, 980: 190}


def test_pairs_by_windows_are_those_of_the_join(spark):
    rng = np.random.default_rng(5)
    rows = [(int(r), k, int(s), int(t)) for k, (r, s, t) in enumerate(zip(rng.integers(0, 6, 900), rng.integers(0, 2, 900), rng.integers(0, 400, 900), strict=True))]
    df = spark.createDataFrame(rows, "run int, id long, side int, stamp long").repartition(5)
    names = ["run", "a_id", "a_stamp", "b_id", "b_stamp"]
    want = joins.band_pairs(*(df.where(F.col("side") == k).drop("side") for k in (0, 1)), ["run"], "stamp", 3).select(names)
    got = joins.nearest_pairs(df, ["run"], "stamp", "side", 3).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_ticks_are_not_shuffled(spark):
    """Trips are dealt to tasks before they have ticks; afterwards only fixes, pairs and what folds give are."""
    physical = trips.replay(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert physical.count("ENSURE_REQUIREMENTS") <= 10
