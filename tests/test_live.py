"""The merged fold: rings, lanes and splits; and what streams remember."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.functions.route import Route
from wayside.operators import live, observer
from wayside.operators.folds import advance, advance_all
from wayside.operators.rings import Ring
from wayside.schema import FLAGS, Settings
from wayside.streaming import lookup, state, timers

UNIT = live.UNIT
BEGIN = 1_700_000_000 * UNIT
LINE = Route(np.column_stack([np.arange(0, 2001, 50.0), np.zeros(41), np.full(41, 150.0)]))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_rings_are_bounded_queues():
    rng = random.Random(3)
    ring, plain = Ring("r", 7, {"v": (2,)}, (2,)), {(k, w): deque(maxlen=7) for k in range(5) for w in (0, 1)}
    held, stamp = ring.start(5), dict.fromkeys(plain, 0)
    for _ in range(600):
        k = np.array(sorted(rng.sample(range(5), rng.randrange(1, 6))))
        w = np.array([rng.randrange(2) for _ in k])
        queues = [plain[key] for key in zip(k.tolist(), w.tolist())]
        kind = rng.random()
        if kind < 0.6:
            t = []
            for key in zip(k.tolist(), w.tolist()):
                stamp[key] += rng.randrange(1, 5)
                t.append(stamp[key])
            full = ring.push(held, k, np.array(t), {"v": np.column_stack([t, t]) * 1.0}, w)
            assert full.tolist() == [len(q) == 7 for q in queues]
            for q, x in zip(queues, t):
                q.append(x)
        elif kind < 0.7:
            since = np.array([stamp[key] - rng.randrange(9) for key in zip(k.tolist(), w.tolist())])
            ring.keep(held, k, since, w)
            for q, s in zip(queues, since.tolist()):
                while q and q[0] < s:
                    q.popleft()
        elif kind < 0.75 and all(queues):
            assert ring.pop(held, k, w)["stamp"].tolist() == [q.popleft() for q in queues]
        at = np.array([stamp[key] - rng.randrange(12) for key in zip(k.tolist(), w.tolist())])
        found, (low, _) = ring.not_after(held, k, at, w), ring.range(held, k, w)
        assert (found - low).tolist() == [sum(x <= t for x in q) - 1 for q, t in zip(queues, at.tolist())]
        items = ring.items(held, k, w)
        assert [x[m].tolist() for x, m in zip(items["stamp"], items["live"])] == [list(q) for q in queues]
        assert ring.last(held, k, w).tolist() == [q[-1] if q else -(1 << 62) for q in queues]


def messages(seed, seconds=30, branch=None, fixes=True, wrong=None, stale=(), reset=None, late=0):
    """A trip's messages in order: wheels, commands and fixes along the line, or off it from ``branch`` on."""
    rng, out = random.Random(seed), []
    for i in range(seconds * 20):
        t = i / 20
        stamp = BEGIN + int(t * UNIT)
        if i % 2 == 0:
            out += [(live.WHEEL_FRONT + k, stamp, stamp + rng.randrange(20_000), 8 * 3.6, *[np.nan] * 3) for k in (0, 1)]
        if fixes and i % 4 == 0 and t >= late:
            for side in (0, 1):
                ahead = -9.873 if side == 0 else 2.563
                d = 8 * t + ahead
                x, y = 300 + d, 0.0
                if branch is not None and t > branch:
                    off = 8 * (t - branch) + ahead
                    x, y = 300 + 8 * branch + off * np.cos(0.5), off * np.sin(0.5)
                bad = 3.0 if wrong and wrong[0] <= t < wrong[1] and side else 0.0
                out.append((live.FIX_REAR + side, stamp, stamp + 10_000, np.nan, x + bad + rng.gauss(0, 0.03), y + rng.gauss(0, 0.03), 153.0))
        out.append((live.COMMAND if i not in stale else live.TICK, stamp, stamp + 15_000, 0.0, *[np.nan] * 3))
        if reset is not None and i == reset * 20:
            out.append((live.RESET, stamp, stamp + 15_000, *[np.nan] * 4))
    out.sort(key=lambda r: (r[2], r[0]))
    return out


def columns(runs):
    every = [r for run in runs for r in run]
    names = ("kind", "stamp", "arrival", "value", "x", "y", "z")
    x = {n: np.array([r[j] for r in every], np.int64 if j < 3 else float) for j, n in enumerate(names)}
    size = np.array([len(r) for r in runs])
    return x, np.cumsum(size) - size, size


TRIPS = [messages(1), messages(2, branch=12), messages(3, wrong=(8, 12)), messages(4, reset=15, stale=range(40, 60)), messages(5, late=5), messages(6, fixes=False), messages(7, 10)]


@pytest.fixture(scope="module")
def fold():
    return live.Live([LINE], Settings(departure=10.0), rules=observer.Rules(slip_accel=1.65, slip_decel=3.2), samples=64, opening=64).fold()


@pytest.fixture(scope="module")
def together(fold):
    x, begin, size = columns(TRIPS)
    out, _ = advance(fold, x, begin, size)
    return [{k: v[b : b + n] for k, v in out.items()} for b, n in zip(begin, size)]


def equal(one, two):
    return all(np.array_equal(one[k], two[k], equal_nan=one[k].dtype.kind == "f") for k in one)


def test_runs_do_not_see_each_other(fold, together):
    for trip, whole in zip(TRIPS, together, strict=True):
        x, begin, size = columns([trip])
        alone, _ = advance(fold, x, begin, size)
        assert equal(alone, whole)


@pytest.mark.parametrize("cut", [1, 37, 500])
def test_state_goes_on_across_batches(fold, together, cut):
    for trip, whole in zip(TRIPS[:4], together):
        states, parts = fold.start(1), []
        for k in range(0, len(trip), cut):
            x, begin, size = columns([trip[k : k + cut]])
            out, states = advance_all(fold, x, begin, size, states)
            states = state.from_bytes(fold, state.to_bytes(states))
            parts.append(out)
        assert equal({k: np.concatenate([p[k] for p in parts]) for k in whole}, whole)


def made(out):
    return {k: v[out["made"]] for k, v in out.items()}


def test_flags_and_places_of_trips(together):
    clean, branch, conflict, reset, late, blind, _ = (made(x) for x in together)
    bit = lambda x, name: (x["flags"] & FLAGS[name]) != 0
    marks = ("off_map", "rejoining", "pair_conflict", "slip")
    assert not any(bit(clean, n).any() for n in marks) and clean["rejected"][-1] == 0 and clean["accepted"][-1] > 200
    t = np.arange(len(clean["flags"])) / 20
    assert np.abs(clean["route_s"] - 300 - 8 * t)[t > 5].max() < 0.2
    off = t[bit(branch, "off_map")]
    assert 12 < off[0] < 20 and bit(branch, "off_map")[t >= off[0]].all()
    truth = np.column_stack([300 + 96 + 8 * (t - 12) * np.cos(0.5), 8 * (t - 12) * np.sin(0.5)])
    place = np.column_stack([branch["free_x"], branch["free_y"]])
    assert np.hypot(*(place - truth)[t > off[0] + 1].T).max() < 0.5
    seen = t[bit(conflict, "pair_conflict")]
    assert 8 <= seen[0] < 8.5 and 11.5 < seen[-1] < 13.5 and not bit(conflict, "off_map").any()
    assert bit(reset, "not_initialized")[t.searchsorted(15.0) + 1] and reset["distance"][-1] < 8 * 15.5 and (np.diff(reset["distance"]) < 0).sum() == 1
    assert bit(reset, "stale_command").sum() == 10  # half a second after the last of the commands before the gap
    # The first window closes without a match, later ones are tried; what was seen before does not come back.
    waits = bit(late, "not_initialized")
    assert waits[t < 5].all() and not waits[t > 5.5].any()
    assert bit(blind, "not_initialized").all() and np.allclose(blind["distance"], 8 * t, atol=0.5)


def test_estimates_of_a_table(spark, together):
    every = [(f"r{k}", n, *(None if isinstance(v, float) and np.isnan(v) else float(v) if j > 2 else v for j, v in enumerate(row))) for k, trip in enumerate(TRIPS) for n, row in enumerate(trip)]
    kind = "run string, id long, kind int, stamp long, arrival long, value double, x double, y double, z double"
    df = spark.createDataFrame(every, kind).repartition(5).withColumn("extra", F.lit(1))
    s, rules = Settings(departure=10.0), observer.Rules(slip_accel=1.65, slip_decel=3.2)
    got = live.estimate(df, "run", [LINE], s, rules=rules, samples=64, opening=64, held=3000).orderBy("run", "stamp").toPandas()
    for k, whole in enumerate(together):
        want, own = made(whole), got[got["run"] == f"r{k}"]
        assert np.array_equal(own["flags"], want["flags"]) and np.array_equal(own["distance"], want["distance"]) and np.array_equal(own["route_s"], want["route_s"])
        free = (want["flags"] & FLAGS["off_map"]) != 0
        assert np.allclose(own["x"][free], want["free_x"][free]) and np.allclose(own["mz"][want["route"] >= 0], 153.0)
    # Slices of a few seconds, and batches that end anywhere, change nothing.
    held_before = live.SLICE
    try:
        live.SLICE = 3
        sliced = live.estimate(df, "run", [LINE], s, rules=rules, samples=64, opening=64, held=700).orderBy("run", "stamp").toPandas()
    finally:
        live.SLICE = held_before
    assert sliced.equals(got)
    assert live.estimate(df.limit(0), "run", [LINE], s).count() == 0
    odd = df.limit(3).withColumn("stamp", F.lit(None).cast("long"))
    assert live.estimate(odd, "run", [LINE], s).count() == 0


def test_the_output_point_and_the_lever_arm(spark):
    bent = Route(np.array([[30 * np.cos(a), 30 * np.sin(a), 10.0] for a in np.linspace(0, 3, 400)]))
    s = Settings(output_x=2.0, output_z=1.0, compensate_lever_arm=True)
    names = ["route", "route_s", "velocity", "distance", "flags", *(f"{n}_{c}" for n in ("aside", "free", "course") for c in "xyz")]
    told = [(0, at, 8.0, at, 0, *[0.0] * 9) for at in (30.0, 50.0)] + [(-1, 0.0, 5.0, 7.0, 8, *[0.0] * 9), (0, 40.0, 6.0, 40.0, 256, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 0.6, 0.8, 0.0)]
    kinds = ", ".join(f"{n} {'long' if n in ('route', 'flags') else 'double'}" for n in names)
    df = spark.createDataFrame(told, kinds)
    got = [r.o for r in df.select(live._outputs([bent], s, df).alias("o")).collect()]
    factor = bent.speed_factor(np.array([30.0, 50.0]), s.velocity_x, s.velocity_z)
    assert abs(factor[0] - 1) > 0.01 and np.allclose([got[0].told, got[1].told], 8 * factor)
    # The output point goes faster than the body's pivot, by as much as it is off the arc.
    ends = [bent.antenna(np.array([30.0 + d]), 2.0, 1.0)[0] for d in (-0.05, 0.05)]
    assert np.isclose(np.hypot(got[0].vx, got[0].vy), np.linalg.norm(ends[1] - ends[0]) / 0.1 * 8)
    assert (got[2].x, got[2].y, got[2].vx, got[2].told) == (7.0, 0.0, 5.0, 5.0)
    assert np.allclose((got[3].x, got[3].y, got[3].z, got[3].mx, got[3].my), (1.0, 2.0, 3.0, 1 - 9.873 * 0.6, 2 - 9.873 * 0.8))


@pytest.mark.parametrize("wrong", [{"speed_scale": 1.2}, {"departure": -1.0}, {"bridge_most": float("inf")}])
def test_more_settings_are_refused(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


# Streams


def streamed(spark, folder, told, kind, make, order):
    """make(stream) over ``told`` in micro-batches of a few and of all rows, restarted each time."""
    out = []
    for size in (2, len(told)):
        at = f"{folder}/{size}"
        for k in range(0, len(told), size):
            spark.createDataFrame(told[k : k + size], kind).coalesce(1).write.mode("append").parquet(f"{at}/in")
            state.run_once(make(spark.readStream.schema(kind).parquet(f"{at}/in")), f"{at}/out", f"{at}/checkpoint")
        out.append(rows(spark.read.parquet(f"{at}/out"), *order))
    return out


SECOND = 1_000_000
DAWN = 1000 * SECOND  # rows at or before a watermark are late, and the first watermark is 0


def test_ticks_come_while_a_key_is_silent(spark, tmp_path):
    told = [("a", 0), ("b", 0), ("a", SECOND), ("a", 6 * SECOND), ("b", 9 * SECOND), ("a", 20 * SECOND)]
    told = [(run, DAWN + t) for run, t in told]
    got = streamed(spark, tmp_path, told, "run string, at long", lambda s: timers.fallback_ticks(s, ["run"], "at", 2 * SECOND, SECOND, "1 second"), ("run", "tick"))
    mark = DAWN + 19 * SECOND
    want = [("a", DAWN + t * SECOND) for t in (3, 4, 5, *range(8, 20))] + [("b", DAWN + t * SECOND) for t in (*range(2, 9), *range(11, 20))]
    assert got[0] == got[1] == sorted((w for w in want if w[1] <= mark), key=repr)


def test_an_opening_window_closes_without_another_row(spark, tmp_path):
    told = [("a", 1, 0, 5.0), ("a", 2, SECOND, 7.0), ("b", 3, 2 * SECOND, 1.0), ("c", 4, 30 * SECOND, 9.0), ("b", 5, 31 * SECOND, 99.0), ("c", 6, 31 * SECOND, 8.0)]
    told = [(run, k, DAWN + t, v) for run, k, t, v in told]
    got = streamed(spark, tmp_path, told, "run string, id long, at long, value double", lambda s: timers.opening_window(s, ["run"], "at", "value", 5 * SECOND, "1 second"), ("run", "ends", "n", "middle"))
    assert got[0] == got[1] == [("a", DAWN + 5 * SECOND, 2, 6.0), ("b", DAWN + 7 * SECOND, 1, 1.0)]


def test_a_clock_that_goes_back_begins_anew(spark, tmp_path):
    from wayside.operators import windows

    told = [("a", 1, 1, 10, 1.0), ("a", 2, 2, 20, 3.0), ("a", 3, 3, 5, 7.0), ("b", 4, 4, 9, 2.0), ("a", 5, 5, 6, 8.0), ("a", 6, 6, 2, 0.5)]
    fold = state.resetting(windows.ema_fold("value", "header", {"ema": 1e-5}), "header")
    got = streamed(spark, tmp_path, told, "run string, id long, arrival long, header long, value double", lambda s: state.keyed(s, ["run"], fold), ("run", "id", "sub_run"))
    assert got[0] == got[1] == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 5, 1), ("a", 6, 2), ("b", 4, 0)]


def test_a_key_that_never_asks_stays_small(spark, tmp_path):
    kind = "run string, id long, ask boolean, stamp long, arrival long, value double"
    told = [("a", k, False, k, k, float(k)) for k in range(20)] + [("a", 90, True, 18, 90, 0.0), ("a", 91, True, 50, 91, 0.0)]
    sizes = []
    for k in range(0, 20, 4):
        spark.createDataFrame(told[k : k + 4], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        state.run_once(lookup.lookup(stream, ["run"], 100, 100, most=6), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        with state.rocksdb(spark):
            sizes.append(spark.read.format("statestore").option("stateVarName", "slots").load(f"{tmp_path}/checkpoint").count())
    assert sizes == [4] + [6] * 4
    spark.createDataFrame(told[20:], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.run_once(lookup.lookup(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), ["run"], 100, 100, most=6), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "seen", "value") == [(90, 18, 18.0), (91, 19, 19.0)]


def test_the_oldest_samples_go_alike_under_any_split(spark, tmp_path):
    rng, told, t = random.Random(6), [], 0
    for k in range(14):
        t += rng.randrange(1, 4)
        told.append(("a", k, rng.random() < 0.3, t - rng.randrange(12), t, float(k)))
    got = streamed(spark, tmp_path, told, "run string, id long, ask boolean, stamp long, arrival long, value double", lambda s: lookup.lookup(s, ["run"], 9, 5, most=3), ("id", "seen", "value"))
    want, held, newest, asked = [], deque(maxlen=3), -99, -99
    for _, k, ask, stamp, _, value in told:
        if ask and stamp > asked:
            asked, found = stamp, [x for x in held if x[0] <= stamp]
            want.append((k, *(found[-1] if found and stamp - found[-1][0] <= 9 else (None, None))))
        elif not ask and stamp > newest:
            newest = stamp
            held.append((stamp, value))
    assert got[0] == got[1] == sorted(want, key=repr)


def test_no_sample_that_a_question_may_ask_for_goes(spark, tmp_path):
    """A key whose first question is of its first sample, after 3,000 more."""
    kind = "run string, id long, ask boolean, stamp long, arrival long, value double"
    told = [("a", k, False, k, k, float(k)) for k in range(1, 3001)] + [("a", 4000, True, 1, 4000, 0.0), ("a", 4001, True, 2500, 4001, 0.0), ("b", 4002, False, 5, 4002, 7.0)]
    told += [("b", 4003, True, 6, 4003, 0.0)]
    for k, part in enumerate((told[:1500], told[1500:3001], told[3001:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state.run_once(lookup.lookup(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), ["run"], 10, 0), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "seen", "value") == [(4000, 1, 1.0), (4001, 2500, 2500.0), (4003, 5, 7.0)]


def test_every_value_of_an_opening_window_counts(spark, tmp_path):
    """5,000 values, the smaller half first: the newest of them alone have another median."""
    kind = "run string, id long, at long, value double"
    told = [("a", k, DAWN + k, float(k)) for k in range(5000)] + [("b", 5000, DAWN + 6000, 1.0), ("a", 5001, DAWN + 60 * SECOND, 0.0)]
    for part in (told[:2500], told[2500:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        state.run_once(timers.opening_window(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), ["run"], "at", "value", 5 * SECOND, "1 second"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "run", "n", "middle") == [("a", 5000, 2499.5), ("b", 1, 1.0)]


def test_a_match_is_the_median_of_a_runs_pairs():
    """Whatever number of pairs the other runs of a batch have, and however many there is room for."""
    model, rng, n = live.Live([LINE], Settings(), opening=64), np.random.default_rng(4), 40
    held = model.start(n)
    held["pair_count"][:] = rng.integers(3, 71, n)
    held["pair_offset"][:], held["pair_cost"][:], held["pair_strict"][:] = rng.normal(size=held["pair_offset"].shape), rng.random(held["pair_cost"].shape), rng.random((n, 64)) < 0.3
    model._choose(held, np.arange(n), np.ones(n, bool))
    for k in range(n):
        pairs = slice(0, min(held["pair_count"][k], 64))
        strict = held["pair_strict"][k, pairs]
        used = strict if strict.any() else np.ones(len(strict), bool)
        assert held["placed"][k] and held["degraded"][k] == (not strict.any())
        assert held["offset"][k] == np.median(held["pair_offset"][k, 0, pairs][used]) and held["rms"][k] == np.sqrt(np.median(held["pair_cost"][k, 0, pairs][used]))
