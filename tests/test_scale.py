"""What large tables do to plans and tasks: cuts, tiles, joins and states that must stay bounded."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayside.operators import extensions, folds, matching, models
from wayside.plans import trips, worlds
from wayside.streaming import lookup, state, timers

from .test_recordings import dense, segments


def test_a_segment_far_longer_than_a_cell_is_cut_only_around_points(spark, tmp_path):
    lines = [[(-4e9, 0.0, 0.0), (4e9, 0.0, 0.0)], [(0.0, 3.0, 0.0), (9.0, 3.0, 0.0)]]
    points = spark.createDataFrame([(1, 2.0, 1.0, 0.0)], "id long, px double, py double, pz double")
    found = matching.match(points, segments(spark, lines), 4.0, f"file://{tmp_path}", 2).orderBy("rank").collect()
    assert [(r.route, round(r.distance, 6)) for r in found] == [(0, 1.0), (1, 2.0)]


def test_tiles_of_a_cell_give_the_best_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 7)
    rng = random.Random(8)
    lines = [[(rng.uniform(0, 9), rng.uniform(0, 9), 0.0) for _ in range(30)] for _ in range(2)]
    points = [(i, (rng.uniform(0, 9), rng.uniform(0, 9), 0.0), (math.cos(i), math.sin(i), 0.0)) for i in range(40)]
    told = spark.createDataFrame([(i, *p, *h) for i, p, h in points], "id long, px double, py double, pz double, hx double, hy double, hz double")
    found = matching.match(told, segments(spark, lines), 8.0, f"file://{tmp_path}", 5)
    assert sorted((r.id, r["rank"], round(r.cost, 6), round(r.distance, 6)) for r in found.collect()) == dense(points, lines, True, 5, True)

SMALL = "/root/testdata/sf0.001"


def plan(made):
    return made._jdf.queryExecution().executedPlan().toString()


def test_ticks_and_fixes_made_by_explode_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(trips.replay(spark, SMALL))
    assert "BroadcastHashJoin" not in plan(trips.replay_arms(spark, SMALL))


def test_ticks_of_worlds_are_not_broadcast(spark):
    for made in (worlds.judged(spark, SMALL), worlds.feature_rows(spark, SMALL)):
        # Runs with their block's speed are as few as suppliers; ticks are 601 times as many.
        joined = [line for line in plan(made).splitlines() if "BroadcastHashJoin" in line]
        assert all("block" in line for line in joined)


def test_a_task_holds_the_states_of_one_group_of_runs(spark, monkeypatch):
    """Running sums of 300 runs, and how many states were held at once."""
    monkeypatch.setattr(folds, "LANES", 20)

    def start(n):
        return {"sum": np.zeros(n), "held": np.zeros(n, np.int64)}

    def step(state, x):
        state["sum"] += x["v"]
        return {"total": state["sum"].copy(), "lanes": np.full(len(x["v"]), len(x["v"]))}

    rows = spark.range(6000).select((F.col("id") % 300).alias("run"), F.floor(F.col("id") / 300).alias("at"), (F.col("id") % 7).cast("double").alias("v"))
    got = folds.along_slices(rows, "run", ["at"], folds.Fold(start, step, ("v",), {"total": "double", "lanes": "long"}), 3, 1000).toPandas()
    assert got["lanes"].max() <= 60 and got["lanes"].max() > 5
    want = got.sort_values(["run", "at"]).groupby("run")["v"].cumsum()
    assert (got.sort_values(["run", "at"])["total"] == want).all() and len(got) == 6000


def test_a_bucket_of_a_stream_loads_few_states_at_once(monkeypatch):
    monkeypatch.setattr(state, "LANES", 3, raising=False)
    most = []

    def step(s, x):
        most.append(len(x["v"]))
        s["sum"] += x["v"]
        return {"total": s["sum"].copy()}

    class Kept(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    lanes = state.LanesFold(folds.Fold(lambda n: {"sum": np.zeros(n)}, step, ("v",), {"total": "double"}), "run", "long", ["at"])
    lanes.states = Kept()
    rows = pd.DataFrame({"run": [k % 10 for k in range(100)], "at": range(100), "v": [float(k % 7) for k in range(100)]})
    got = pd.concat([b for half in (rows[:45], rows[45:]) for b in lanes.handleInputRows((0,), iter([half]), None)]).sort_values("at")
    assert max(most) == 3 and np.array_equal(got["total"], rows.groupby("run")["v"].cumsum())


def test_even_steps_sort_a_run_once_and_shuffle_no_step(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 2.0, 4.0)], "run long, at double, x double")
    lines = plan(extensions.even_steps(df, "run", "at", ["x"], 0.5)).splitlines()
    assert not [line for line in lines if "Union" in line or "Join" in line]
    assert sum("Generate" in line for line in lines) == 1 and sum("Window [" in line for line in lines) <= 2
    assert max(k for k, line in enumerate(lines) if "Generate" in line) < min(k for k, line in enumerate(lines) if "Exchange" in line)


class Value:
    """A value of a state store, or its timers."""

    def __init__(self):
        self.held, self.timers = None, set()

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, row):
        self.held = row

    def getValueState(self, *_):
        return self

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


def test_keys_of_a_page_go_forward_in_one_call():
    steps = []

    def step(s, x):
        steps.append(len(x["v"]))
        s["sum"] += x["v"][:, None] * [1, 2]
        return {"total": s["sum"][:, 1].copy()}

    fold = folds.Fold(lambda n: {"sum": np.zeros((n, 2))}, step, ("v",), {"total": "double"})
    rows = pd.DataFrame({"run": [(1 << 60) + k % 50 for k in range(200)], "channel": [None] * 200, "at": range(200), "v": [float(k % 7) for k in range(200)]})
    page, got = state.KeyedFold(fold, ["run", "channel"], ["at"]), []
    page.init(Value())
    for part in (rows[:120], rows[120:]):
        got += list(page.handleInputRows((0,), iter([part]), None))
    got = pd.concat(got).sort_values("at")
    assert len(steps) == 5 and max(steps) == 50
    assert np.array_equal(got["run"], rows["run"]) and np.array_equal(got["total"], 2 * rows.groupby("run")["v"].cumsum())


def test_a_page_of_ticks_and_windows_keeps_one_timer():
    rows = pd.DataFrame({"run": [k % 50 for k in range(100)], "id": range(100), "at": [1_000_000 * (k % 50 + 20 * (k // 50)) for k in range(100)], "value": [float(k) for k in range(100)]})
    for processor in (timers.FallbackTicks(["run"], "at", 5_000_000, 2_000_000), timers.OpeningWindow(["run"], "at", "value", 60_000_000, 9)):
        store = Value()
        processor.init(store)
        got = list(processor.handleInputRows((0,), iter([rows]), None))
        assert len(store.timers) == 1
        if got:  # from 5 s on every 2 s, before the next row at 20 s
            want = sorted((r, 1_000_000 * (r + t)) for r in range(50) for t in range(5, 20, 2))
            assert sorted(zip(got[0]["run"], got[0]["tick"], strict=True)) == want


def test_questions_of_a_page_are_answered_by_their_own_key():
    rng = random.Random(4)
    told = [{"run": f"r{rng.randrange(9)}", "id": k, "ask": rng.random() < 0.4, "stamp": k * 3 + rng.randrange(12), "arrival": k, "value": float(k)} for k in range(400)]
    page = lookup.Lookup(["run"], 20, 4)
    page.init(Value())
    frame, got = pd.DataFrame(told), {}
    for part in (frame[:150], frame[150:170], frame[170:]):
        for made in page.handleInputRows((0,), iter([part]), None):
            got |= {i: None if pd.isna(s) else (s, v) for i, s, v in zip(made["id"], made["seen"], made["value"], strict=True)}
    want, held, newest, asked = {}, {}, {}, {}
    for r in told:
        k = r["run"]
        if not r["ask"]:
            if r["stamp"] > newest.get(k, -1):
                held[k], newest[k] = [*held.get(k, []), (r["stamp"], r["value"])][-4:], r["stamp"]
        elif r["stamp"] > asked.get(k, -1):
            asked[k] = r["stamp"]
            past = [s for s in held.get(k, []) if s[0] <= r["stamp"]]
            want[r["id"]] = past[-1] if past and r["stamp"] - past[-1][0] <= 20 else None
    assert got == want


def test_trees_of_groups_are_those_of_their_rows(spark):
    rng = random.Random(5)
    rows = [(float(a), float(b), 3.0 * a + (a > 9) * b + rng.gauss(0, 2)) for a, b in ((rng.randrange(20), rng.randrange(7)) for _ in range(4000))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    more = {"trees": 5, "rate": 0.3, "depth": 3, "least": 150}
    one = models.node_table(models.fit_trees(df, ["a", "b"], "y", **more))
    groups = models.grouped(df, ["a", "b"], "y")
    assert groups.count() == 140
    model = models.fit_trees_grouped(groups, ["a", "b"], "y", **more)
    two = models.node_table(model)
    exact = ["tree", "node", "feature", "low", "high"]
    assert two[exact].values.tolist() == one[exact].values.tolist() and (two["feature"] >= 0).sum() > 15
    assert np.allclose(two["threshold"], one["threshold"]) and np.allclose(two["value"], one["value"], rtol=1e-9, atol=1e-9)
    # Rows without a label are counted and not learned from.
    odd = df.unionByName(spark.createDataFrame([(1.0, 1.0, None), (1.0, 2.0, math.nan), (30.0, 1.0, None)], df.schema))
    gaps = models.export_gap(model, two, models.grouped(odd, ["a", "b"], "y"), ["a", "b"], ["b"], "n").collect()
    assert sum(r.n for r in gaps) == 4003 and max(r.gap for r in gaps) < 1e-12
    again = models.node_table(models.fit_trees_grouped(models.grouped(odd, ["a", "b"], "y"), ["a", "b"], "y", **more))
    assert np.allclose(again["value"], two["value"])
