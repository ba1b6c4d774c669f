"""Erring wheels, ladders of models and lengthened lines against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayside.operators import extensions, ladder, models, observer
from wayside.plans import perturbations, registry, trips, worlds
from wayside.schema import PREDICTION, Settings

SMALL = "/root/testdata/sf0.001"


def test_worlds_are_followed_or_refused_as_their_wheels_allow(spark):
    seen = {r.world: r for r in registry.QUERIES["wheel_scenarios"](spark, SMALL).collect()}
    assert set(seen) == set(worlds.WORLDS)
    assert all(r.n % 180 == 0 and math.isfinite(r.rmse) for r in seen.values())
    for name in worlds.HONEST:
        assert seen[name].max_abs < 1e-5, name
    for name in ("front_step", "both_step"):  # a step of 3 m/s within a twentieth of a second is refused
        assert seen[name].max_abs < 1e-5, name
    assert seen["both_smooth_sine"].max_abs == pytest.approx(1.5, abs=1e-5)  # both wheels lie smoothly: nothing tells
    one, two = (seen[n].max_abs for n in ("ambiguous_constant_with_slip", "ambiguous_real_accel_with_slip"))
    assert max(one, two) >= 0.75


def huber(x, y, rounds=30, scale=0.5, ridge=1e-4):
    beta = np.zeros(x.shape[1])
    for turn in range(rounds):
        w = np.minimum(1, scale / np.maximum(np.abs(y - x @ beta), 1e-9)) if turn else np.ones(len(y))
        beta = np.linalg.solve((x * w[:, None]).T @ x / w.sum() + ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y / w.sum())
    return beta


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 900
    a, b = rng.uniform(1, 9, n), rng.normal(size=n)
    truth = 1.1 * a + 0.5 * b + np.where(b > 0.5, 1.0, 0.0) + np.where(rng.random(n) < 0.05, 30, 0)
    rows = pd.DataFrame({"run": [f"r{i % 12}" for i in range(n)], "a": a, "b": b, "truth": truth, "extra": 1})
    return rows, spark.createDataFrame(rows)


def test_robust_fits_of_all_sets_at_once_equal_one_at_a_time(table):
    rows, df = table
    dealt = df.withColumn("fold", ladder.fold_of("run", 3))
    fold = dealt.select("fold").toPandas()["fold"].to_numpy()
    out = [frozenset(), frozenset({0}), frozenset({1, 2}), frozenset({0, 1, 2})]
    found = ladder.robust_fits(dealt, ["a", "b"], "truth", "fold", out)
    for s in out[:3]:
        keep = ~np.isin(fold, list(s))
        assert keep.sum() > 50
        assert np.allclose(found[s], huber(rows[["a", "b"]].to_numpy()[keep], rows["truth"].to_numpy()[keep]), atol=1e-7)
    assert not found[out[3]].any()


def test_a_row_is_judged_by_what_other_folds_taught(spark, table):
    rows, df = table
    climbed = lambda t: ladder.climb(t, "run", "truth", "a", "a", ["a", "b"], ["a", "b"], trees=3, depth=3, least=10)
    kept = climbed(df).persist()
    made = kept.toPandas()
    assert len(made) == len(rows) and made["extra"].eq(1).all()
    assert made.groupby("run")["fold"].nunique().eq(1).all()
    # Other labels in one fold change the other folds' predictions only.
    poisoned = climbed(df.withColumn("truth", F.when(ladder.fold_of("run", 3) == 0, F.col("truth") * 3).otherwise(F.col("truth")))).toPandas()
    both = made.merge(poisoned, on=["run", "a", "b"])
    assert len(both) == len(rows)
    for c in ("robust", "residual_squared", "residual_absolute", "residual_robust"):
        same = np.isclose(both[f"{c}_x"], both[f"{c}_y"], rtol=0, atol=1e-9)
        assert same[both["fold_x"] == 0].all(), c
        assert not same[both["fold_x"] != 0].all(), c
    for base, c, most in (("ahead", "residual_squared", 1.5), ("ahead", "residual_absolute", 1.5), ("robust", "residual_robust", 3.0)):
        assert (made[c] >= 0).all() and (np.abs(made[c] - made[base]) <= most + 1e-9).all()
    scored = {r.candidate: r for r in ladder.choose(ladder.scores(kept, "run", "truth", ladder.CANDIDATES)).collect()}
    for c in ladder.CANDIDATES:
        e = made[c] - made["truth"]
        assert scored[c].n == len(made) and scored[c].runs == 12
        assert scored[c].rmse == pytest.approx(math.sqrt((e**2).mean())) and scored[c].mae == pytest.approx(e.abs().mean()) and scored[c].bias == pytest.approx(e.mean())
        assert scored[c].macro_rmse == pytest.approx((e**2).groupby(made["run"]).mean().pow(0.5).mean())
    assert sum(r.chosen for r in scored.values()) == 1


def test_rows_that_say_nothing_are_kept_without_a_prediction(spark):
    rows = spark.createDataFrame([(None, 1.0, 1.0, 2.0), ("a", None, 1.0, 2.0), ("b", 2.0, float("nan"), 2.0), ("c", 2.0, 1.0, None)], "run string, a double, b double, truth double")
    made = {r.run: r for r in ladder.climb(rows, "run", "truth", "a", "a", ["a"], ["a", "b"], trees=1, depth=1, least=1).collect()}
    assert set(made) == {None, "a", "b", "c"}
    assert made["a"].hold is None and made["a"].residual_squared is None
    empty = ladder.climb(rows.limit(0), "run", "truth", "a", "a", ["a"], ["a", "b"])
    assert empty.count() == 0
    assert ladder.scores(empty, "run", "truth", ladder.CANDIDATES).count() == 0
    with pytest.raises(ValueError):
        ladder.climb(rows, "run", "truth", "a", "a", ["a"], ["a"], folds=2)


def test_trees_learn_by_either_loss(table):
    _, df = table
    kinds = {loss: models.fit_trees(df, ["a", "b"], "truth", trees=2, depth=2, least=5, loss=loss) for loss in ("squared", "absolute")}
    assert kinds["absolute"].getLossType() == "absolute" and kinds["squared"].getLossType() == "squared"


def plain_side(at, xy, begin, end, join, side, step=1.0):
    near = at < begin + 10 * step if side == "before" else at > end - 10 * step
    if near.sum() < 5:
        return np.empty((0, 3))
    low, high = (max(at[near][0], 0.0), begin) if side == "before" else (end + step, at[near][-1])
    grid = np.arange(low, high, step)
    if len(grid) < 2:
        return np.empty((0, 3))
    out = np.stack([np.convolve(np.pad(np.interp(grid, at[near], xy[near, j]), 2, mode="edge"), np.full(5, 0.2), mode="valid") for j in (0, 1)], axis=1)
    m = min(25, len(out))
    if side == "before":
        out[-m:] += np.linspace(0, 1, m)[:, None] * (join - out[-1])
        keep = slice(0, -1)
    else:
        out[:m] += np.linspace(1, 0, m)[:, None] * (join - out[0])
        keep = slice(1, None)
    return np.column_stack([grid, out])[keep]


def test_ends_are_lengthened_as_a_plain_loop_does(spark):
    rng = np.random.default_rng(5)
    rows, plain = [], {}
    for run, (n, begin, end) in {"long": (160, 60.3, 170.7), "short": (30, 4.2, 20.0), "few": (4, 2.0, 3.0), "none": (40, -5.0, 500.0), "one": (1, 1.0, 1.0)}.items():
        at = np.cumsum(rng.uniform(0.8, 2.2, n))
        xy = np.column_stack([np.cumsum(rng.normal(size=n)), at + rng.normal(size=n)])
        rows += [(run, float(a), float(x), float(y), begin, end) for a, (x, y) in zip(at, xy, strict=True)]
        plain |= {(run, side): plain_side(at, xy, begin, end, np.array(join), side) for side, join in (("before", (1.0, 2.0)), ("after", (3.0, 4.0)))}
    rows += [("long", None, 1.0, 1.0, 60.3, 170.7), ("long", 5.0, None, 1.0, 60.3, 170.7), ("long", 5.5, float("nan"), 1.0, 60.3, 170.7), rows[0]]
    df = spark.createDataFrame(rows, "run string, at double, x double, y double, b double, e double")
    places = df.select("run").distinct()
    made = extensions.lengthened(df, "run", "at", ["x", "y"], F.col("b"), F.col("e"), places, {"x": F.lit(1.0), "y": F.lit(2.0)}, {"x": F.lit(3.0), "y": F.lit(4.0)}).toPandas()
    assert len(made) == sum(len(p) for p in plain.values()) > 100
    for (run, side), p in plain.items():
        found = made[(made["run"] == run) & (made["side"] == side)].sort_values("i")[["at", "x", "y"]].to_numpy()
        assert found.shape == p.shape and np.allclose(found, p, atol=1e-9), (run, side)


def test_even_steps_of_odd_runs(spark):
    rows = [("tie", 0.0, 1.0), ("tie", 0.0, 3.0), ("tie", 2.0, 5.0), ("tie", 2.0, 5.0), ("alone", 1.0, 1.0), ("gone", None, 2.0)]
    df = spark.createDataFrame(rows, "run string, at double, x double").withColumn("i", F.lit(9))
    made = extensions.even_steps(df, "run", "at", ["x"], 0.5).orderBy("i").collect()
    assert [(r.run, r.i, r.at, r.x) for r in made] == [("tie", 0, 0.0, 3.0), ("tie", 1, 0.5, 3.5), ("tie", 2, 1.0, 4.0), ("tie", 3, 1.5, 4.5)]
    beyond = extensions.even_steps(df, "run", "at", ["x"], 1.0, F.lit(-1.0), F.lit(4.0)).orderBy("i").collect()
    assert [r.x for r in beyond] == [3.0, 3.0, 4.0, 5.0, 5.0]
    assert extensions.even_steps(df, "run", "at", ["x"], 1.0, F.lit(4.0), F.lit(4.0)).count() == 0


@pytest.mark.parametrize("wrong", [{"slip_accel": 1.0}, {"slip_accel": 1.0, "slip_decel": 1.0, "longest_slip": 0.0}, {"release_hold": -1.0}, {"slip_decel": float("nan")}])
def test_rules_of_slips_that_make_no_sense_are_refused(wrong):
    with pytest.raises(ValueError):
        observer.Rules(**wrong)


def test_the_first_window_is_bounded():
    assert Settings(init_seconds=30.0).init_seconds == 30.0
    with pytest.raises(ValueError):
        Settings(init_seconds=31.0)


def test_coverage_sees_a_place_that_comes_later_or_not_at_all(spark):
    kinds = {f.name: f.dataType.simpleString() for f in PREDICTION.fields}
    zero = {c: 0 if k == "bigint" else 0.0 for c, k in kinds.items()}
    rows = [(arm, run, *({**zero, "stamp": trips.BEGIN + k, "flags": 8 if k == 0 else 0}.values())) for arm in perturbations.ARMS for run in (1, 2) for k in range(3)]
    made = spark.createDataFrame(rows, "arm string, run_id long, " + ", ".join(f"{c} {k}" for c, k in kinds.items())).cache()
    found = lambda df: {(r.arm, r.invariant): r.violations for r in trips.run_invariants(df).where("violations > 0").collect()}
    one = (F.col("arm") == "bias") & (F.col("run_id") == 2)
    late = one & (F.col("stamp") == trips.BEGIN + 1)
    assert found(made) == {}
    assert found(made.withColumn("flags", F.when(late, F.lit(8)).otherwise(F.col("flags")))) == {("bias", "coverage"): 1, ("bias", "publication"): 1}
    assert found(made.withColumn("x", F.when(late, 9.0).otherwise(F.col("x")))) == {("bias", "publication"): 1}
    assert found(made.where(~one)) == {("bias", "coverage"): 1, ("bias", "publication"): 1}
    assert found(made.withColumn("flags", F.lit(8).cast("long"))) == {}


def test_support_of_odd_rows(spark):
    row = lambda run, place, error=1.0, cosine=1.0: (run, place, error, cosine)
    rows = [row("sound", float(p)) for p in range(20, 30)] + [row("sound", 95.0)] + [row("off", float(p), 3.0) for p in range(20, 30)] + [row("few", 25.0)] + [row("far", float(p)) for p in range(20, 30)]
    rows += [row("null", None), row("null", 25.0, None), row("null", 25.0, 1.0, float("nan")), row("edge", 10.0), row("edge", 40.0)]
    df = spark.createDataFrame(rows, "run string, place double, error double, cosine double")
    made = {r.run: (r.central_count, r.central_rmse, r.local_count, r.status) for r in models.support(df, "run", "place", "error", "cosine", [(0.0, 50.0)], 10.0, (5.0, 5.0), 90.0, 100.0, least=10).collect()}
    assert made == {"sound": (10, 1.0, 1, "eligible"), "off": (10, 3.0, 0, "rejected"), "few": (1, 1.0, 0, "rejected"), "far": (10, 1.0, 0, "no_local_rows"), "null": (0, None, 0, "rejected"), "edge": (0, None, 0, "rejected")}
