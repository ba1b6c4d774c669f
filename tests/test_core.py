"""Rules that the event operators keep, on small hand-written streams."""

import dataclasses
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.functions import route
from wayside.functions.route import join_seam
from wayside.operators import folds, fusion, joins, observer, ordering, windows
from wayside.operators.rescore import rescore
from wayside.plans import registry, streaming  # noqa: F401
from wayside.schema import Settings
from wayside.sources import bags, manifests, runs, texts
from wayside.streaming import lookup, state

MS = 1_000_000


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_record_high_drops_late_and_repeated_headers(spark):
    headers = [100, 300, 200, 300, 400]
    events = spark.createDataFrame([("r", k, k, h * MS) for k, h in enumerate(headers)], "run_id string, id long, arrival long, header long")
    assert rows(ordering.record_high(events, ["run_id"]), "id") == [(0,), (1,), (4,)]


def test_nearest_takes_the_later_of_a_tie_within_an_inclusive_tolerance(spark):
    right = spark.createDataFrame([("r", 100 * MS, 1.0), ("r", 200 * MS, 2.0)], "run_id string, u long, v double")
    left = spark.createDataFrame([("r", 150 * MS), ("r", 250 * MS), ("r", 250 * MS + 1), ("r", 50 * MS), ("r", 50 * MS - 1)], "run_id string, t long")
    found = joins.nearest(left, right, ["run_id"], "t", "u", 50 * MS)
    assert dict(rows(found, "t", "r_v")) == {150 * MS: 2.0, 250 * MS: 2.0, 250 * MS + 1: None, 50 * MS: 1.0, 50 * MS - 1: None}


def test_sync_uses_each_message_once_within_a_strict_slop():
    sync = joins.ApproximateSync(50)
    assert not sync.add(0, 100, 1)
    assert not sync.add(1, 150, 2)  # not less than the slop
    assert sync.add(1, 120, 3) == (1, 3)
    assert sync.add(0, 140, 4) == (4, 2)
    assert not sync.add(1, 141, 5)  # both partners are gone


def test_neighbours_of_a_long_run_are_found_in_one_pass_each_way(spark):
    n = 100_000
    left = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") * 10).alias("t"))
    right = spark.range(n).select(F.lit(1).alias("run_id"), (F.col("id") * 10 + 3).alias("u"), F.col("id").cast("double").alias("v"))
    found = joins.nearest(left, right, ["run_id"], "t", "u", 4)
    assert found.agg(F.count("r_v"), F.count_if(F.col("r_v") * 10 != F.col("t"))).first() == (n, 0)
    at = joins.interpolate(left, right, ["run_id"], "t", "u", "v")
    assert at.where("t > 0").agg(F.max(F.abs(F.col("v_at") - (F.col("t") - 3) / 10))).first()[0] < 1e-6


def test_quantities_are_paired_on_their_own(spark):
    events = spark.createDataFrame([("r", "command", 100, 100, 1), ("r", "velocity", 101, 90, 2), ("r", "position", 102, 95, 3), ("r", "position", 99, 300, 4)], "run_id string, kind string, stamp long, arrival long, id long")
    pairs = joins.publication_syncs(events, "run_id", 10, {"velocity": 5, "position": 50})
    assert rows(pairs, "quantity", "command_id", "id") == [("position", 1, 3), ("velocity", 1, 2)]


def plain_ema(t, x, tau):
    out = [x[0]]
    for k in range(1, len(t)):
        out.append(out[-1] + (1 - math.exp(-(t[k] - t[k - 1]) / tau)) * (x[k] - out[-1]))
    return out


def test_folds_go_on_over_batches_and_runs(spark):
    rng = np.random.default_rng(2)
    runs = {f"r{k}": np.sort(rng.choice(10_000, n, replace=False)) for k, n in enumerate((1, 700, 3, 40))}
    values = {r: rng.random(len(t)) for r, t in runs.items()}
    table = spark.createDataFrame([(r, int(t), float(v)) for r in runs for t, v in zip(runs[r], values[r], strict=True)], "run_id string, t long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = windows.ema(table, "run_id", "x", "t", {"m": 50.0}, 1).collect()
        spaced = windows.greedy_spacing(table, "run_id", "t", 25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r, t in runs.items():
        assert np.allclose([row.m for row in sorted((g for g in got if g.run_id == r), key=lambda g: g.t)], plain_ema(t, values[r], 50.0))
        kept = [t[0]]
        for u in t[1:]:
            if u - kept[-1] >= 25:
                kept.append(u)
        assert sorted(g.t for g in spaced if g.run_id == r) == kept


def test_slip_is_latched_until_it_runs_out_with_a_wheel_missing():
    n = 400
    t = np.arange(n) * 50_000
    x = {c: np.zeros(n) for c in observer.FEATURES} | {"t": t, "usable": np.ones(n, bool)}
    v = 5 + np.clip(np.arange(n) - 100, 0, 40) * 0.15
    x |= {"front": v, "rear": v, "front_ahead": v, "rear_ahead": v}
    x["front_slope_1"] = x["rear_slope_1"] = np.gradient(v, 0.05)
    x["rear_age"] = np.where(np.arange(n) >= 120, 1.0, 0.0)
    rules = observer.Rules(slip_accel=1.5, slip_decel=3.2, longest_slip=4.0)
    got, _ = folds.advance(observer.observer("t", rules=rules), x, np.zeros(1, int), np.array([n]))
    slipping = np.flatnonzero(got["slip"])
    assert slipping[0] in range(99, 104) and (np.diff(slipping) == 1).all()
    assert 3.9 <= (slipping[-1] - slipping[0] + 1) * 0.05 <= 4.1
    assert (got["flags"][slipping] == 3).all() and got["slip_ratio"][slipping[-1]] == got["slip_ratio"][120] > 0


def test_state_of_a_fold_survives_as_a_row():
    fold = observer.observer("t")
    s = fold.start(1)
    s["source"][0, 1], s["v"][0], s["turned"][0] = 2.5, 3.25, True
    again = state.from_row(fold, state.to_row(s))
    assert all((again[k] == v).all() for k, v in s.items()) and state.state_schema(fold).startswith("begun_0 boolean, first_0 long")


def test_corrections_follow_a_shifted_track_and_refuse_the_rest():
    way = route.Route(np.array([[0.0, 0, 0], [100, 0, 0], [2000, 0, 0]]))
    n = 60
    d = np.arange(n) * 10.0 + 20
    x = {"stamp": np.arange(n) * 1_000_000, "arrival": np.arange(n) * 1_000_000 + 200_000, "begin": np.zeros(n, np.int64), "distance": d, "ahead": np.zeros(n), "x": d + 8.0, "y": np.full(n, 2.0)}
    x["y"][10], x["arrival"][11], x["stamp"][12] = 500.0, x["arrival"][11] + 5_000_000, x["stamp"][11]
    got, _ = folds.advance(fusion.corrections_fold(way), x, np.zeros(1, int), np.array([n]))
    assert not got["taken"][[10, 11, 12]].any() and got["taken"].sum() == n - 3
    assert got["rejected"][-1] == 2  # a stamp that does not rise is no fix
    assert abs(got["offset"][-1] - 8) < 0.01 and 0 < got["bias_y"][-1] <= 2


def test_files_of_routes_predictions_and_records_come_back(spark, tmp_path):
    line = spark.createDataFrame([(float(k), float(k), 2.0 * k, 0.5) for k in range(20)], "s double, x double, y double, z double")
    texts.write_route(line, f"{tmp_path}/route")
    assert rows(texts.read_route(spark, f"{tmp_path}/route"), "s", "x", "y", "z") == rows(line, "s", "x", "y", "z")
    (tmp_path / "bad.csv").write_text("s,x,y,z\n1,0,0,0\n1,0,0,0\n")
    with pytest.raises(Exception, match="rises"):
        texts.read_route(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "p.txt").write_text(" ".join(["1700000000000000001", *(f"{k}.5" for k in range(7)), "3", "0", *("0.25",) * 10]) + "\n\n")
    got = texts.read_predictions(spark, str(tmp_path / "p.txt")).first()
    assert (got.stamp, got.velocity, got.flags, got.wz) == (1700000000000000001, 0.5, 3, 0.25)
    features = np.zeros(3, texts.FEATURE_RECORD)
    features["t"], features["x"] = [1, 2, 3], np.arange(78).reshape(3, 26)
    (tmp_path / "f.bin").write_bytes(features.tobytes())
    assert [(r.place, r.t, r.x[25]) for r in texts.read_feature_records(spark, str(tmp_path / "f.bin")).orderBy("place").collect()] == [(0, 1.0, 25.0), (1, 2.0, 51.0), (2, 3.0, 77.0)]
    (tmp_path / "short.bin").write_bytes(features.tobytes()[:-1])
    with pytest.raises(Exception, match="ends within a record"):
        texts.read_feature_records(spark, str(tmp_path / "short.bin")).collect()
    events = np.array([(1, 5, 2.5)], texts.EVENT_RECORD)
    (tmp_path / "e.bin").write_bytes(events.tobytes())
    assert rows(texts.read_event_records(spark, str(tmp_path / "e.bin")), "kind", "stamp", "value") == [(1, 5, 2.5)]
    texts.write_report(spark.createDataFrame([(1, float("nan"))], "a int, b double"), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").collect() == [(1,)]


def test_manifests_guard_what_is_read(spark):
    manifest = spark.createDataFrame([("a", "train", "x"), ("b", "holdout", "y")], "run_id string, part string, sha256 string")
    data = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "q")], "run_id string, sha256 string")
    assert rows(manifests.of_part(data, manifest, "train"), "run_id") == [("a",)]
    assert rows(manifests.strangers(data, manifest), "run_id") == [("b",), ("c",)]
    assert {r.name: r.rows for r in manifests.provenance({"one": data, "two": manifest}).collect()} == {"one": 3, "two": 2}


def test_cached_runs_are_read_without_the_rest(spark, tmp_path):
    every = spark.range(5000).select((F.col("id") % 50).alias("run_id"), F.col("id").alias("arrival"), (F.col("id") * 0.5).alias("value"))
    path = f"{tmp_path}/runs"
    runs.save(every, path, "run_id", "arrival")
    names = ("run_id", "arrival", "value")
    assert rows(runs.load(spark, path, "run_id"), *names) == rows(every, *names)
    few = runs.load(spark, path, "run_id", [7, 9])
    assert rows(few, *names) == rows(every.where("run_id in (7, 9)"), *names)
    assert len(few.inputFiles()) == len(spark.read.parquet(path).inputFiles()) and few._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: []") == 0
    assert runs.load(spark, path, "run_id", []).count() == 0
    assert rows(runs.load_like(spark, path, "run_id", spark.createDataFrame([(7,), (7,), (99,)], "run_id long")), *names) == rows(every.where("run_id = 7"), *names)
    with pytest.raises(Exception, match="(?i)exists"):
        runs.save(every, path, "run_id", "arrival")


def test_saved_predictions_are_scored_again_but_not_over_a_report(spark, tmp_path):
    saved = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("b", 3, 1.0)], "run_id string, id long, prediction double")
    truth = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, truth double")
    rescore(saved, truth, ["id"], ["run_id"], f"{tmp_path}/out")
    report = {r.run_id: r for r in spark.read.json(f"{tmp_path}/out/report").collect()}
    assert (report["a"].n, report["a"].max_abs, report["a"].unscored) == (2, 3.0, 0)
    assert (report["b"].n, report["b"].unscored) == (None, 1)
    named = {r.name: r.sha256 for r in spark.read.json(f"{tmp_path}/out/provenance").collect()}
    assert named == {"saved": manifests.fingerprint(saved).first().sha256, "reference": manifests.fingerprint(truth).first().sha256}
    with pytest.raises(Exception, match="(?i)exists"):
        rescore(saved, truth, ["id"], ["run_id"], f"{tmp_path}/out")


def test_path_graphs_come_back_through_their_transform(spark, tmp_path):
    (tmp_path / "graph.json").write_text('{"points": [{"x": 11.0, "y": 20.0, "z": 1.0}, {"x": 10.0, "y": 22.0, "z": 1.5}]}')
    got = texts.read_pathgraph(spark, f"{tmp_path}/graph.json", yaw=np.pi / 2, translation=(10.0, 20.0, 1.0)).orderBy("place").collect()
    assert np.allclose([tuple(r) for r in got], [(0, 0, -1, 0), (1, 2, 0, 0.5)])


def test_a_seam_keeps_both_ends_tangents():
    first, second = np.array([[0.0, 0, 0], [10, 0, 0]]), np.array([[30.0, 10, 0], [30, 20, 0]])
    seam = join_seam(first, second)
    whole = np.vstack([first, seam, second])
    steps = np.diff(whole, axis=0)
    turn = steps[:, :2] / np.linalg.norm(steps[:, :2], axis=1, keepdims=True)
    ends = (turn[1:] * turn[:-1]).sum(axis=1)[[0, -1]]  # a seam bends within itself, not where it meets a line
    assert ends.min() > 0.99
    assert np.linalg.norm(steps[1:-1], axis=1).max() < 2


def test_late_samples_from_the_future_wait_for_their_question(spark, tmp_path):
    """Micro-batches of one row each give what one batch of all gives."""
    # id, ask, stamp, arrival, value: an ask before its sample, a sample ahead, one refused, one that falls back, an old one.
    told = [(1, False, 10, 20, 1.0), (2, True, 15, 21, 0.0), (3, False, 30, 22, 2.0), (4, True, 25, 23, 0.0), (5, True, 31, 24, 0.0), (6, False, 90, 25, 3.0), (7, False, 28, 26, 4.0), (8, True, 29, 27, 0.0), (9, True, 60, 40, 0.0), (10, True, 95, 85, 0.0)]
    kind = "run_id string, id long, ask boolean, stamp long, arrival long, value double"
    want = [(2, 10, 1.0), (4, 10, 1.0), (5, 30, 2.0), (9, None, None), (10, None, None)]
    for size in (1, 3, len(told)):
        folder = f"{tmp_path}/{size}"
        for n, k in enumerate(range(0, len(told), size)):
            spark.createDataFrame([("a", *r) for r in told[k : k + size]], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(kind).parquet(f"{folder}/in")
            state.run_once(lookup.lookup(stream, ["run_id"], 20, 20), f"{folder}/out", f"{folder}/checkpoint")
        got = spark.read.parquet(f"{folder}/out").orderBy("id").select("id", "seen", "value").collect()
        assert [tuple(r) for r in got] == want, size


def test_sync_prefers_the_nearest_then_the_earliest():
    sync = joins.ApproximateSync(50)
    for stamp, i in ((100, 1), (120, 2), (140, 3)):
        sync.add(0, stamp, i)
    assert sync.add(1, 130, 9) == (2, 9)
    assert sync.add(1, 131, 8) == (3, 8)


def test_sync_forgets_the_smallest_stamp_when_full():
    sync = joins.ApproximateSync(50, 2)
    for stamp, i in ((1000, 1), (2000, 2), (3000, 3)):
        sync.add(0, stamp, i)
    assert not sync.add(1, 1000, 8)
    assert sync.add(1, 2001, 9) == (2, 9)


@pytest.mark.parametrize("wrong", [{"max_speed": 0.0}, {"phase_gain": 1.5}, {"future_tolerance": -1.0}, {"residual_gate": 31.0}, {"origin_lat": 91.0}, {"freshness": float("nan")}, {"antenna_front": -20.0}])
def test_settings_that_make_no_sense_are_refused(wrong):
    with pytest.raises(ValueError):
        dataclasses.replace(Settings(), **wrong)


def cdr(stamp, frame, kind, *values):
    name = frame.encode() + b"\0"
    data = struct.pack("<iII", stamp // 10**9, stamp % 10**9, len(name)) + name
    for code, v in zip(kind, values, strict=True):
        size = struct.calcsize("<" + code)
        data += b"\0" * (-len(data) % size) + struct.pack("<" + code, v)
    return b"\x00\x01\x00\x00" + data


@pytest.mark.parametrize("frame", ["a", "ab", "abc", "abcd"])
def test_messages_decode_at_any_frame_length(frame):
    assert bags.decode(cdr(5 * 10**9 + 7, frame, "d", 18.5), "wheel") == (5 * 10**9 + 7, frame, "", [18.5])
    assert bags.decode(cdr(1, frame, "b", -3), "command") == (1, frame, "", [-3.0])


@pytest.mark.parametrize("data", [b"", b"\x01\x00\x00\x00", cdr(1, "f", "d", 1.0)[:-1], b"\x00\x01\x00\x00" + struct.pack("<iII", 1, 10**9, 2) + b"f\0", b"\x00\x01\x00\x00" + struct.pack("<iII", 1, 1, 0)])
def test_damaged_messages_are_told_apart(data):
    with pytest.raises(bags.Damaged):
        bags.decode(data, "wheel")


def test_recordings_are_read_file_by_file(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        db = sqlite3.connect(tmp_path / run / "x.db3")
        db.execute("CREATE TABLE topics (id INTEGER, name TEXT, type TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(1, "/front", "V"), (2, "/other", "O")])
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(1, 1, 20, cdr(10, "f", "d", 18.0)), (2, 1, 30, b"bad"), (3, 2, 40, b"")])
        db.commit()
        db.close()
    messages = bags.read_bags(spark, str(tmp_path))
    found = bags.decoded(messages, {"/front": "wheel"})
    assert rows(found, "run_id", "id", "arrival", "header", "data", "error") == [(r, *x) for r in ("r1", "r2") for x in ((1, 20, 10, [18.0], None), (2, 30, None, None, "encapsulation"))]
    assert rows(bags.unknown_topics(messages, {"/front": "wheel"}), "topic", "n") == [("/other", 2)]


def test_event_lines_come_back_and_malformed_ones_do_not(spark):
    lines = spark.createDataFrame([("F 1700000000000000001 2 0.1",), ("C 3 4 -7",), ("M 5 6 55.8 37.4 170.25 0",), ("T 7 8",), ("F 1 2",), ("Z 1 2 3",), ("",)], "value string")
    events = texts.read_events(lines)
    assert events.count() == 4
    again = texts.read_events(texts.event_lines(events))
    assert rows(again, *events.columns) == rows(events, *events.columns)
    assert events.where("kind = 'F'").first().stamp == 1700000000000000001


def test_fingerprints_ignore_order_and_see_changes(spark):
    one = spark.range(100).withColumnRenamed("id", "a")
    of = lambda df: manifests.fingerprint(df).first().sha256
    assert of(one) == of(one.repartition(7).orderBy("a", ascending=False))
    assert of(one) != of(one.where("a <> 5"))


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).parent.parent / "wayside"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


@pytest.mark.parametrize("name", ["stream_record_high", "stream_ema", "stream_lookup", "stream_tumbling", "stream_sliding", "stream_sessions"])
def test_streams_do_not_depend_on_how_the_table_is_stored(spark, tmp_path, name):
    small = "/root/testdata/sf0.001"
    want = registry.QUERIES[name](spark, small)
    want, columns = rows(want, *want.columns), want.columns
    assert want
    spark.read.parquet(f"{small}/events.parquet").repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    changed = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # 20 files of the stream, too
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        assert rows(registry.QUERIES[name](spark, str(tmp_path)), *columns) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_value_that_is_not_known_is_not_carried_forward(spark):
    from wayside.operators import windows

    df = spark.createDataFrame([(1, 2.0, 0.1, 1.0), (2, None, 0.1, 1.0), (3, 2.0, None, 1.0), (4, 2.0, 0.1, None), (5, 1.0, 9.0, -9.0)], "id long, v double, a double, s double")
    got = df.select("id", windows.extrapolate(F.col("v"), F.col("a"), F.col("s"), 0.3).alias("x"))
    assert rows(got, "id", "x") == [(1, 2.1), (2, None), (3, None), (4, None), (5, 0.0)]
