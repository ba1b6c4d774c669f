"""Recordings as a growing stream, and the sink that commits by epoch; matching, courses and fits against plain loops."""

import math
import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayside.operators import matching, models, windows
from wayside.sources import recordings


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def grow(folder, run, messages):
    """Appends (topic, arrival, payload) to a run's recording."""
    os.makedirs(f"{folder}/{run}", exist_ok=True)
    db = sqlite3.connect(f"{folder}/{run}/x.db3")
    db.execute("CREATE TABLE IF NOT EXISTS topics (id INTEGER PRIMARY KEY, name TEXT UNIQUE, type TEXT)")
    db.execute("CREATE TABLE IF NOT EXISTS messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    for topic, arrival, payload in messages:
        db.execute("INSERT OR IGNORE INTO topics (name, type) VALUES (?, 'T')", (topic,))
        db.execute("INSERT INTO messages (topic_id, timestamp, data) SELECT id, ?, ? FROM topics WHERE name = ?", (arrival, payload, topic))
    db.commit()
    db.close()


def test_a_growing_recording_comes_out_once(spark, tmp_path):
    source, sink, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    told = {"r1": [("/a", k, bytes([k])) for k in range(7)] + [("/b", 50, b"b")], "r2": [("/a", 3, b"x")]}
    for run, messages in told.items():
        grow(source, run, messages)
    stream = recordings.read_stream(spark, source)

    def seen():
        return rows(recordings.committed(spark, sink, stream.schema), "run_id", "id", "topic", "arrival", "payload")

    def want():
        return sorted(((run, k + 1, t, a, bytearray(p)) for run, m in told.items() for k, (t, a, p) in enumerate(m)), key=repr)

    recordings.write_stream(stream, sink, checkpoint)
    assert seen() == want()
    recordings.write_stream(recordings.read_stream(spark, source), sink, checkpoint)  # nothing new
    assert seen() == want()
    for run, more in (("r1", [("/b", 60, b"c"), ("/c", 61, b"")]), ("r3", [("/a", 1, b"late file")])):
        grow(source, run, more)
        told[run] = told.get(run, []) + more
    recordings.write_stream(recordings.read_stream(spark, source), sink, checkpoint)
    assert seen() == want()
    # Killed after the sink's commit and before the stream's own: the epoch is planned again and not written again.
    commits = sorted((int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()))
    for name in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    recordings.write_stream(recordings.read_stream(spark, source), sink, checkpoint)
    assert seen() == want()
    # Killed before the sink's commit: files of no epoch are not read.
    with open(f"{sink}/rows/stray.parquet", "wb") as f:
        f.write(b"half a file")
    assert seen() == want()


def test_the_last_messages_of_each_topic(spark, tmp_path):
    told = [("r", "/a" if k % 3 else "/b", "T", k % 11, bytes([k])) for k in range(60)]
    df = spark.createDataFrame(told, "run_id string, topic string, type string, arrival long, payload binary")
    assert rows(recordings.record(df, f"{tmp_path}/in"), "run_id", "n") == [("r", 60)]
    stream = recordings.read_stream(spark, f"{tmp_path}/in")
    recordings.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    kept = recordings.latest(recordings.committed(spark, f"{tmp_path}/out", stream.schema), depth=5)
    ordered = sorted(told, key=lambda r: (r[3], r[1], r[4]))
    want = [(t, k + 1, a) for k, (_, t, _, a, _) in enumerate(ordered)]
    assert rows(kept, "topic", "id", "arrival") == sorted(w for t in ("/a", "/b") for w in [x for x in want if x[0] == t][-5:])


def test_many_recordings_share_tasks_and_files_of_the_sink(spark, tmp_path):
    runs = 3 * 96
    df = spark.range(runs * 2).selectExpr(f"cast(id % {runs} as string) as run_id", "'/a' as topic", "'T' as type", "id as arrival", "cast(cast(id as string) as binary) as payload")
    recordings.record(df, f"{tmp_path}/in").collect()
    reader = recordings._Reader(f"{tmp_path}/in")
    offset = reader.latestOffset()
    assert len(offset) == runs and len(reader.partitions({}, offset)) <= 96 and reader.partitions(offset, offset) == []
    stream = recordings.read_stream(spark, f"{tmp_path}/in")
    recordings.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert len(os.listdir(f"{tmp_path}/out/rows")) <= 96
    made = recordings.committed(spark, f"{tmp_path}/out", stream.schema)
    assert rows(made, "run_id", "id", "arrival") == sorted(((str(k % runs), k // runs + 1, k) for k in range(2 * runs)), key=repr)


def segments(spark, lines):
    vertices = [(r, k, *map(float, p)) for r, line in enumerate(lines) for k, p in enumerate(line)]
    return matching.segments_of(spark.createDataFrame(vertices, "route int, k int, x double, y double, z double"))


def dense(points, lines, heading, best, flat):
    """The best matches of each point by looking at all segments."""
    out = []
    axes = 2 if flat else 3
    for i, p, h in points:
        found = []
        for r, line in enumerate(lines):
            s = 0.0
            for k, (a, b) in enumerate(zip(line, line[1:])):
                a, b = np.array(a, float), np.array(b, float)
                length = np.linalg.norm(b - a)
                if length <= 1e-6:
                    continue
                v = (b - a)[:axes]
                u = np.clip((np.array(p)[:axes] - a[:axes]) @ v / max(v @ v, 1e-12), 0, 1)
                apart = ((a[:axes] + u * v - np.array(p)[:axes]) ** 2).sum()
                found.append((apart + (25 * (1 - np.array(h) @ (b - a) / length) ** 2 if heading else 0.0), r, k, s + u * length, math.sqrt(apart)))
                s += length
        out += [(i, n + 1, round(c, 6), round(d, 6)) for n, (c, r, k, s, d) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("heading", "flat", "best"), [(False, True, 8), (True, True, 3), (False, False, 1)])
def test_matches_through_a_grid_are_those_of_all_segments(spark, tmp_path, heading, flat, best):
    rng = random.Random(5)
    lines = [[(x := rng.uniform(-200, 200), y := rng.uniform(-200, 200), 0.0)] + [(x := x + rng.gauss(0, 12), y := y + rng.gauss(0, 12), rng.gauss(0, 3)) for _ in range(40)] for _ in range(4)]
    lines.append([(0, 0, 0), (0, 0, 0), (900, 900, 5)])  # a spot without length, and a segment over many cells
    points = []
    for i in range(60):
        a = rng.uniform(0, 7)
        points.append((i, (rng.uniform(-300, 300), rng.uniform(-300, 300), rng.gauss(0, 3)), (math.cos(a), math.sin(a), 0.0)))
    points.append((99, (5000.0, -4000.0, 0.0), (1.0, 0.0, 0.0)))
    told = [(i, *p, *(h if heading else ())) for i, p, h in points] + [(100, None, 1.0, 1.0, *((1.0, 0.0, 0.0) if heading else ())), (101, float("nan"), 1.0, 1.0, *((1.0, 0.0, 0.0) if heading else ()))]
    names = "id long, px double, py double, pz double" + ", hx double, hy double, hz double" * heading
    found = matching.match(spark.createDataFrame(told, names), segments(spark, lines), 15.0, f"file://{tmp_path}", best, flat)
    got = sorted((r.id, r["rank"], round(r.cost, 6), round(r.distance, 6)) for r in found.collect())
    assert got == dense(points, lines, heading, best, flat)


def test_matches_without_segments_or_points(spark, tmp_path):
    some = segments(spark, [[(0, 0, 0), (1, 1, 1)]])
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, px double, py double, pz double")
    assert matching.match(points, some.limit(0), 5.0, f"file://{tmp_path}").count() == 0
    assert matching.match(points.limit(0), some, 5.0, f"file://{tmp_path}").count() == 0
    assert matching.match(points, some, 5.0, f"file://{tmp_path}").count() == 1  # fewer segments than are wanted


def test_courses_of_windows(spark):
    rng = random.Random(3)
    told, d = [], 0.0
    for k in range(120):
        d += rng.uniform(0, 3)
        bent = 0.0 if k < 60 else 0.05 * (d - 90) ** 2 / 10
        told.append(("r" if k % 4 else "q", k * 400_000 + rng.randrange(1000), d, 0.8 * d + rng.gauss(0, 0.1), 0.6 * d + bent))
    df = spark.createDataFrame(told, "run string, t long, d double, x double, y double")
    got = {(r.run, r.t): r for r in windows.course(df, ["run"], "d", "x", "y", "t", 12, 6_000_000).collect()}
    for run in "rq":
        own = [x for x in told if x[0] == run]
        for k, (_, t, _, _, _) in enumerate(own):
            w = np.array([x[2:] for x in own[max(0, k - 11) : k + 1] if x[1] >= t - 6_000_000])
            r, c = got[run, t], w - w.mean(axis=0)
            assert r.course_n == len(w)
            if (c[:, 0] ** 2).sum() <= 1e-12:
                assert r.gain is None and not r.sound
                continue
            g = (c[:, :1] * c[:, 1:]).sum(axis=0) / (c[:, 0] ** 2).sum()
            miss = np.hypot(*(c[:, 1:] - c[:, :1] * g).T)
            assert np.allclose([r.gain_x, r.gain_y, r.rms, r.worst], [*g, np.sqrt((miss**2).mean()), miss.max()], atol=1e-7)
            assert r.sound == (len(w) >= 5 and w[-1, 0] - w[0, 0] >= 5 and 0.8 <= np.hypot(*g) <= 1.2 and miss.max() <= 1 and np.sqrt((miss**2).mean()) <= 0.5)
    assert {r.sound for r in got.values()} == {True, False}


@pytest.mark.parametrize("turn", [0.0, 2.5, -3.1])
def test_rigid_fits_leave_out_wrong_places(spark, turn):
    rng = random.Random(9)
    told = []
    for k in range(400):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        u, v = x * math.cos(turn) - y * math.sin(turn) + 4, x * math.sin(turn) + y * math.cos(turn) - 9
        told.append((k, x, y, *((rng.uniform(-90, 90), rng.uniform(-90, 90)) if k % 10 < 3 else (u + rng.gauss(0, 0.01), v + rng.gauss(0, 0.01)))))
    told.append((999, None, 1.0, 1.0, 1.0))
    found, shift, limit = models.rigid_fit(spark.createDataFrame(told, "id long, x double, y double, u double, v double"), ("x", "y"), ("u", "v"))
    assert abs(math.remainder(found - turn, math.tau)) < 1e-4 and np.allclose(shift, (4, -9), atol=5e-3) and limit < 0.1


def test_quantiles_are_exact_though_no_task_holds_all_values(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7).alias("a"), F.when(F.col("id") % 2 == 0, F.xxhash64("id") / 1e15).alias("b"), F.lit(None).cast("double").alias("c"))
    for share in (0.0, 0.05, 0.5, 0.65, 1.0):
        want = list(df.agg(*(F.percentile(c, share) for c in "abc")).first())
        got = models.quantiles(df, [F.col(c) for c in "abc"], share)
        assert got[2] is None and got[:2] == pytest.approx(want[:2], rel=1e-15)
    assert models.quantiles(spark.createDataFrame([(1.0,)], "a double"), [F.col("a")], 0.65) == [1.0]
