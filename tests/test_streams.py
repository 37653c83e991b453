"""Streams whose batches may run again, job states kept by key, and robust lines of groups of any size."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from curvelab.operators import jobs, scale
from curvelab.streaming import arrivals, lifecycle


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "id long, v long"
    rows = lambda a, b: spark.range(a, b).select("id", (F.col("id") * 2).alias("v"))
    sink = arrivals.batch_sink(path, lambda df: df.where("id % 2 = 0"))
    assert arrivals.committed(spark, path, schema).count() == 0
    sink(rows(0, 10), 0)
    sink(rows(10, 20), 1)
    sink(rows(10, 20), 1)  # the same batch once more
    assert sorted(r.id for r in arrivals.committed(spark, path, schema).collect()) == list(range(0, 20, 2))
    rows(20, 30).write.parquet(f"{path}/batch=2")  # one that was written but not committed
    assert arrivals.committed(spark, path, schema).count() == 10
    sink(rows(20, 30), 2)
    assert sorted(r.id for r in arrivals.committed(spark, path).collect()) == list(range(0, 30, 2))


def test_a_stream_that_fails_between_rows_and_commit(spark, tmp_path):
    source, path, state = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    spark.range(100).repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    sink, broken = arrivals.batch_sink(path), []

    def fails_once(df, batch):
        sink(df, batch)
        if batch == 1 and not broken:
            broken.append(batch)
            raise OSError("lost after the batch was written")

    with pytest.raises(Exception, match="lost"):
        arrivals.run_available(stream(), fails_once, state)
    arrivals.run_available(stream(), fails_once, state)
    assert broken and sorted(r.id for r in arrivals.committed(spark, path, "id long").collect()) == list(range(100))


START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(j, s, None if t is None else START + dt.timedelta(seconds=t)) for j, s, t in rows], "job_id string, status string, updated_at timestamp")


def test_newest_states_and_time_outs(spark, tmp_path):
    """Files that arrive one after another; the watermark of one decides over the next."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    first = [("a", "pending", 0), ("a", "processing", 10), ("b", "pending", 5), ("c", "completed", 7), ("d", "pending", 100), (None, "pending", 1), ("e", "pending", None), ("f", "unknown", 3), ("a", "pending", 2)]
    second = [("d", "processing", 380), ("z", "pending", 390)]  # a and b are open for over 300 seconds now, d is not
    third = [("a", "completed", 700), ("z", "completed", 391), ("d", "pending", 150), ("y", "failed", 1000)]
    for rows in (first, second, third):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
        changes = lifecycle.newest(spark.readStream.schema("job_id string, status string, updated_at timestamp").parquet(source), 300)
        arrivals.run_available(changes, arrivals.batch_sink(out), f"file://{tmp_path}/state", "update")
    got = arrivals.committed(spark, out, changes.schema)
    last = {r.job_id: (r.status, int((r.updated_at - START).total_seconds()), r.error_message) for r in jobs.latest(got).collect()}
    assert last == {"a": ("completed", 700, None), "b": ("failed", 305, "timed out"), "c": ("completed", 7, None), "d": ("failed", 680, "timed out"), "y": ("failed", 1000, None), "z": ("completed", 391, None)}
    of_a = sorted((r.updated_at, r.status) for r in got.where("job_id = 'a'").collect())
    assert [s for _, s in of_a] == ["processing", "failed", "completed"]  # it failed by its timer, and came back


def exact(points, residual=5.0):
    """Every pair, as the definition says."""
    p, best = sorted(points), None
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            if p[i][0] == p[j][0]:
                continue
            m = (p[j][1] - p[i][1]) / (p[j][0] - p[i][0])
            near = [q for q in p if abs(q[1] - (m * q[0] + p[i][1] - m * p[i][0])) <= residual]
            n, sx, sy = len(near), sum(q[0] for q in near), sum(q[1] for q in near)
            sxx, sxy, syy = (sum((q[a] - s / n) * (q[b] - t / n) for q in near) for a, s, b, t in ((0, sx, 0, sx), (0, sx, 1, sy), (1, sy, 1, sy)))
            if sxx <= 1e-12:
                continue
            slope, rest = sxy / sxx, max(syy - sxy * sxy / sxx, 0)
            r2 = 1 - rest / syy if syy > 1e-12 else float(rest <= 1e-12)
            key = (n, round(r2, 9), -i, -j)
            if best is None or key > best[0]:
                best = key, (n, round(slope, 6), round(sy / n - slope * sx / n, 4))
    return best and best[1]


def test_robust_lines_of_small_groups_are_exact(spark):
    pick = random.Random(8)
    groups = {g: [(float(pick.randint(0, 40)), float(pick.randint(0, 60))) for _ in range(n)] for g, n in enumerate((1, 2, 3, 5, 12, 30, 50))}
    groups[7], groups[8] = [(1.0, 2.0)] * 5, [(3.0, float(k)) for k in range(9)]  # no two different x
    rows = [(g, x, y) for g, ps in groups.items() for x, y in ps] + [(None, 0.0, 1.0), (None, 2.0, 3.0), (9, None, 1.0), (9, 1.0, None)]
    t = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    for dealt in (4, 50_000):  # groups in many parts, and in one
        got = {r.g: (r.inliers, round(r.slope, 6), round(r.intercept, 4)) for r in scale.fit_robust(t, ["g"], dealt=dealt).collect()}
        assert got == {**{g: exact(ps) for g, ps in groups.items() if exact(ps)}, None: (2, 1.0, 1.0)}
    row = scale.robust_line(F.array_sort(F.collect_list(F.struct("x", "y", F.lit(1.0).alias("w")))))
    within = {r.g: r.f and (r.f.inliers, round(r.f.slope, 6), round(r.f.intercept, 4)) for r in t.where("g < 6").groupBy("g").agg(row.alias("f")).collect()}
    assert within == {g: exact(groups[g]) for g in range(6)}


def test_a_robust_line_of_ten_thousand_points(spark):
    pick = random.Random(9)
    rows = [(1, float(k), 2.0 * k + 7 + pick.uniform(-3, 3) if pick.random() < 0.7 else pick.uniform(0, 20_000)) for k in range(10_000)] + [(2, 5.0, 5.0)] * 9_000 + [(2, 6.0, 7.0), (2, 7.0, 9.0)]
    began = time.time()
    got = {r.g: r for r in scale.fit_robust(spark.createDataFrame(rows, "g int, x double, y double").repartition(4), ["g"], dealt=2_000).collect()}
    assert time.time() - began < 60
    assert abs(got[1].slope - 2) < 0.001 and abs(got[1].intercept - 7) < 1 and got[1].inliers > 6_900
    assert got[2].inliers == 9_002 and got[2].slope == pytest.approx(2)  # a point that is repeated thousands of times hides no other


def test_a_file_for_every_key(spark, tmp_path):
    from curvelab.sources import sinks

    path = f"file://{tmp_path}/out"
    rows = [("a/b ü", k, k / 3, float(k)) for k in range(3)] + [("long", k, float(k), 1.0) for k in range(30_000)] + [(None, 0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "job string, idx int, strain double, stress double").repartition(5)
    for _ in range(2):  # once more replaces the files
        sinks.write_csv_files(points, path, "job", decimals=2)
    names = sorted(f.name for f in (tmp_path / "out").iterdir() if f.name.endswith(".csv"))
    assert names == ["a%2Fb%20%C3%BC.csv", "long.csv"]
    assert (tmp_path / "out" / names[0]).read_bytes().decode() == "Strain (%),Stress (kN/m²)\r\n0.00,0.00\r\n0.33,1.00\r\n0.67,2.00\r\n"
    long = (tmp_path / "out" / "long.csv").read_bytes().decode().split("\r\n")
    assert len(long) == 30_002 and long[1] == "0.00,1.00" and long[30_000] == "29999.00,1.00"
    assert (tmp_path / "out" / "_SUCCESS").read_text().startswith("2 files") and not list((tmp_path / "out" / "_writing").iterdir())
    sinks.write_csv_files(points.limit(0), f"{path}-none", "job")
    assert (tmp_path / "out-none" / "_SUCCESS").read_text() == "0 files, 0 bytes\n"
