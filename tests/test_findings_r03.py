"""What the findings of round 3 asked for."""

import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curvelab.functions import resampling
from curvelab.llm import passages
from curvelab.operators import images, jobs
from curvelab.plans import queries as catalogue
from curvelab.streaming import arrivals, lifecycle


def test_a_long_front_is_weighed_in_parts():
    ramp = np.tile((np.arange(600) // 3).astype(np.uint8), (600, 1))
    lines = (np.arange(600) % 20 < 6)[:, None] & np.ones((1, 600), bool)
    tracemalloc.start()
    got = resampling.painted_over(ramp, lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got.astype(int) - ramp).max() <= 1 and peak < 70e6  # 104 MB with all the surroundings of a front at once


def _batch(sizes):
    data = [None if n is None else bytes(range(n)) * n for n in sizes]
    return pa.record_batch([pa.array(range(len(sizes))), *[pa.array(sizes, pa.int32())] * 2, pa.array([1] * len(sizes), pa.int32()), pa.array(data, pa.binary())], names=["image_id", "height", "width", "channels", "data"])


def test_rows_of_small_images_go_on_together():
    fields = {"n": pa.int32(), "mean": pa.float64()}
    got = list(images.made(_batch([8] * 1000 + [None] + [0, 5]), lambda a: [(a.size, float(a.mean()))] if a.size else [], fields))
    assert len(got) == 1  # one each before
    rows = got[0].to_pylist()
    assert len(rows) == 1002 and rows[0] == {"image_id": 0, "n": 64, "mean": 3.5, "error": None} and rows[-1] == {"image_id": 1002, "n": 25, "mean": 2.0, "error": None}
    assert rows[1000] == {"image_id": 1000, "n": None, "mean": None, "error": "ValueError: the image is not decoded"}
    large = list(images.made(_batch([100] * 9), lambda a: [(bytes(300_000),)], {"data": pa.binary()}))
    assert [b.num_rows for b in large] == [4, 4, 1]


def _states(batches, limit):
    """What each batch says of the jobs, one job after another; the watermark is the newest event of the batches before."""
    state, due, mark, said = {}, {}, 0, []
    for rows in batches:
        rows = [(j, t, s) for j, t, s in rows if t * 1000 > mark]
        met = {j for j, _, _ in rows}
        for j in met:
            new = max([(t, s) for k, t, s in rows if k == j] + ([state[j]] if j in state else []))
            if new != state.get(j):
                said.append((j, new[1], new[0], None))
            state[j] = new
            due[j] = max((new[0] + limit) * 1000, mark + 1) if new[1] in lifecycle.OPEN else None
        for j in set(state) - met:
            if due[j] is not None and due[j] < mark:
                state[j], due[j] = (state[j][0] + limit, "failed"), None
                said.append((j, *state[j][::-1], lifecycle.TIMED_OUT))
        mark = max([mark] + [t * 1000 for _, t, _ in rows])
    return said


def test_jobs_that_share_a_state(spark, tmp_path):
    pick, schema = random.Random(3), "job_id long, status string, updated_at timestamp"
    batches = [[(pick.randrange(60), 100 * k + pick.randrange(160), pick.choice(jobs.STATUSES)) for _ in range(40)] for k in range(1, 7)]
    for k, rows in enumerate(batches):
        folder = f"file://{tmp_path}/in"
        spark.createDataFrame([(j, s, dt.datetime.fromtimestamp(t, dt.UTC)) for j, t, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        changes = lifecycle.newest(spark.readStream.schema(schema).parquet(folder), 150, groups=7)
        arrivals.run_available(changes, arrivals.batch_sink(f"file://{tmp_path}/out"), f"file://{tmp_path}/state", "update")
    got = arrivals.committed(spark, f"file://{tmp_path}/out", changes.schema).select("job_id", "status", F.col("updated_at").cast("long"), "error_message").collect()
    want = _states([b for rows in batches for b in (rows, [])], 150)  # timers go off in a batch of their own
    assert any(w[3] for w in want)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_image_files_are_opened_once(spark, sf_dir):
    plan = catalogue.QUERIES["image_files"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [image#" not in plan and "binaryFile" in plan  # three readings of the images before


def test_repeated_texts_are_those_of_the_operator(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (2, long), (3, long + " more"), (4, "short one"), (5, "short one"), (6, None), (7, None), (None, long), (8, long.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shown = lambda df: sorted(map(str, map(tuple, df.select("doc_id", "kind", "s", "e", "words", "kept_in", "removed").collect())))
    got = shown(passages.repeated_texts(docs, least=passages.PARAGRAPH))
    assert len(got) == 3 and got == shown(passages.repeated(docs, least=passages.PARAGRAPH).where("kind = 'text'"))
