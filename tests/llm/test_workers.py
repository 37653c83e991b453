"""What Python workers hold of an executor's memory."""

import subprocess
import sys

from pyspark.sql import functions as F

from curvelab.llm import components, passages, simhash


def test_edges_are_contracted_apart_from_what_made_them(spark, make, monkeypatch):
    """A task with two Python operators takes two workers, and an executor keeps twice as many."""
    plans = []

    class Seen(components.Stored):
        def __init__(self, df, *args):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            super().__init__(df, *args)

    monkeypatch.setattr(components, "Stored", Seen)
    line = " ".join(f"word{i}" for i in range(120))
    rows = make([(i, line.replace(f"word{9 * i} ", "other ")) for i in range(6)])
    assert {r.root for r in components.components(passages.similar_lines(rows)).collect()}
    assert {r.component_id for r in simhash.near_duplicates(make([(i, line) for i in range(3)])).collect()} == {0}
    python = [p.count("MapInArrow") + p.count("MapInPandas") + p.count("FlatMapGroupsInArrow") for p in plans]
    assert len(plans) > 4 and max(python) == 1  # 2 and more before


def test_components_of_pairs(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 5), (7, 7), (None, 1), (20, 21), (21, 22), (3, 5)], "a long, b long")
    got = {(r.node, r.root) for r in components.components(edges).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (20, 20), (21, 20), (22, 20)}
    assert components.components(edges.where(F.lit(False))).count() == 0


def test_workers_do_not_load_pandas():
    code = "import sys; from curvelab.llm import neardup, packing, passages, pii, repetition, simhash; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
