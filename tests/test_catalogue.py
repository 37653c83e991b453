"""Catalogue queries against their SQL, on tables of other sizes and values too."""

import random

import duckdb
import pytest

from curvelab.plans import queries as catalogue
from tests.test_entry import SF, shown


def compare(spark, duck, name, folder=SF):
    got, want = catalogue.QUERIES[name](spark, folder), duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert shown(got.select(*columns).collect()) == shown(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "supplier orders events embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_csv_files(spark, duck):
    compare(spark, duck, "csv_files")


def test_json_points(spark, duck):
    compare(spark, duck, "json_points")


@pytest.fixture(scope="module")
def ticks(tmp_path_factory):
    """Nations of 200 ticks, where the line with most ticks is not through two of any 64."""
    folder = str(tmp_path_factory.mktemp("ticks"))
    pick = random.Random(5)
    rows = [(k, f"S{k}", k % 6, round(pick.uniform(-1000, 10000), 2)) for k in range(1, 1201)]
    con = duckdb.connect()
    con.sql("CREATE TABLE s (s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    con.sql(f"COPY s TO '{folder}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/supplier.parquet'")
    return folder, con


def test_robust_lines_of_large_groups(spark, ticks):
    folder, con = ticks
    compare(spark, con, "fit_robust", folder)


def test_robust_lines_by_sql_of_large_groups(spark, ticks):
    folder, con = ticks
    compare(spark, con, "sql_lines", folder)


def test_weights_of_smoothing_are_rounded_once():
    from curvelab.functions.arrays import savgol_matrix
    from curvelab.plans.oracle import _polynomial_weights

    for window in (5, 11):
        assert savgol_matrix(window).tolist() == _polynomial_weights(window)


def test_drawn_images_go_on_a_few_at_a_time():
    import pandas as pd
    from pyspark.sql import types as T

    from curvelab.operators import images

    class Table:  # stands for a table, and gives what a task runs
        schema = T.StructType([T.StructField("image_id", T.LongType())])
        select = lambda self, *_: self
        mapInPandas = lambda self, run, _: run

    out = list(images.drawn(Table(), 20, 30, 2)([pd.DataFrame({"image_id": range(40), "ys": [[5] * 28] * 40})]))
    assert [len(b) for b in out] == [16, 16, 8] and pd.concat(out)["image_id"].tolist() == list(range(40))
