"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

from curvelab.plans import queries as catalogue
from tests.conftest import ROOT, SF


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) == len(catalogue.QUERIES) and out[-1] == "False"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted((tuple(None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["peak_features", "critical_points", "validate_curves", "confidence_report", "ocr_clean_numbers", "fit_robust", "merge_curves_weighted", "small_components", "contour_score", "csv_export", "stream_curves"])
def test_queries_against_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["skeletons", "edge_masks", "tilted_sheets", "jobs_advanced", "sql_functions", "sql_critical_points"])
def test_further_queries_against_sql(spark, duck, name):
    compare(spark, duck, name)


def compare(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got.select(*columns).collect()) == shown(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["mask_outlines", "curve_simplified", "sheet_corners", "grid_removed", "resized_images", "fit_robust_large", "synthetic_curves", "stream_jobs", "stream_job_timeouts", "extract_charts", "long_resample", "long_energy", "job_files", "sql_lines", "image_files", "chart_records", "result_records"])
def test_queries_of_outlines_grids_and_streams(spark, duck, name):
    compare(spark, duck, name)
