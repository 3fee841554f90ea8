import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import compare
from tephra.plans import catalog_queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
#: One query of each family; compare.py runs them all.
NAMES = ["A01_catalog_query", "B27_warming_windows", "C04_minus_climatology", "C08_nearest_cell", "D28_ensemble_spread", "E08_run_hits", "E17_day_window_quantiles", "J02_gev_return_values", "J08_two_sample_ks", "J16_climate_state", "J19_variance_parts", "J30_geostrophic_wind"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog_queries.QUERIES[name](spark, SF)
    rel = con.execute(catalog_queries.ORACLES[name])
    import pandas as pd

    want = pd.DataFrame.from_records(rel.fetchall(), columns=[c[0] for c in rel.description])
    got = pd.DataFrame.from_records([r.asDict() for r in df.collect()], columns=df.columns)
    assert compare.canonical(got) == compare.canonical(want)


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tephra", tmp_path / "tephra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'J16_climate_state' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)


def test_every_oracle_names_a_query():
    assert set(catalog_queries.ORACLES) <= set(catalog_queries.QUERIES)
