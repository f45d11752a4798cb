"""Every catalog query against its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from mmcohort.plans import CATALOG
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(CATALOG)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF, name, E.queries()[name], E.oracle_sql().get(name), con)
    assert res["status"] in ("match", "rows-only"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert {"class_id", "auc", "f1_macro"} <= set(df.columns)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The subpackage llm, its tests and corpus_pipeline.py can be taken away."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "mmcohort"), tmp_path / "mmcohort", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); print(len(q), len(E.oracle_sql()), any(x.startswith('op') for x in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(NAMES)), str(len(NAMES)), "False"], out.stderr[-2000:]
