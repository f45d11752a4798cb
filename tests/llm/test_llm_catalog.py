import sys
import os

import pytest
from mmcohort.llm.catalog import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    from oracle_harness import compare, duck

    assert compare(spark, sf_dir, name, QUERIES[name], ORACLES[name], duck(sf_dir))["status"] == "match"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, sf_dir, name):
    n = int(name[2:].split("_")[0])
    rows = QUERIES[name](spark, sf_dir).count()
    if n in (3, 7):
        assert rows == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    elif n == 1:
        assert rows == 10 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").count()
    elif n == 11:
        assert rows == 5 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").count()
    elif n not in (8, 10, 12, 13):
        assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert rows > 0
