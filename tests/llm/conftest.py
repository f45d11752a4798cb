import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF_DIR = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, clashing column names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "  \n\t "), (None, "alpha beta"),
        (None, None), (5, "one two"), (5, "one two"), (6, "One Two"), (7, long), (8, long + " end"),
        (9, "alpha beta gamma delta epsilon zeta eta theta"),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, cls long, label int, length long, "
        "key string, hash long, shard int, rank int, n long"
    )
    return spark.createDataFrame([(*r, "en", "s", None if r[1] is None else len(r[1]), 0, 0, 0, "k", 1, 2, 3, 4) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
