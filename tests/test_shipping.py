"""Python workers import the package even when the driver runs elsewhere.

A fresh driver process, started outside the repository with only its own
``sys.path`` pointing at it, runs a query whose work happens in Python
workers (fused projection + scoring in ``mapInArrow``)."""

import os
import subprocess
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from mmcohort.session import BATCH_BYTES, ship_package

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ROWS", len(E.queries()["modal_eval_report"](spark, "/root/testdata/sf0.001").collect()))
spark.stop()
"""


def test_workers_import_the_package_from_any_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    cwd = tempfile.mkdtemp(prefix="mmcohort-elsewhere-")  # a fresh folder outside the repository
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 12" in res.stdout, res.stderr[-3000:]


def test_texts_reach_the_workers_some_mb_at_a_time(spark):
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("a"), 100_000).alias("t"))  # 40 MB in one task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "mb"])

    ship_package(spark)
    got = texts.mapInArrow(sizes, "n long, mb long").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["mb"] for r in got) < 2 * BATCH_BYTES


def test_a_batch_size_of_the_session_stays(spark):
    own, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    own.conf.set(key, "1m")
    ship_package(own)
    assert own.conf.get(key) == "1m"
