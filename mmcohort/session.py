"""Session helpers: local session for tests/bench, shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mmcohort") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Rows go to the Python workers about ``BATCH_BYTES`` at a time, unless the
    session names another size. Spark's own batches (10,000 rows, or 64 MB) hold
    tens of MB of texts, several times over: in buffers of the executor beyond
    its heap, on the way out and back, and in each worker."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


_SHIPPED: dict = {}  # application id of the SparkContext -> zip path


def ship_package(spark: SparkSession) -> None:
    """Make ``mmcohort`` importable in the Python workers (``mapInArrow``,
    Pandas UDFs and the fit pickle references to it).

    The package is zipped on the driver and handed to ``SparkContext.addPyFile``,
    which distributes it to every executor (cluster or local) — the driver's
    ``sys.path`` does not reach the workers. Once per SparkContext. What goes
    to the workers at once is bounded too (:func:`bound_batches`).
    """
    bound_batches(spark)
    sc = spark.sparkContext
    app = sc.applicationId  # unique per context, unlike id(sc) after a stop / restart
    if _SHIPPED.get(app):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    # driver-side build artefact only: Spark copies it to the executors itself
    out = os.path.join(tempfile.mkdtemp(prefix="mmcohort-pyfiles-"), f"mmcohort-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED[app] = out


def _one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_folder(configured: str | None, master: str) -> str:
    """The folder for intermediate tables: the configured one, or a folder of
    our own in a one-process session (tests). Anywhere else an unset folder is
    an error: executors would write to their own disks."""
    if configured:
        return configured
    if not _one_machine(master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    path = tempfile.mkdtemp(prefix="mmcohort-ckpt-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session (see :func:`shared_folder`)."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get(_CKPT_KEY, None)
    path = shared_folder(configured, sc.master)
    if not configured:
        spark.conf.set(_CKPT_KEY, path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_SCOPES: list[list[str]] = []  # scratch paths made inside open scratch_scope()s


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/mmcohort/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the intermediate tables made inside when left. Collect or write
    what is to be kept before: frames made inside cannot be read afterwards."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet to the shared folder and reading it back.

    Unlike ``cache``/``localCheckpoint`` the written table survives the loss of
    any executor; downstream stages re-read it instead of recomputing the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more:
    its cleaner acts on the driver's garbage collections, which may be far apart."""
    gc.collect()
    spark._jvm.System.gc()


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialize` of ``build()`` that deletes every intermediate table
    made on the way, and lets go of its shuffles, as soon as the result is written."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        build().write.mode("overwrite").parquet(path)
    release(spark)
    return spark.read.parquet(path)
