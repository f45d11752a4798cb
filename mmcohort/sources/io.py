"""Sources and sinks: wide study CSV, packed Parquet, weights, loss history, results.

The wide CSV (>3,000 columns) is read ONCE with an explicit schema built from
its header (no inference pass), packed to one array column per modality and
written as Parquet; every later stage scans the packed table (column pruning
then skips whole modalities).
"""

from __future__ import annotations

import contextlib
import csv
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mmcohort.config import ModalitySpec
from mmcohort.operators.cohort import pack_modalities

# Study metadata columns that are text in the CSV (dropped, never parsed as numbers).
TEXT_COLUMNS = (
    "img_id", "img_charttime", "img_deltacharttime", "discharge_location", "split",
    "PerformedProcedureStepDescription", "ViewPosition",
)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first_line(rows):
    for row in rows:
        if row[0].strip():
            yield row
            return


_UNSPLIT = 1 << 40


def header_index(spark: SparkSession, path: str) -> DataFrame:
    """(value, files): each distinct first line (that is not blank) of the files
    below ``path``. A file is one partition here and its task stops after that
    line, so the rest of the file is not read; this needs the partition's
    iterator, which only the RDD view gives. Files without any line have no row."""
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": _UNSPLIT, "spark.sql.files.openCostInBytes": _UNSPLIT}):
        lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("f"))
        rdd = lines.rdd
        rdd.getNumPartitions()  # the files are dealt while the settings hold
    heads = spark.createDataFrame(rdd.mapPartitions(_first_line), "value string, f string")
    return heads.groupBy("value").agg(F.sort_array(F.collect_list("f")).alias("files"))


def csv_headers(spark: SparkSession, path: str, marker: str) -> list[tuple[list[str], list[str]]]:
    """(columns, files) for each distinct header below ``path``: the first line
    of every file. A file whose header lacks the column ``marker`` raises."""
    out = []
    for h in header_index(spark, path).collect():  # one row per distinct header
        cols = next(csv.reader([h["value"].lstrip("\ufeff")]))
        if marker not in cols:
            raise ValueError(f"no column {marker!r} in the header of {h['files'][:3]}")
        out.append((cols, h["files"]))
    if not out:
        raise ValueError(f"no header line below {path}")
    return sorted(out, key=lambda h: h[1][0])  # the first file's order is the table's


def row_position(rows_in_block: int | None = None) -> Column:
    """struct (file, block, row) that grows along the input: for files read in
    splits the split's start and the row's number in its task; with
    ``rows_in_block`` (sources that number their rows, such as Parquet) the
    number of the row in its file, in blocks of so many."""
    file = F.col("_metadata.file_path").alias("file")
    if rows_in_block is None:
        return F.struct(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    row = F.col("_metadata.row_index")
    return F.struct(file, F.floor(row / rows_in_block).cast("long").alias("block"), row.alias("row"))


def schema_from_header(
    names: Sequence[str],
    *,
    longs: Iterable[str] = ("haim_id",),
    ints: Iterable[str] = ("death_status",),
    strings: Iterable[str] = TEXT_COLUMNS,
) -> T.StructType:
    longs, ints, strings = set(longs), set(ints), set(strings)
    fields = []
    for n in names:
        if n in longs:
            t = T.LongType()
        elif n in ints:
            t = T.IntegerType()
        elif n in strings:
            t = T.StringType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


def read_study_csv(
    spark: SparkSession, path: str, *, key: str = "haim_id", ints: Iterable[str] = ("death_status",),
    position: str | None = None, **schema_kw,
) -> DataFrame:
    """Wide study table; blank cells -> NULL, 'NaN' -> NaN (guarded downstream).

    Columns go by name: files with their columns in another order are read by
    their own header, files with other columns raise. The table has the column
    order of the first file by path (features are packed in table order). ``ints`` may be written
    ``1`` or ``1.0`` (as pandas does beside a missing value); any other
    fraction fails the job. ``position`` names a column to add: where a row
    stands in the input (:func:`row_position`).
    """
    ints, parts = list(ints), []
    for names, files in csv_headers(spark, path, key):
        schema = schema_from_header(names, ints=(), **schema_kw)
        part = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
            .option("nanValue", "NaN").csv(files)
        )
        parts.append(part.withColumn(position, row_position()) if position else part)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)  # raises on missing or extra columns
    for c in ints:
        if c in out.columns:
            whole = F.col(f"`{c}`") == F.floor(F.col(f"`{c}`"))
            v = F.when(F.isnan(f"`{c}`"), F.lit(None)).when(whole, F.col(f"`{c}`").cast("int"))
            out = out.withColumn(c, v.otherwise(F.when(F.col(f"`{c}`").isNotNull(), F.raise_error(F.lit(f"{c} is not an integer")).cast("int"))))
    return out


def ingest(df: DataFrame, spec: ModalitySpec, out_path: str, *, keep: Sequence[str], dtype: str = "double") -> DataFrame:
    """Pack the wide table's modalities to arrays and write Parquet once; returns
    the re-read table. ``dtype`` "float" halves it (the source hands over float32)."""
    packed = pack_modalities(df, spec, keep=keep, dtype=dtype)
    packed.write.mode("overwrite").parquet(out_path)
    return df.sparkSession.read.parquet(out_path)


# -- sinks ------------------------------------------------------------------------

def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


_COMMITS = "_commits"
SNAPSHOTS_KEPT = 2


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed snapshots below ``path``, the newest last."""
    return [n for n in _names(spark, f"{path}/{_COMMITS}") if n.startswith("v")]


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next snapshot of the table at ``path`` and return its
    name. The snapshot is a folder of its own, and an empty marker file, made
    last, commits it: a writer that dies leaves the former snapshot in force.
    The newest ``SNAPSHOTS_KEPT`` stay, so that readers of the former one finish."""
    spark = df.sparkSession
    before = committed(spark, path)
    number = int(before[-1].split("-")[0][1:]) + 1 if before else 1
    name = f"v{number:09d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    fs, marker = _file_system(spark, f"{path}/{_COMMITS}/{name}")
    fs.create(marker, False).close()
    for old in [*before, name][:-SNAPSHOTS_KEPT]:  # the marker first: never a committed folder without its files
        for gone in (f"{path}/{_COMMITS}/{old}", f"{path}/{old}"):
            fs, at = _file_system(spark, gone)
            fs.delete(at, True)
    return name


def snapshot_path(spark: SparkSession, path: str) -> str:
    """The newest committed snapshot at ``path``; the path itself where there has never been one."""
    names = committed(spark, path)
    if not names and any(n.startswith("v") for n in _names(spark, path)):
        raise ValueError(f"no committed snapshot at {path}")
    return f"{path}/{names[-1]}" if names else path


def write_weights(weights: DataFrame, path: str) -> None:
    """Projector weights table; each save is a snapshot (the last epoch wins, a
    save that fails half way changes nothing)."""
    write_snapshot(weights.select("modality", "layer", "out_idx", "w", "b"), path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed weights at ``path`` (or a plain table of them)."""
    schema = "modality string, layer string, out_idx int, w array<float>, b float"
    return spark.read.schema(schema).parquet(snapshot_path(spark, path))


HISTORY_SCHEMA = "split string, loss double, delta_p array<double>, run string, epoch int"


def write_history(history: DataFrame, path: str) -> None:
    """Loss history rows (run, epoch, split, loss[, delta_p]): what is written of
    an epoch replaces the rows that epoch of the run had, so a repeated or
    retried epoch is never there twice; other runs and epochs stay."""
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "epoch").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).select("run", "epoch", "split", "loss", "delta_p")


def write_results(metrics: DataFrame, roc: DataFrame, path: str) -> None:
    """Evaluation results: one metrics row per class + the long ROC table."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    roc.write.mode("overwrite").parquet(f"{path}/roc")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/roc")


# -- states that grow run by run or file by file ------------------------------------

def put_state(state: DataFrame, path: str, **names: str) -> None:
    """Keep ``state`` under the given names (one partition column each): a part
    written again replaces its former rows, the others stay."""
    named = state.select(*[F.lit(v).cast("string").alias(k) for k, v in names.items()], "*")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)


def read_state(spark: SparkSession, path: str, schema: str, names: Sequence[str]) -> DataFrame:
    """All parts kept at ``path``."""
    return spark.read.schema(", ".join([schema, *(f"{n} string" for n in names)])).parquet(path)


def write_wide_csv(df: DataFrame, path: str) -> None:
    """Write a wide table as CSV with header (used to produce study-shaped inputs)."""
    df.write.mode("overwrite").option("header", True).csv(path)
