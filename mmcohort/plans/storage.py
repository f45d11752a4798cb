"""Catalog: sources and sinks (wide CSV ingest, weights, loss history, results)."""

from __future__ import annotations

from pyspark.sql import functions as F


from mmcohort import config as C
from mmcohort.operators import losses as L
from mmcohort.operators import metrics as M
from mmcohort.operators import scoring as SC
from mmcohort.plans import evaluation as EV
from mmcohort.plans import training as TR
from mmcohort.plans.preparation import FEATURE_OF
from mmcohort.plans.registry import r, register, rounded
from mmcohort.session import scratch_path
from mmcohort.sources import fixtures as fx
from mmcohort.sources import io

_FEATS = ", ".join(FEATURE_OF)


@register("io_roundtrip", "S1 (CSV files with headers in any column order, 0/1 written as 1.0) + packed Parquet ingest", f"""WITH {fx.COHORT_SQL}
SELECT haim_id, los, death, lab_0, lab_1, {_FEATS} FROM cohort""")
def q_io_roundtrip(spark, sf_dir):
    csv_path = scratch_path(spark, "wide-csv")
    wide = fx.cohort(spark, sf_dir)
    odd = F.coalesce(F.col("de_0") % 2 == 1, F.lit(False))
    io.write_wide_csv(wide.where(odd), f"{csv_path}/a")
    # the other half: columns in reverse, the flag as pandas writes it beside a missing value
    half = wide.where(~odd).withColumn("death", F.col("death").cast("double"))
    io.write_wide_csv(half.select(*reversed(half.columns)), f"{csv_path}/b")
    back = io.read_study_csv(spark, csv_path, longs=("haim_id", "de_0", "vp_0"), ints=("death", "vmp_0"), strings=())
    packed = io.ingest(back, fx.COHORT_SPEC, scratch_path(spark, "packed"), keep=["haim_id", "los", "death", "lab_0", "lab_1"])
    return packed.select(
        "haim_id", "los", "death", "lab_0", "lab_1", *[F.col(m)[i].alias(c) for c, (m, i) in FEATURE_OF.items()]
    )


@register("encode_from_table", "S5 S2 M1: weights saved as committed snapshots, the newest read back, broadcast", f"""{TR._MODAL_SPLIT}, {TR._CODES}
SELECT study_id, modality, i AS out_idx, {r('code')} AS code FROM code""")
def q_encode_from_table(spark, sf_dir):
    path = scratch_path(spark, "weights")
    for factor in (0.5, 1.0):  # two saves: the last one wins
        io.write_weights(SC.rule_weights(spark, TR.SPEC, TR.LATENT, factor), path)
    w = SC.ProjectorWeights.from_table(io.read_weights(spark, path))
    e = SC.encode(TR.modal_split(spark, sf_dir), w, TR.SPEC.stored_order)
    return rounded(TR._codes_long(e))


# epoch 2 of the history: encoder weights and biases halved, hence codes and logits too
_HALF_SQL = f"""{TR._MODAL_SPLIT}, {TR._CODES},
jl2 AS (SELECT * REPLACE (z / 2 AS z) FROM jl),
mse2 AS (SELECT split, batch_id, modality, sum((xh - x) * (xh - x)) / count(*) AS mse FROM (
           SELECT split, study_id, modality, x, (xhat - CAST(CAST(0.005::DOUBLE * j AS FLOAT) AS DOUBLE)) / 2
                  + CAST(CAST(0.005::DOUBLE * j AS FLOAT) AS DOUBLE) AS xh FROM recon) JOIN bt USING (study_id, split)
         GROUP BY split, batch_id, modality)"""


def _epoch_sql(epoch: int, jl: str, mse: str) -> str:
    dp = f"""CASE WHEN count(*) FILTER (WHERE {TR._VALID}) = 0 THEN {C.DELTA_P_DEFAULT} ELSE
   coalesce(avg(CASE WHEN {TR._VALID} AND y = 1 THEN {TR._SIG} END), {C.DELTA_P_DEFAULT})
 - coalesce(avg(CASE WHEN {TR._VALID} AND y = 0 THEN 1.0 - {TR._SIG} END), {C.DELTA_P_DEFAULT}) END"""
    return f"""SELECT 'fixture' AS run, CAST({epoch} AS INTEGER) AS epoch, split, {r('avg(loss)')} AS loss, any_value(dp) AS delta_p FROM (
  SELECT split, batch_id, l + {C.BETA} * sum(mse) AS loss FROM (
    SELECT split, batch_id, sum(loss) AS l FROM ({TR._asl_sql(jl, 'split, batch_id', C.GAMMAS_JOINT)}) GROUP BY split, batch_id
  ) JOIN {mse} USING (split, batch_id) GROUP BY split, batch_id, l)
JOIN (SELECT split, list({r('v')} ORDER BY class_id) AS dp FROM (SELECT split, class_id, {dp} AS v FROM {jl} GROUP BY split, class_id) GROUP BY split)
USING (split) GROUP BY split"""


@register("history_append", "S4 S6: loss and delta-p rows per epoch; an epoch written twice is there once", f"""{_HALF_SQL}
{_epoch_sql(1, 'jl', 'mse_b')}
UNION ALL
{_epoch_sql(2, 'jl2', 'mse2')}""")
def q_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    for epoch, factor in ((1, 1.0), (2, 1.0), (2, 0.5)):  # the second epoch fails after its rows and runs again
        b, comb = TR._batch_losses(spark, sf_dir, factor)
        lg = L.to_long(b, keep=("split",), y="y", z="logits")
        dp = L.delta_p(lg, by=("split",)).groupBy("split").agg(
            F.sort_array(F.collect_list(F.struct("class_id", "delta_p"))).alias("_dp")
        )  # 12 values per split
        io.write_history(L.epoch_loss(comb, by=("split",)).join(dp, "split").select(
            F.lit("fixture").alias("run"), F.lit(epoch).alias("epoch"), "split", F.col("epoch_loss").alias("loss"),
            F.col("_dp.delta_p").alias("delta_p"),
        ), path)
    back = io.read_history(spark, path)
    return rounded(back.select("run", F.col("epoch").cast("int").alias("epoch"), "split", "loss", "delta_p"))


def _kept_counts(spark, sf_dir):
    """Counts of two scoring runs over different rows, kept apart, one run repeated, then merged."""
    path = scratch_path(spark, "eval-state")
    rows = M.predict(fx.scores(spark, sf_dir))
    for run, own in (("first", F.col("study_id") % 3 == 0), ("second", F.col("study_id") % 3 > 0), ("first", F.col("study_id") % 3 == 0)):
        io.put_state(M.score_counts(rows.where(own)), path, run=run)
    return M.merge_counts(io.read_state(spark, path, M.COUNTS_SCHEMA, ["run"]))


@register("eval_report_merged", "G26 G17-G22 G24: report of two scoring runs from their kept counts", EV.EVAL_REPORT_SQL)
def q_report_merged(spark, sf_dir):
    return rounded(M.report_of(_kept_counts(spark, sf_dir)))


@register("roc_points_merged", "G26 G23: ROC of two scoring runs from their kept counts", f"{EV._SCORED}, {EV.roc_sql()}")
def q_roc_merged(spark, sf_dir):
    return rounded(M.roc_points_of(_kept_counts(spark, sf_dir)))


def _written_results(spark, sf_dir):
    table = M.count_table(M.predict(fx.scores(spark, sf_dir)))
    path = scratch_path(spark, "results")
    splits = M.score_splits(table)
    io.write_results(M.report_of(table, splits), M.roc_points_of(table, splits), path)
    return io.read_results(spark, path)


@register("results_write", "S3 G25: metrics and ROC tables written, metrics read back", EV.EVAL_REPORT_SQL)
def q_results(spark, sf_dir):
    return rounded(_written_results(spark, sf_dir)[0])


@register("results_roc", "S3 G23: metrics and ROC tables written, ROC read back", f"{EV._SCORED}, {EV.roc_sql()}")
def q_results_roc(spark, sf_dir):
    return rounded(_written_results(spark, sf_dir)[1])
