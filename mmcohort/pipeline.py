"""End-to-end jobs: preparation (E1) and evaluation (E3) with lineage cuts.

The prepared study table is read by every later stage (distinct group ids for
the split cutoff, train rows for the statistics, validation rows for scoring),
so it is written to the shared checkpoint folder once
(:func:`mmcohort.session.materialize`). The split and the standardisation are
per-row projections of that table with a few driver-side literals (one cutoff
row, one statistics row), so they are recomputed where used, not written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.config import ModalitySpec
from mmcohort.operators import batches as B
from mmcohort.operators import cohort as K
from mmcohort.operators import losses as L
from mmcohort.operators import metrics as M
from mmcohort.operators import scaling as S
from mmcohort.operators import scoring as SC
from mmcohort.operators import fit as FT
from mmcohort.operators import split as SP
from mmcohort.session import materialize, scratch_scope


POSITION = "_position"  # where a row stands in the input


def prepare_study(
    wide: DataFrame,
    spec: ModalitySpec,
    *,
    key: str = "haim_id",
    label_cols: Sequence[str] = C.CLASS_NAMES,
    drop_names: Sequence[str] = C.DROPPED_COLUMNS,
    drop_prefixes: Sequence[str] = C.DROPPED_PREFIXES,
    los: str = "img_length_of_stay",
    death: str = "death_status",
    los_mode: str = "literal",
    val_fraction: float = C.VAL_FRACTION,
    seed: int = C.SPLIT_SEED,
    dtype: str = "float",
    members: str = "hash",
    position: str | None = None,
    label: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """E1: labels -> prune -> pack -> outlier -> incomplete -> group split ->
    train statistics -> standardise -> uncertain labels recoded.

    ``dtype``: element type of the packed and the scaled arrays ("float" as the
    source hands its rows over; statistics are summed in double precision).
    ``members="source"`` splits as the source does, by the ``position`` column
    (:func:`mmcohort.sources.io.read_study_csv` adds it). ``label``: the
    single-label route — rows whose label is 0 or 1, no outcome labels, no row
    filters, statistics over what is present; ``y`` then holds that label at its
    place in ``label_cols`` and NULL, which every loss and metric skips, elsewhere.

    Returns (scaled table: a projection over the written prepared table, one-row statistics).
    """
    extra = [position] if members == "source" else []
    if position and not extra:
        wide = wide.drop(position)
    if label is None:
        d = K.prepare(
            wide, spec, key=key, label_cols=label_cols, drop_names=drop_names, drop_prefixes=drop_prefixes,
            los=los, death=death, los_mode=los_mode, extra_keep=extra, dtype=dtype,
        )
    else:
        if label not in label_cols:
            raise ValueError(f"{label!r} is none of the labels {list(label_cols)}")
        # the mode's own drop list, then the columns that are no features either
        others = [c for c in drop_names if c in wide.columns and c not in C.SINGLE_LABEL_DROPPED]
        names = [c for c in C.SINGLE_LABEL_DROPPED if c in wide.columns or c in drop_names] + others
        d = K.prepare_single(wide, spec, label, key=key, drop_names=names, drop_prefixes=drop_prefixes, extra_keep=extra, dtype=dtype)
        none = F.lit(None).cast("double")
        d = d.withColumn("y", F.array(*[F.col("y") if c == label else none for c in label_cols]))
    d = materialize(d, "study-prepared")
    cut = SP.fit_split(d, key, val_fraction=val_fraction, seed=seed, members=members, position=position)
    d = SP.apply_split(d, key, cut).drop(*extra)
    arrays = [m for m in spec.stored_order if spec.widths[m] > 0]
    stats = S.fit_stats(d.where(F.col("split") == "train"), arrays, widths=spec.widths, skip_missing=label is not None)
    scaled = K.recode_uncertain(S.apply_stats(d, stats, arrays), col="y")
    return scaled, stats


def score_split(
    scaled: DataFrame,
    weights: SC.ProjectorWeights,
    make_scorer: Callable,
    spec: ModalitySpec,
    *,
    split: str = "val",
) -> DataFrame:
    """Projection + joint scoring of one split in one Python pass (codes never
    reach the JVM), written as its count table (class, score, prediction):
    all that the evaluation reads."""
    return M.count_table(_predictions(scaled, weights, make_scorer, spec, split))


def _predictions(scaled, weights, make_scorer, spec, split) -> DataFrame:
    toks = [m for m in spec.token_order if spec.widths[m] > 0]
    rows = scaled.where(F.col("split") == split)
    s = SC.encode_and_score(rows, weights, make_scorer, toks, keep=["y"])
    return M.predict(L.to_long(s, keep=(), y="y", z="logits"))


def keep_scores(
    scaled: DataFrame, weights: SC.ProjectorWeights, make_scorer: Callable, spec: ModalitySpec, path: str, run: str, *, split: str = "val"
) -> None:
    """Score one batch of studies and keep its counts at ``path`` as ``run``: a
    run that is repeated replaces its own counts, all others stay. The rows of
    different runs must differ."""
    from mmcohort.sources import io

    io.put_state(M.score_counts(_predictions(scaled, weights, make_scorer, spec, split)), path, run=run)


def evaluate_kept(spark, path: str, out_path: str | None = None, runs: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`evaluate` over all kept runs (or the named ones): every score was
    computed once, when its run was."""
    from mmcohort.sources import io

    kept = io.read_state(spark, path, M.COUNTS_SCHEMA, ["run"])
    return evaluate(M.merge_counts(kept if runs is None else kept.where(F.col("run").isin(list(runs)))), out_path)


def keep_stats(train_rows: DataFrame, spec: ModalitySpec, path: str, part: str) -> None:
    """Keep the feature statistics of one part of the training rows (a file, a
    day) at ``path``: a new part costs its own pass only."""
    from mmcohort.sources import io

    arrays = [m for m in spec.stored_order if spec.widths[m] > 0]
    io.put_state(S.partial_stats(train_rows, arrays, spec.widths), path, part=part)


def kept_stats(spark, spec: ModalitySpec, path: str) -> DataFrame:
    """One-row statistics of all kept parts, for :func:`mmcohort.operators.scaling.apply_stats`."""
    from mmcohort.sources import io

    arrays = [m for m in spec.stored_order if spec.widths[m] > 0]
    return S.merge_stats(io.read_state(spark, path, S.STATE_SCHEMA, ["part"]), arrays, spec.widths)


def evaluate(counts: DataFrame, out_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """E3: per-class metrics and ROC points from a count table; written as
    tables when ``out_path`` is given."""
    splits = M.score_splits(counts)  # shared by the areas and the curve
    rep, roc = M.report_of(counts, splits), M.roc_points_of(counts, splits)
    if out_path:
        from mmcohort.sources import io

        io.write_results(rep, roc, out_path)
    return rep, roc


def _validation_scores(
    val: DataFrame, weights: SC.ProjectorWeights, head: np.ndarray, mods: Sequence[str], key: str | None, name: str, batch_size: int
) -> DataFrame:
    """Narrow scores (y, logits, squared errors) of the rows, written once, with
    batch numbers in the order of ``key`` (rows of one key: by a hash of what
    they hold)."""
    keep = ["y"] if key is None else [key, "y"]
    per = SC.encode_decode_score(val, weights, SC.linear_head(head), mods, keep=keep)
    if key is None:
        return materialize(per, name)
    narrow = [c for c in per.columns if c != key]
    per = materialize(per.withColumn("_tie", F.xxhash64(*narrow)), name)
    return B.batch_numbers(per, key, batch_size=batch_size, partition=(), keep=["_tie", *narrow], tie="_tie")


def _batch_or_row(scores: DataFrame, mods, params, beta, loss, n_classes, by) -> DataFrame:
    """One row: mean loss, ``asl`` (without the reconstruction part) and groups."""
    groups = ["batch_id"] if by == "batch" else ["_all"]
    s = scores if by == "batch" else scores.withColumn("_all", F.lit(1))
    each = L.batch_losses(s, mods, params, by=groups, beta=beta, loss=loss, n_classes=n_classes, main="_a")
    return each.agg(F.avg("loss").alias("loss"), F.avg("_a").alias("asl"), F.count(F.lit(1)).alias("n_batches"))


def validation_loss(
    val: DataFrame,
    weights: SC.ProjectorWeights,
    head: np.ndarray,
    token_order: Sequence[str],
    *,
    key: str | None,
    by: str = "batch",
    batch_size: int = C.BATCH_SIZE,
    gammas: Sequence[float] = C.GAMMAS_JOINT,
    beta: float = C.BETA,
    loss: str = "asl",
    class_w: DataFrame | None = None,
    losses: Mapping[int, L.ClassLoss] | None = None,
    name: str = "val-scored",
) -> DataFrame:
    """M8, one row (loss, asl, n_batches): the unweighted mean of the losses of
    ``batch_size``-row batches in ``key`` order, as the source reports it; with
    ``by="row"`` the loss over all rows at once. No row: NULL. ``loss="mixed"``
    takes each class's own function from ``losses``."""
    if by not in ("batch", "row"):
        raise ValueError("by must be 'batch' or 'row'")
    mods = list(token_order)
    scores = _validation_scores(val, weights, head, mods, key if by == "batch" else None, name, batch_size)
    params = losses if loss == "mixed" else class_w if loss == "bce" else L.class_params(val.sparkSession, gammas)
    return _batch_or_row(scores, mods, params, beta, loss, len(gammas), by)


def validate(
    val: DataFrame,
    params: dict,
    head: np.ndarray,
    token_order: Sequence[str],
    *,
    key: str | None = None,
    by: str = "batch",
    batch_size: int = C.BATCH_SIZE,
    gammas: Sequence[float] = C.GAMMAS_JOINT,
    beta: float = C.BETA,
    name: str = "val",
    loss: str = "asl",
    class_w: DataFrame | None = None,
) -> dict:
    """M8: loss and delta-p of one split without gradients, as Spark aggregations.

    One fused Python pass writes a small per-row table (labels, logits, squared
    reconstruction error per modality); everything else is an aggregate over
    it. The loss is the mean of batch losses in ``key`` order (see
    :func:`validation_loss`); ``by="row"`` takes the whole split as one batch.
    ``loss="bce"`` uses the weighted BCE averaged over the classes with
    ``class_w`` (the training split's class weights). Returns {"loss", "asl",
    "mse": {...}, "delta_p": [...]}; without any row the losses are None. The
    written table is deleted.
    """
    if by == "batch" and key is None:
        raise ValueError("batches need a key that orders the rows")
    spark = val.sparkSession
    mods = list(token_order)
    w = SC.ProjectorWeights(spark, {m: {k: np.asarray(params[m][k], dtype=np.float64) for k in FT.PARAM_NAMES} for m in mods})
    with scratch_scope(spark):
        scores = _validation_scores(val, w, head, mods, key if by == "batch" else None, f"{name}-scored", batch_size)
        table = class_w if loss == "bce" else L.class_params(spark, gammas)
        one = _batch_or_row(scores, mods, table, beta, loss, len(gammas), by).first()  # one row
        mse = {r["modality"]: r["mse"] for r in L.mse_of_sums(scores, mods).collect()}  # one row per modality
        lg = L.to_long(scores, keep=(), y="y", z="logits")
        dp = sorted((r["class_id"], r["delta_p"]) for r in L.delta_p(lg).collect())  # one row per class
    return {"loss": one["loss"], "asl": one["asl"], "mse": mse, "delta_p": [float(v) for _, v in dp]}


def train(
    scaled: DataFrame,
    init: SC.ProjectorWeights,
    head: np.ndarray,
    spec: ModalitySpec,
    *,
    run: str,
    epochs: int,
    steps_per_epoch: int = 1,
    history_path: str | None = None,
    weights_path: str | None = None,
    gammas: Sequence[float] = C.GAMMAS_JOINT,
    beta: float = C.BETA,
    lr: float = C.LEARNING_RATE,
    weight_decay: float = C.WEIGHT_DECAY,
    max_norm: float = C.GRAD_CLIP,
    loss: str = "asl",
    isolated: bool = False,
    key: str = "haim_id",
) -> tuple[dict, list[dict]]:
    """E2: the training loop (joint variant) over a prepared, scaled table.

    ``loss``: "asl" (asymmetric loss, the default) or "bce" (class-weighted
    BCE; weights n / (2 K n_v + eps) from the training split, also used for
    validation). ``isolated``: every modality is scored alone in training
    (loss = sum over modalities; pass ``gammas=C.GAMMAS_ISOLATED``), while
    validation scores them jointly, as the source does.

    Per epoch: ``steps_per_epoch`` data-parallel fit steps on the train split
    (the epoch's train loss is the mean of its step losses, delta-p from the
    last step's forward pass over the whole split), validation of the updated
    projectors on the val split (:func:`validate`: mean of 32-row batch losses
    in ``key`` order), one history row per split
    written to ``history_path`` (run, epoch, split, loss, delta_p; a repeated
    epoch replaces its rows) and a snapshot of the weights committed at
    ``weights_path`` (the last epoch wins). Both
    splits are written once up front, so no epoch recomputes the preparation.
    """
    mods = [m for m in spec.token_order if spec.widths[m] > 0]
    cols = ["y", *[F.col(m).cast("array<double>").alias(m) for m in mods]]
    tr = materialize(scaled.where(F.col("split") == "train").select(*cols), f"{run}-train")
    va = materialize(scaled.where(F.col("split") == "val").select(key, *cols), f"{run}-val")
    state = FT.FitState(params={m: {k: np.asarray(v, dtype=np.float64).copy() for k, v in d.items()}
                                for m, d in FT.params_from_weights(init).items() if m in mods})
    spark = scaled.sparkSession
    cw_df, cw = None, None
    if loss == "bce":
        k = len(gammas)
        rows = L.class_weights(L.to_long(tr, keep=(), y="y", z="y")).collect()  # one row per class
        cw = np.zeros((k, 2))
        for r in rows:
            cw[r["class_id"]] = (r["w0"], r["w1"])
        cw_df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cw)], "class_id int, w0 double, w1 double")
    history: list[dict] = []
    for epoch in range(1, epochs + 1):
        _, steps = FT.fit_projectors(
            tr, None, head, token_order=mods, gammas=gammas, steps=steps_per_epoch, lr=lr,
            weight_decay=weight_decay, max_norm=max_norm, beta=beta, state=state, loss=loss, class_w=cw,
            isolated=isolated,
        )
        v = validate(
            va, state.params, head, mods, key=key, gammas=gammas, beta=beta, name=f"{run}-val-{epoch}", loss=loss, class_w=cw_df
        )
        rows = [
            {"run": run, "epoch": epoch, "split": "train", "loss": float(np.mean([h["loss"] for h in steps])),
             "delta_p": steps[-1]["delta_p"]},
            {"run": run, "epoch": epoch, "split": "val", "loss": v["loss"], "delta_p": v["delta_p"]},
        ]
        history += rows
        if history_path:
            from mmcohort.sources import io

            io.write_history(
                spark.createDataFrame(rows, "run string, epoch int, split string, loss double, delta_p array<double>"),
                history_path,
            )
        if weights_path:
            from mmcohort.sources import io

            io.write_weights(FT.params_to_table(spark, state.params), weights_path)
    return state.params, history


def run_evaluation(
    spark,
    csv_path: str,
    weights_path: str,
    make_scorer: Callable,
    out_path: str,
    *,
    spec: ModalitySpec = C.STUDY_SPEC,
    los_mode: str = "literal",
    label: str | None = None,
    members: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """The evaluation script end to end: study CSV (schema from its header) ->
    preparation, split and standardisation -> projector weights table ->
    projection and joint scoring of the validation split -> per-class metrics
    and ROC tables written under ``out_path``. ``label`` evaluates one label
    only, ``members="source"`` on the source's own validation patients (see
    :func:`prepare_study`)."""
    from mmcohort.sources import io

    wide = io.read_study_csv(spark, csv_path, position=POSITION)
    scaled, _ = prepare_study(wide, spec, los_mode=los_mode, label=label, members=members, position=POSITION)
    weights = SC.ProjectorWeights.from_table(io.read_weights(spark, weights_path))
    evaluate(score_split(scaled, weights, make_scorer, spec), out_path)
    return io.read_results(spark, out_path)


def run_training(
    spark,
    csv_path: str,
    init_weights_path: str,
    head: np.ndarray,
    *,
    run: str,
    epochs: int,
    history_path: str,
    weights_path: str,
    spec: ModalitySpec = C.STUDY_SPEC,
    variant: str = "asym",
    los_mode: str = "literal",
    label: str | None = None,
    members: str = "hash",
    **fit_kw,
) -> tuple[dict, list[dict]]:
    """A training script end to end: study CSV -> preparation -> :func:`train`
    with the variant's loss ("bce", "asym" or "iso"), history and weights sinks."""
    from mmcohort.sources import io

    if variant not in ("bce", "asym", "iso"):
        raise ValueError("variant must be 'bce', 'asym' or 'iso'")
    wide = io.read_study_csv(spark, csv_path, position=POSITION)
    scaled, _ = prepare_study(wide, spec, los_mode=los_mode, label=label, members=members, position=POSITION)
    init = SC.ProjectorWeights.from_table(io.read_weights(spark, init_weights_path))
    return train(
        scaled, init, head, spec, run=run, epochs=epochs, history_path=history_path, weights_path=weights_path,
        loss="bce" if variant == "bce" else "asl", isolated=variant == "iso",
        gammas=C.GAMMAS_ISOLATED if variant == "iso" else C.GAMMAS_JOINT, **fit_kw,
    )
