"""Per-class evaluation as DataFrame aggregations.

Input is the long score table: one row per (study, class) with the label
``y`` (NULL / NaN / 2 are masked), the logit ``z`` or probability ``p`` and the
hard prediction ``pred``. Every function keeps the work distributed: threshold
metrics are one partial+final aggregate, ROC/AUC pre-aggregate ties per
(class, score) before the ordered pass of :mod:`mmcohort.operators.prefix`.

Whatever needs the scores more than once goes through one *count table*
(:func:`count_table`: class, score, prediction and label counts), written once:
the rows, and a scorer behind them, are evaluated a single time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.functions.columns import hard_pred, required, sigmoid, valid_label
from mmcohort.operators.prefix import bucketize, ordered_prefix, quantile_splits
from mmcohort.session import materialize


def predict(long: DataFrame, *, z: str = "z", as_float: bool = False) -> DataFrame:
    """Add ``p`` = sigmoid(z) and ``pred`` = round-half-even(p).

    ``as_float=True`` rounds p to single precision like a float32 scorer.
    """
    p = sigmoid(z)
    if as_float:
        p = p.cast("float").cast("double")
    return long.withColumn("p", p).withColumn("pred", hard_pred("p"))


def mask(long: DataFrame, *, y: str = "y") -> DataFrame:
    """Keep rows whose label is present, not NaN and not the uncertain code."""
    return long.where(valid_label(y))


def confusion(long: DataFrame, *, y: str = "y", pred: str = "pred") -> DataFrame:
    """2x2 confusion counts per class (masked rows do not count; every class of the input appears)."""
    v = valid_label(y)
    yc, pc = F.col(y), F.col(pred)
    return long.groupBy("class_id").agg(
        F.count_if(v).cast("long").alias("n"),
        F.count_if(v & (yc == 0) & (pc == 0)).cast("long").alias("tn"),
        F.count_if(v & (yc == 0) & (pc == 1)).cast("long").alias("fp"),
        F.count_if(v & (yc == 1) & (pc == 0)).cast("long").alias("fn"),
        F.count_if(v & (yc == 1) & (pc == 1)).cast("long").alias("tp"),
    )


def threshold_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall (undefined -> 0) and macro F1 over the labels seen."""
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    f1_pos = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    f1_neg = F.coalesce(F.try_divide(2 * tn, 2 * tn + fn + fp), F.lit(0.0))
    has_neg = (tn + fp + fn) > 0  # label 0 appears in y (tn, fp) or in the prediction (tn, fn)
    has_pos = (tp + fn + fp) > 0
    n_labels = has_neg.cast("int") + has_pos.cast("int")
    f1_sum = F.when(has_neg, f1_neg).otherwise(F.lit(0.0)) + F.when(has_pos, f1_pos).otherwise(F.lit(0.0))
    return conf.select(
        "*",
        F.try_divide(tp + tn, n).cast("double").alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).cast("double").alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).cast("double").alias("recall"),
        F.try_divide(f1_sum, n_labels).cast("double").alias("f1_macro"),
    )


COUNTS_SCHEMA = "class_id int, p double, pred int, n long, n_pos long, n_neg long"


def score_counts(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """(class_id, p, pred, n, n_pos, n_neg): one row per distinct score and
    prediction of a class. Masked rows are one row with NULL p and no counts, so
    every class of the input appears. A NULL or NaN score fails the job."""
    v, yc = valid_label(y), F.col(y)
    score = F.when(v, required(F.col(p).cast("double"), "a labelled row has no score"))
    return long.groupBy("class_id", score.alias("p"), F.when(v, F.col(pred)).alias("pred")).agg(
        F.count_if(v).cast("long").alias("n"),
        F.count_if(v & (yc == 1)).cast("long").alias("n_pos"),
        F.count_if(v & (yc == 0)).cast("long").alias("n_neg"),
    )


def count_table(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """:func:`score_counts`, written once."""
    return materialize(score_counts(long, y=y, p=p, pred=pred), "score-counts")


def merge_counts(parts: DataFrame) -> DataFrame:
    """The count table of all rows behind kept parts (the counts of several
    scoring runs over different rows): equal (class, score, prediction) add up.
    Written once, as :func:`count_table`; no score is looked at again."""
    merged = parts.groupBy("class_id", "p", "pred").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "n_pos", "n_neg")])
    return materialize(merged, "score-counts")


def confusion_of(counts: DataFrame) -> DataFrame:
    """:func:`confusion` from the count table."""
    side = lambda c, k: F.coalesce(F.sum(F.when(F.col("pred") == k, F.col(c))), F.lit(0)).cast("long")
    return counts.groupBy("class_id").agg(
        F.sum("n").cast("long").alias("n"), side("n_neg", 0).alias("tn"), side("n_neg", 1).alias("fp"),
        side("n_pos", 0).alias("fn"), side("n_pos", 1).alias("tp"),
    )


def score_splits(table: DataFrame, n_buckets: int | None = None) -> list[float]:
    """Score bucket boundaries: approximate quantiles of the count table's own
    rows, as many as their number asks for. Compute once and hand on."""
    return quantile_splits(table.where(F.col("p").isNotNull()).select("p"), "p", n_buckets)


def bucketed(table: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """(class_id, p, n_pos, n_neg, _qb): one row per distinct score with a bucket
    monotone in ``p``; ties are one row, so a score held by a third of all rows
    is no hot bucket."""
    ties = table.where(F.col("p").isNotNull()).groupBy("class_id", "p").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")
    )
    return bucketize(ties, "p", score_splits(table) if splits is None else splits, "_qb")


def auc(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """Exact ROC-AUC per class with ties counted one half; NULL when a class lacks positives or negatives.

    Pairs (positive above negative, ties one half) are summed per (class,
    score bucket) from a window INSIDE each bucket; the pairs across buckets
    are bucket positives times the negatives of all lower buckets, a running
    sum over the small (class, bucket) table. No join back to the score rows.
    """
    return auc_of(count_table(long, y=y, p=p, pred=pred))


def auc_of(table: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """:func:`auc` from the count table."""
    counts = bucketed(table, splits)
    w_in = Window.partitionBy("class_id", "_qb").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_neg_before", F.coalesce(F.sum("n_neg").over(w_in), F.lit(0)))
    per_bucket = within.groupBy("class_id", "_qb").agg(
        F.sum(F.col("n_pos").cast("double") * (F.col("_neg_before") + F.lit(0.5) * F.col("n_neg"))).alias("_pairs_in"),
        F.sum("n_pos").alias("_pos"),
        F.sum("n_neg").alias("_neg"),
    )  # ≤ classes x buckets rows
    w_b = Window.partitionBy("class_id").orderBy("_qb").rowsBetween(Window.unboundedPreceding, -1)
    agg = (
        per_bucket.withColumn("_neg_off", F.coalesce(F.sum("_neg").over(w_b), F.lit(0)))
        .groupBy("class_id")
        .agg(
            F.sum(F.col("_pairs_in") + F.col("_pos").cast("double") * F.col("_neg_off")).alias("_pairs"),
            F.sum("_pos").alias("_np"),
            F.sum("_neg").alias("_nn"),
        )
    )
    return agg.select(
        "class_id",
        F.when((F.col("_np") > 0) & (F.col("_nn") > 0), F.col("_pairs") / (F.col("_np") * F.col("_nn")).cast("double"))
        .cast("double")
        .alias("auc"),
    )


def _roc_ranked(table: DataFrame, splits: list[float] | None) -> DataFrame:
    """Distinct scores per class, descending, with running tp/fp counts, the next
    score's counts and the class totals (``_total_rows``, ``tps_total``, ``fps_total``)."""
    return ordered_prefix(
        bucketed(table, splits),
        "p",
        F.col("_qb"),
        partition=("class_id",),
        ascending=False,
        rank="seq",
        sums={"tps": F.col("n_pos"), "fps": F.col("n_neg")},
        leads={"next_pos": F.col("n_pos"), "next_neg": F.col("n_neg")},
        totals=True,
    )


def roc_points(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """ROC curve per class: (class_id, seq, fpr, tpr, threshold).

    One point per distinct score, descending; a point is dropped when both
    running counts stay on a straight line through it (first and last kept,
    only when there are more than two points); the origin (seq 0, threshold
    +inf) is prepended. ``seq`` is the rank of the score, so dropped points
    leave gaps. Rates are NULL when the class has no negatives / positives.
    The origin is emitted by the first point's row: one pass, no union.
    """
    return roc_points_of(count_table(long, y=y, p=p, pred=pred))


def roc_points_of(table: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """:func:`roc_points` from the count table."""
    r = _roc_ranked(table, splits)
    m, tot_pos, tot_neg = F.col("_total_rows"), F.col("tps_total"), F.col("fps_total")
    keep = (
        (m <= 2)
        | (F.col("seq") == 1)
        | (F.col("seq") == m)
        | (F.col("next_pos") != F.col("n_pos"))
        | (F.col("next_neg") != F.col("n_neg"))
    )
    point = F.struct(
        F.col("seq").cast("long").alias("seq"),
        F.try_divide(F.col("fps"), tot_neg).cast("double").alias("fpr"),
        F.try_divide(F.col("tps"), tot_pos).cast("double").alias("tpr"),
        F.col("p").cast("double").alias("threshold"),
    )
    origin = F.struct(
        F.lit(0).cast("long").alias("seq"),
        F.when(tot_neg > 0, F.lit(0.0)).alias("fpr"),
        F.when(tot_pos > 0, F.lit(0.0)).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    pts = F.filter(F.array(F.when(F.col("seq") == 1, origin), F.when(keep, point)), lambda e: e.isNotNull())
    return r.select("class_id", F.inline(pts))


def roc_trapezoid(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """Area under the ROC polyline by the trapezoid rule.

    Collinear points do not change the area, so every distinct score is used;
    the previous point of each is derived from the running counts (no lag).
    """
    return roc_trapezoid_of(count_table(long, y=y, p=p, pred=pred))


def roc_trapezoid_of(table: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """:func:`roc_trapezoid` from the count table."""
    r = _roc_ranked(table, splits)
    # width (fps - prev fps) / N times mean height (tps + prev tps) / (2 P)
    area = F.col("n_neg").cast("double") * (2 * F.col("tps") - F.col("n_pos")).cast("double")
    agg = r.groupBy("class_id").agg(F.sum(area).alias("_a"), F.max("tps_total").alias("_P"), F.max("fps_total").alias("_N"))
    return agg.select(
        "class_id",
        F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_a") / (2.0 * F.col("_P") * F.col("_N")))
        .cast("double")
        .alias("roc_auc"),
    )


def report(long: DataFrame, *, y: str = "y", p: str = "p", pred: str = "pred") -> DataFrame:
    """One metrics row per class: confusion, accuracy, precision, recall, macro F1,
    exact AUC and the area under the ROC polyline (``roc_auc``)."""
    return report_of(count_table(long, y=y, p=p, pred=pred))


def report_of(table: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """:func:`report` from the count table (one row per class in every join)."""
    splits = score_splits(table) if splits is None else splits
    metrics = threshold_metrics(confusion_of(table))
    for area in (auc_of(table, splits), roc_trapezoid_of(table, splits)):
        area = area.withColumnRenamed("class_id", "_c")
        metrics = metrics.join(area, metrics["class_id"].eqNullSafe(area["_c"]), "left").drop("_c")
    return metrics
