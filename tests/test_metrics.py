import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmcohort.operators import metrics as M
from mmcohort.operators.prefix import bucketize, ordered_prefix, quantile_splits


def _long(spark, y, p, cls=0):
    rows = [(cls, None if yy is None else float(yy), float(pp)) for yy, pp in zip(y, p)]
    df = spark.createDataFrame(rows, "class_id int, y double, p double")
    return df.withColumn("pred", F.when(F.col("p") > 0.5, 1).otherwise(0))


def np_roc(y, p):
    """Reference ROC: one point per distinct score (descending), collinear points dropped, origin first."""
    order = np.argsort(-p, kind="mergesort")
    ys, ps = y[order], p[order]
    idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    thr = ps[idx]
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return np.r_[0, fps] / fps[-1], np.r_[0, tps] / tps[-1], np.r_[np.inf, thr]


def np_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    lg = _long(spark, [1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1])
    assert M.auc(lg).first()["auc"] == pytest.approx(0.875)


def test_half_prediction_is_zero(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0)], "class_id int, y double, z double")
    assert M.predict(df).first()["pred"] == 0


def test_never_predicted_precision_zero_and_one_class_auc_null(spark):
    lg = _long(spark, [0, 0, 0], [0.1, 0.2, 0.3])
    rep = M.report(lg).first()
    assert rep["precision"] == 0.0 and rep["recall"] == 0.0
    assert rep["auc"] is None
    assert rep["f1_macro"] == 1.0  # only label 0 seen, predicted perfectly
    assert (rep["tn"], rep["fp"], rep["fn"], rep["tp"]) == (3, 0, 0, 0)


def test_masked_labels_ignored(spark):
    lg = _long(spark, [1, 0, None, 2], [0.9, 0.1, 0.5, 0.7])
    rep = M.report(lg).first()
    assert rep["n"] == 2 and rep["accuracy"] == 1.0 and rep["auc"] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_roc_and_auc_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    y = rng.integers(0, 2, n)
    # saturated and tied scores on purpose
    z = np.where(rng.random(n) < 0.3, 40.0, rng.normal(0, 2, n)).round(2)
    p = 1 / (1 + np.exp(-z))
    lg = _long(spark, y, p)
    fpr, tpr, thr = np_roc(y.astype(float), p)
    pts = sorted((r["seq"], r["fpr"], r["tpr"], r["threshold"]) for r in M.roc_points(lg).collect())
    assert len(pts) == len(fpr)
    for (s, a, b, t), e1, e2, e3 in zip(pts, fpr, tpr, thr):
        assert a == pytest.approx(e1) and b == pytest.approx(e2)
        assert (t == e3) or (math.isinf(t) and math.isinf(e3))
    a = M.auc(lg).first()["auc"]
    assert a == pytest.approx(np_auc(y, p), rel=1e-12)
    assert M.roc_trapezoid(lg).first()["roc_auc"] == pytest.approx(a, rel=1e-12)
    neg = lg.withColumn("p", 1 - F.col("p"))
    assert M.auc(neg).first()["auc"] == pytest.approx(1 - a, rel=1e-9)


def test_f1_macro_matches_definition(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    p = rng.random(500)
    pred = (p > 0.5).astype(int)
    f = []
    for lab in (0, 1):
        tp = ((pred == lab) & (y == lab)).sum()
        fp = ((pred == lab) & (y != lab)).sum()
        fn = ((pred != lab) & (y == lab)).sum()
        f.append(2 * tp / (2 * tp + fp + fn))
    got = M.report(_long(spark, y, p)).first()["f1_macro"]
    assert got == pytest.approx(np.mean(f))


def test_prefix_matches_global_window_and_ignores_partitioning(spark):
    rng = np.random.default_rng(5)
    p = np.r_[rng.random(1500), 1 - 10.0 ** -rng.uniform(3, 15, 500), 10.0 ** -rng.uniform(3, 15, 500)]
    df = spark.createDataFrame([(float(x),) for x in np.unique(p)], "p double")
    from pyspark.sql import Window

    ref = {r["p"]: r["rk"] for r in df.select("p", F.row_number().over(Window.orderBy("p")).alias("rk")).collect()}
    for n in (1, 7, 64):
        d = bucketize(df.repartition(n), "p", quantile_splits(df, "p", 64), "_b")
        out = ordered_prefix(d, "p", F.col("_b"), rank="rk", sums={"c": F.lit(1)})
        got = {r["p"]: (r["rk"], r["c"]) for r in out.collect()}
        assert all(got[k] == (v, v) for k, v in ref.items())


def np_auc(y, p):
    """Mann-Whitney AUC with ties counted one half."""
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_concentrated_scores_spread_over_buckets(spark):
    # 6,000 distinct scores inside [0.5, 0.5006) plus one score held by a third of all rows
    n = 6000
    p = np.r_[0.5 + np.arange(n) * 1e-7, np.full(n // 2, 0.3)]
    y = np.r_[np.arange(n) % 3 == 0, np.arange(n // 2) % 2 == 0].astype(float)
    long = _long(spark, y, p)
    table = M.count_table(long)
    counts = M.bucketed(table, M.score_splits(table, 64))
    sizes = [r["c"] for r in counts.groupBy("class_id", "_qb").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert max(sizes) <= 4 * (n + 1) / 64  # a fixed grid on [0, 1] would put all 6,000 in one bucket
    assert M.auc(long).first()["auc"] == pytest.approx(np_auc(y, p), abs=1e-12)


def test_report_and_roc_ignore_partitioning(spark):
    rng = np.random.default_rng(11)
    n = 2000
    y = rng.integers(0, 2, n).astype(float)
    p = (1 / (1 + np.exp(-rng.normal(0, 2, n)))).round(3)  # many ties
    rows = [(int(i % 3), float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    base = spark.createDataFrame(rows, "class_id int, y double, p double").withColumn("pred", (F.col("p") > 0.5).cast("int"))

    def snap(df):
        rep = sorted(tuple(r) for r in M.report(df).collect())
        roc = sorted(tuple(r) for r in M.roc_points(df).collect())
        return rep, roc

    ref = snap(base)
    for k in (1, 7, 64):
        got = snap(base.repartition(k))
        assert got[1] == ref[1]
        for a, b in zip(got[0], ref[0]):
            assert a[:-2] == b[:-2] and a[-2:] == pytest.approx(b[-2:], rel=1e-12)


def test_a_labelled_row_without_score_fails(spark):
    rows = [(0, 1.0, None), (0, 0.0, 0.2)]
    lg = spark.createDataFrame(rows, "class_id int, y double, p double").withColumn("pred", F.lit(1))
    with pytest.raises(Exception, match="no score"):
        M.report(lg).collect()


def test_null_class_is_a_class(spark):
    lg = _long(spark, [1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1]).withColumn("class_id", F.lit(None).cast("int"))
    rep = M.report(lg).first()
    assert rep["class_id"] is None and rep["auc"] == pytest.approx(0.875) == rep["roc_auc"]
    assert M.roc_points(lg).count() == 4


def test_bucket_count_follows_the_rows():
    from mmcohort.operators import prefix as P

    assert P.bucket_count(0) == 1 and P.bucket_count(10 * P.ROWS_PER_BUCKET) == 10
    assert 16 ** P.hex_digits(300 * P.ROWS_PER_BUCKET) >= 300


def test_prefix_keeps_null_keys_and_partitions(spark):
    rows = [(k, p) for p in ("a", None, "b") for k in [None, *range(40)]]
    df = spark.createDataFrame(rows, "k int, p string")
    d = bucketize(df, "k", quantile_splits(df, "k", 8), "_b")
    for asc in (True, False):
        out = ordered_prefix(d, "k", F.col("_b"), partition=("p",), rank="rk", ascending=asc, totals=True).collect()
        assert len(out) == len(rows)
        for r in out:
            first = 1 if asc else 41
            want = first if r["k"] is None else (r["k"] + 2 if asc else 40 - r["k"])
            assert r["rk"] == want and r["_total_rows"] == 41
