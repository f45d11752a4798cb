import numpy as np
import pytest

from mmcohort.operators import fit as FT
from mmcohort.sources import fixtures as fx


def _problem(seed=0):
    rng = np.random.default_rng(seed)
    mods = ["a", "b"]
    d = {"a": 5, "b": 3}
    lat = 3
    X = {m: rng.normal(size=(40, d[m])) for m in mods}
    Y = rng.integers(0, 2, size=(40, 4)).astype(float)
    Y[rng.random((40, 4)) < 0.2] = np.nan
    Y[rng.random((40, 4)) < 0.1] = 2.0
    params = {m: {"W": rng.normal(size=(lat, d[m])) * 0.5, "b": rng.normal(size=lat) * 0.1,
                  "V": rng.normal(size=(d[m], lat)) * 0.5, "c": rng.normal(size=d[m]) * 0.1} for m in mods}
    head = rng.normal(size=(4, lat * len(mods)))
    gam = np.array([4.0, 0.0, 2.0, 4.0])
    valid = ~np.isnan(Y) & (Y != 2)
    return X, Y, params, head, mods, gam, valid.sum(axis=0).astype(float), 40.0


def _total(X, Y, params, head, mods, gam, nv, n):
    L, mse, _ = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n)
    return L + 0.1 * sum(mse.values())


def test_gradient_matches_finite_differences():
    X, Y, params, head, mods, gam, nv, n = _problem()
    _, _, g = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n)
    h = 1e-6
    for m in mods:
        for k in FT.PARAM_NAMES:
            flat = params[m][k].ravel()
            for idx in range(min(flat.size, 6)):
                old = flat[idx]
                flat[idx] = old + h
                up = _total(X, Y, params, head, mods, gam, nv, n)
                flat[idx] = old - h
                dn = _total(X, Y, params, head, mods, gam, nv, n)
                flat[idx] = old
                num = (up - dn) / (2 * h)
                assert g[m][k].ravel()[idx] == pytest.approx(num, rel=1e-4, abs=1e-7)


def test_partition_sums_equal_full_batch():
    X, Y, params, head, mods, gam, nv, n = _problem(1)
    L, mse, g = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n)
    parts = [slice(0, 13), slice(13, 40)]
    acc = None
    Ls = 0.0
    for s in parts:
        l, _, gg = FT.loss_and_grad({m: X[m][s] for m in mods}, Y[s], params, head, mods, gam, nv, n)
        Ls += l
        flat = FT._flatten(gg, mods)
        acc = flat if acc is None else acc + flat
    assert Ls == pytest.approx(L)
    assert np.allclose(acc, FT._flatten(g, mods))


def test_fit_on_spark_lowers_loss(spark):
    from pyspark.sql import functions as F

    from mmcohort import config as C
    from mmcohort.plans import training as TR
    from mmcohort.session import materialize

    ms = TR.modal_split(spark, "/root/testdata/sf0.001").where(F.col("split") == "train")
    tr = materialize(ms.select("y", *[F.col(m).cast("array<double>").alias(m) for m in C.STORED_ORDER]), "fit-train")
    head = fx.vocab_matrix(len(C.TOKEN_ORDER) * 4, C.VOCAB_POSITIONS)
    _, hist = FT.fit_projectors(tr, FT.params_from_weights(TR.fixture_weights(spark)), head, steps=3)
    assert [h["step"] for h in hist] == sorted(h["step"] for h in hist) and len(hist) == 3
    assert hist[-1]["loss"] < hist[0]["loss"]


def test_validate_equals_numpy_and_train_writes_sinks(spark):
    from pyspark.sql import functions as F

    from mmcohort import config as C
    from mmcohort import pipeline as PL
    from mmcohort.operators import scoring as SC
    from mmcohort.plans import training as TR
    from mmcohort.session import scratch_path
    from mmcohort.sources import io

    sf = "/root/testdata/sf0.001"
    mods = list(C.TOKEN_ORDER)
    head = fx.vocab_matrix(len(mods) * 4, C.VOCAB_POSITIONS)
    ms = TR.modal_split(spark, sf)
    hist, wp = scratch_path(spark, "h"), scratch_path(spark, "w")
    params, history = PL.train(ms, TR.fixture_weights(spark), head, C.FIXTURE_SPEC, run="t", epochs=2, history_path=hist, weights_path=wp)
    assert [(h["epoch"], h["split"]) for h in history] == [(1, "train"), (1, "val"), (2, "train"), (2, "val")]
    back = io.read_history(spark, hist).collect()
    assert len(back) == 4 and all(len(r["delta_p"]) == 12 for r in back)
    w = SC.ProjectorWeights.from_table(io.read_weights(spark, wp))
    assert np.allclose(w.mats["vd"]["W"], params["vd"]["W"], atol=1e-6)  # last epoch, float32 table

    # validation of the final parameters: Spark aggregations == NumPy formulas
    val = ms.where(F.col("split") == "val").collect()
    X = {m: np.asarray([r[m] for r in val], dtype=np.float64) for m in mods}
    Y = np.asarray([[np.nan if v is None else v for v in r["y"]] for r in val], dtype=np.float64)
    valid = ~np.isnan(Y) & (Y != 2)
    gam = np.asarray(C.GAMMAS_JOINT, dtype=np.float64)
    L, mse, _, sums = FT.loss_and_grad(X, Y, params, head, mods, gam, valid.sum(axis=0).astype(float), float(len(val)), dp_sums=True)
    v = PL.validate(ms.where(F.col("split") == "val"), params, head, mods, by="row")
    assert v["asl"] == pytest.approx(L, rel=1e-9)
    assert v["loss"] == pytest.approx(L + 0.1 * sum(mse.values()), rel=1e-9)
    assert np.allclose(v["delta_p"], FT.delta_p_from_sums(sums, 12), atol=1e-12)

    # the default: unweighted mean over 32-row batches in key order
    order = np.argsort([r["study_id"] for r in val])
    per = []
    for lo in range(0, len(val), 32):
        rows = order[lo : lo + 32]
        Xb, Yb = {m: X[m][rows] for m in mods}, Y[rows]
        nv = (~np.isnan(Yb) & (Yb != 2)).sum(axis=0).astype(float)
        Lb, mb, _ = FT.loss_and_grad(Xb, Yb, params, head, mods, gam, nv, float(len(rows)))
        per.append(Lb + 0.1 * sum(mb.values()))
    v = PL.validate(ms.where(F.col("split") == "val"), params, head, mods, key="study_id")
    assert v["loss"] == pytest.approx(np.mean(per), rel=1e-9)
    empty = PL.validate(ms.where("false"), params, head, mods, key="study_id")
    assert empty["loss"] is None and empty["asl"] is None
    with pytest.raises(ValueError):
        PL.validate(ms, params, head, mods)


def test_bce_gradient_matches_finite_differences():
    X, Y, params, head, mods, gam, nv, n = _problem(3)
    cw = np.array([[0.7, 1.9], [1.1, 0.4], [0.5, 2.5], [1.0, 1.0]])

    def tot():
        L, mse, _ = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n, loss="bce", class_w=cw)
        return L + 0.1 * sum(mse.values())

    _, _, g = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n, loss="bce", class_w=cw)
    h = 1e-6
    for m in mods:
        for k in FT.PARAM_NAMES:
            flat = params[m][k].ravel()
            for idx in range(min(flat.size, 4)):
                old = flat[idx]
                flat[idx] = old + h
                up = tot()
                flat[idx] = old - h
                dn = tot()
                flat[idx] = old
                assert g[m][k].ravel()[idx] == pytest.approx((up - dn) / (2 * h), rel=1e-4, abs=1e-7)


def test_bce_training_loop_validation_equals_numpy(spark):
    from pyspark.sql import functions as F

    from mmcohort import config as C
    from mmcohort import pipeline as PL
    from mmcohort.operators import losses as L
    from mmcohort.operators import scoring as SC
    from mmcohort.plans import training as TR

    sf = "/root/testdata/sf0.001"
    mods = list(C.TOKEN_ORDER)
    head = fx.vocab_matrix(len(mods) * 4, C.VOCAB_POSITIONS)
    ms = TR.modal_split(spark, sf)
    params, history = PL.train(ms, TR.fixture_weights(spark), head, C.FIXTURE_SPEC, run="b", epochs=1, loss="bce")
    assert [h["split"] for h in history] == ["train", "val"]
    tr = ms.where(F.col("split") == "train")
    cw_rows = L.class_weights(L.to_long(tr, keep=(), y="y", z="y")).collect()
    cw = np.zeros((12, 2))
    for r in cw_rows:
        cw[r["class_id"]] = (r["w0"], r["w1"])
    val = ms.where(F.col("split") == "val").collect()
    X = {m: np.asarray([r[m] for r in val], dtype=np.float64) for m in mods}
    Y = np.asarray([[np.nan if v is None else v for v in r["y"]] for r in val], dtype=np.float64)
    valid = ~np.isnan(Y) & (Y != 2)
    Lv, mse, _ = FT.loss_and_grad(X, Y, params, head, mods, np.zeros(12), valid.sum(axis=0).astype(float), float(len(val)),
                                  loss="bce", class_w=cw)
    cw_df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cw)], "class_id int, w0 double, w1 double")
    v = PL.validate(ms.where(F.col("split") == "val"), params, head, mods, by="row", loss="bce", class_w=cw_df)
    assert v["loss"] == pytest.approx(Lv + 0.1 * sum(mse.values()), rel=1e-9)
    v = PL.validate(ms.where(F.col("split") == "val"), params, head, mods, key="haim_id", loss="bce", class_w=cw_df)
    assert history[1]["loss"] == pytest.approx(v["loss"], rel=1e-9)


def test_isolated_gradient_matches_finite_differences():
    X, Y, params, head, mods, gam, nv, n = _problem(4)

    def tot():
        L, mse, _ = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n, isolated=True)
        return L + 0.1 * sum(mse.values())

    L, _, g = FT.loss_and_grad(X, Y, params, head, mods, gam, nv, n, isolated=True)
    # the isolated loss is the sum of each modality's own asymmetric loss
    lat = params[mods[0]]["W"].shape[0]
    own = 0.0
    for m in mods:
        H = np.maximum(X[m] @ params[m]["W"].T + params[m]["b"], 0.0)
        valid = ~np.isnan(Y) & (Y != 2)
        inv = np.where(nv > 0, 1 / np.maximum(nv, 1), 0)[None, :]
        own += FT._asl(H @ head[:, :lat].T, np.where(valid, Y, 0.0), valid, inv, gam[None, :], 0.05, 1e-6)[0]
    assert L == pytest.approx(own)
    h = 1e-6
    for m in mods:
        for k in FT.PARAM_NAMES:
            flat = params[m][k].ravel()
            for idx in range(min(flat.size, 4)):
                old = flat[idx]
                flat[idx] = old + h
                up = tot()
                flat[idx] = old - h
                dn = tot()
                flat[idx] = old
                assert g[m][k].ravel()[idx] == pytest.approx((up - dn) / (2 * h), rel=1e-4, abs=1e-7)
