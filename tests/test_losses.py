import math

import numpy as np
import pytest

from mmcohort.operators import losses as L


def _long(spark, rows):
    return spark.createDataFrame(rows, "class_id int, y double, z double")


def test_empty_class_defaults(spark):
    lg = _long(spark, [(0, None, 1.0), (0, 2.0, -1.0), (1, 1.0, 0.3)])
    params = L.class_params(spark, [4, 4])
    asl = {r["class_id"]: r["loss"] for r in L.asymmetric(lg, params).collect()}
    assert asl[0] == 0.0
    dp = {r["class_id"]: r["delta_p"] for r in L.delta_p(lg).collect()}
    assert dp[0] == pytest.approx(0.1)
    p = 1 / (1 + math.exp(-0.3))
    assert dp[1] == pytest.approx(p - 0.1)  # no negatives -> 0.1
    w = L.class_weights(lg)
    bce = {r["class_id"]: r["loss"] for r in L.bce(lg, w).collect()}
    assert bce[0] == 0.0
    tot = L.total(L.bce(lg, w), divide_by=12).first()["loss"]
    assert tot == pytest.approx(bce[1] / 12)


def test_gamma_zero_small_p_negative_is_zero(spark):
    z = math.log(0.04 / 0.96)  # p = 0.04 <= clip
    lg = _long(spark, [(0, 0.0, z)])
    assert L.asymmetric(lg, L.class_params(spark, [0])).first()["loss"] == pytest.approx(0.0, abs=1e-15)


def test_clamp_at_p_one(spark):
    lg = _long(spark, [(0, 0.0, 800.0)])  # sigmoid -> 1.0
    got = L.asymmetric(lg, L.class_params(spark, [4])).first()["loss"]
    assert got == pytest.approx(0.95**4 * -math.log(0.05), rel=1e-12)


def test_bce_matches_numpy(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 200)
    y = rng.integers(0, 2, 200).astype(float)
    lg = _long(spark, [(0, float(a), float(b)) for a, b in zip(y, z)])
    w = L.class_weights(lg).first()
    n = 200
    w0, w1 = n / (4 * (y == 0).sum() + 1e-6), n / (4 * (y == 1).sum() + 1e-6)
    assert w["w0"] == pytest.approx(w0) and w["w1"] == pytest.approx(w1)
    term = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    ref = np.mean(np.where(y == 1, w1, w0) * term)
    got = L.bce(lg, L.class_weights(lg)).first()["loss"]
    assert got == pytest.approx(ref, rel=1e-12)


def test_mse_per_modality(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.5, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "x array<double>, xh array<double>")
    got = L.mse(df, {"m": ("x", "xh")}).first()["mse"]
    assert got == pytest.approx((0.25 + 0 + 1 + 1) / 4)


def test_classes_without_rows_and_without_parameters(spark):
    lg = _long(spark, [(0, 1.0, 0.3), (1, 0.0, 0.1)])
    got = {r["class_id"]: r["loss"] for r in L.asymmetric(lg, L.class_params(spark, [4, 4, 4]), classes=range(3)).collect()}
    assert set(got) == {0, 1, 2} and got[2] == 0.0 and got[0] > 0
    bce = {r["class_id"]: r["loss"] for r in L.bce(lg, L.class_weights(lg), classes=range(3)).collect()}
    assert set(bce) == {0, 1, 2} and bce[2] == 0.0
    with pytest.raises(Exception, match="no gamma"):
        L.asymmetric(lg, L.class_params(spark, [4])).collect()
    with pytest.raises(Exception, match="no weights"):
        L.bce(lg, L.class_weights(lg.where("class_id = 0"))).collect()


def test_half_rounds_like_numpy(spark):
    import numpy as np
    from mmcohort.functions.columns import half

    rng = np.random.default_rng(0)
    x = np.concatenate([
        rng.normal(size=2000) * 10.0 ** rng.integers(-9, 6, 2000), 2.0 ** np.arange(-30, 18), -(2.0 ** np.arange(-30, 18)),
        np.nextafter(2.0 ** np.arange(-30, 18), 0), np.nextafter(2.0 ** np.arange(-30, 18), 1e9),
        [0.0, -0.0, 65504.0, 65519.999, 65520.0, -65520.0, 1e300, np.inf, -np.inf, np.nan, 2.0**-25, 3 * 2.0**-25, 1 + 2.0**-11, 1 + 3 * 2.0**-11],
    ])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(len(x), None)], "i long, x double")
    got = {r["i"]: r["h"] for r in df.select("i", half("x").alias("h")).collect()}
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float64)
    assert got[len(x)] is None
    np.testing.assert_array_equal(np.array([got[i] for i in range(len(x))]), want)


def test_a_loss_function_per_class(spark):
    import numpy as np
    import pytest
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, k, float(rng.integers(0, 3)), float(rng.normal())) for i in range(60) for k in range(5)]
    lg = spark.createDataFrame(rows, "study_id long, class_id int, y double, z double").where("class_id <> 4 OR y = 2")
    w = spark.createDataFrame([(k, 0.5 + k, 2.0 * k + 1) for k in range(5)], "class_id int, w0 double, w1 double")
    gam = spark.createDataFrame([(k, float(k)) for k in range(5)], "class_id int, gamma double")
    losses = L.class_losses(w, [0.0, 1.0, 2.0, 3.0, 4.0], (0, 3))
    key = lambda df: {r["class_id"]: r["loss"] for r in df.collect()}
    got, b, a = key(L.mixed(lg, losses, classes=range(5))), key(L.bce(lg, w)), key(L.asymmetric(lg, gam))
    assert got == pytest.approx({0: b[0], 1: a[1], 2: a[2], 3: b[3], 4: 0.0}, abs=1e-12)
    if "hinge" not in L.LOSS_TERMS:
        L.register_loss("hinge", lambda z, y, p: F.greatest(p["margin"] - (2 * y - 1) * z, F.lit(0.0)), margin=1.0)
    got = key(L.mixed(lg, losses | {1: L.ClassLoss("hinge"), 2: L.ClassLoss("hinge", {"margin": 0.5})}))
    for k, margin in ((1, 1.0), (2, 0.5)):
        own = [max(margin - (2 * y - 1) * z, 0) for _, c, y, z in rows if c == k and y != 2]
        assert got[k] == pytest.approx(np.mean(own))
    with pytest.raises(Exception, match="no loss for class 2"):
        L.mixed(lg, {k: v for k, v in losses.items() if k != 2}).collect()
    with pytest.raises(ValueError, match="unknown loss"):
        L.mixed(lg, losses | {0: L.ClassLoss("nothing")})
    with pytest.raises(ValueError, match="lack the parameter"):
        L.mixed(lg, losses | {1: L.ClassLoss("asl")})
