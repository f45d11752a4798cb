import math

import pytest
from pyspark.sql import functions as F

from mmcohort.config import ModalitySpec
from mmcohort.operators import cohort as K

NAN = float("nan")


def _labels(spark, rows, mode="literal"):
    df = spark.createDataFrame(rows, "los double, death int")
    out = K.outcome_labels(df, los="los", death="death", los_mode=mode, mortality_out="mort", los_out="stay", cell_out="cell")
    return [(r["mort"], r["stay"], r["cell"]) for r in out.orderBy(F.col("los").asc_nulls_first(), "death").collect()]


def test_boundary_48_hours(spark):
    assert _labels(spark, [(48.0, 1)]) == [(0.0, 0.0, "dead_ge")]


def test_both_los_modes(spark):
    assert _labels(spark, [(10.0, 1)], "literal") == [(1.0, 1.0, "dead_lt")]
    assert _labels(spark, [(10.0, 1)], "intended") == [(1.0, 0.0, "dead_lt")]
    assert _labels(spark, [(10.0, 0)], "intended") == [(0.0, 1.0, "alive_lt")]


def test_no_cell_gives_null_labels_and_keeps_row(spark):
    got = _labels(spark, [(None, 1), (30.0, None), (30.0, 2)])
    assert len(got) == 3
    assert all(m is None and s is None and c is None for m, s, c in got)


def test_recode_uncertain(spark):
    df = spark.createDataFrame([([-1.0, 1.0, 0.0, None],)], "y array<double>")
    assert K.recode_uncertain(df).first()["y"] == [2.0, 1.0, 0.0, None]


@pytest.mark.parametrize(
    "n_rad,kept_outlier,kept_incomplete",
    [([10.0, -50.0], True, True), ([10.0001, 0.0], False, False), ([NAN, 0.0], True, False), ([None, 0.0], True, False),
     ([0.0, 11.0], False, False), (None, True, False)],
)
def test_outlier_and_incomplete(spark, n_rad, kept_outlier, kept_incomplete):
    df = spark.createDataFrame([(1, n_rad)], "haim_id long, n_rad array<double>")
    a = K.filter_outliers(df, col="n_rad")
    assert (a.count() == 1) is kept_outlier
    b = K.drop_incomplete(a, scalars=["haim_id"], arrays=["n_rad"])
    assert (b.count() == 1) is kept_incomplete


def test_missing_label_inside_array_survives(spark):
    df = spark.createDataFrame([(1, [None, 1.0], [1.0, 2.0])], "haim_id long, y array<double>, n_rad array<double>")
    assert K.drop_incomplete(df, scalars=["haim_id"], arrays=["n_rad"]).count() == 1


def test_prune_strict_and_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, de_0 int, `Lung Opacity` int, vd_0 int")
    out = K.prune(df, names=["Lung Opacity", "Lung Opacity"], prefixes=["de_"])
    assert out.columns == ["a", "vd_0"]
    with pytest.raises(KeyError):
        K.prune(df, names=["nope"])


def test_pack_modalities_checks_width(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "k long, vd_0 double, vd_1 double")
    spec = ModalitySpec(widths={"vd": 2}, stored_order=("vd",), token_order=("vd",), prefixes={"vd": "vd_"})
    assert K.pack_modalities(df, spec, keep=["k"]).first()["vd"] == [1.0, 2.0]
    bad = ModalitySpec(widths={"vd": 3}, stored_order=("vd",), token_order=("vd",), prefixes={"vd": "vd_"})
    with pytest.raises(ValueError):
        K.pack_modalities(df, bad, keep=["k"])


def test_single_label(spark):
    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, None), (4, 0.0)], "k long, lab double")
    assert sorted(r["k"] for r in K.single_label(df, "lab").collect()) == [1, 4]
    assert not math.isnan(K.single_label(df, "lab").first()["y"])


def test_four_cells_partition_the_labelled_rows(spark):
    # U1: the union of the four filtered cells equals the rows with a label, each once
    rows = [(None if h is None else float(h), d) for h in (1, 47, 48, 60, None) for d in (0, 1, None)]
    df = spark.createDataFrame(rows, "los double, death int")
    lab = K.outcome_labels(df, los="los", death="death", cell_out="cell")
    cells = [lab.where(F.col("cell") == c) for c in ("dead_lt", "alive_ge", "dead_ge", "alive_lt")]
    union = cells[0]
    for c in cells[1:]:
        union = union.unionByName(c)
    labelled = lab.where(F.col("48-hour Mortality").isNotNull())
    assert union.count() == labelled.count() == 8
    assert union.exceptAll(labelled).count() == 0 and labelled.exceptAll(union).count() == 0
