"""The evaluation and training scripts end to end from a study-shaped CSV.

The CSV is derived from the driver's ``embeddings`` table: real column names
(ids, stay, death flag, ten findings, prefixed feature columns of the fixture
widths), written with a header and read back with the schema from the header.
"""

import numpy as np
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort import pipeline as PL
from mmcohort.operators import scoring as SC
from mmcohort.session import scratch_path
from mmcohort.sources import fixtures as fx
from mmcohort.sources import io

SF = "/root/testdata/sf0.001"


def _study_csv(spark):
    e = fx.table(spark, SF, "embeddings")
    lab = F.col("label")
    cols = [
        (F.col("vec_id") % 50).alias("haim_id"),
        F.when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise((F.col("vec_id") % 97).cast("double")).alias("img_length_of_stay"),
        (F.col("vec_id") % 2).cast("int").alias("death_status"),
        *[F.lit("x").alias(c) for c in io.TEXT_COLUMNS],
        *[F.lit(0.0).alias(c) for c in ("No Finding", "Pleural Effusion", "Pleural Other", "Support Devices")],
    ]
    for k, name in enumerate(C.FINDING_COLUMNS):
        cols.append(
            F.when(lab == k, 1.0).when(lab == (k + 1) % 10, -1.0).when(lab == (k + 2) % 10, F.lit(None)).otherwise(0.0)
            .cast("double").alias(name)
        )
    pos = 0
    for m in C.STORED_ORDER:
        for i in range(C.FIXTURE_SPEC.widths[m]):
            cols.append(F.col("embedding")[pos].cast("double").alias(f"{C.MODALITY_PREFIX[m]}{i}"))
            pos += 1
    path = scratch_path(spark, "study-csv")
    io.write_wide_csv(e.select(*cols), path)
    return path


def test_evaluation_and_training_scripts(spark):
    csv = _study_csv(spark)
    wpath = scratch_path(spark, "init-weights")
    io.write_weights(SC.rule_weights(spark, C.FIXTURE_SPEC, 4), wpath)
    scorer = SC.class_logits_from_vocab(fx.linear_vocab_model(len(C.TOKEN_ORDER) * 4))
    metrics, roc = PL.run_evaluation(spark, csv, wpath, scorer, scratch_path(spark, "results"), spec=C.FIXTURE_SPEC)
    m = {r["class_id"]: r for r in metrics.collect()}
    assert sorted(m) == list(range(12))
    assert all(r["n"] == r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in m.values())
    assert roc.where(F.col("seq") == 0).count() == roc.select("class_id").distinct().count()

    head = fx.vocab_matrix(len(C.TOKEN_ORDER) * 4, C.VOCAB_POSITIONS)
    for variant in ("bce", "asym", "iso"):
        hist, wout = scratch_path(spark, "hist"), scratch_path(spark, "wout")
        params, history = PL.run_training(
            spark, csv, wpath, head, run=variant, epochs=1, history_path=hist, weights_path=wout,
            spec=C.FIXTURE_SPEC, variant=variant,
        )
        assert [h["split"] for h in history] == ["train", "val"] and all(np.isfinite(h["loss"]) for h in history)
        assert io.read_history(spark, hist).count() == 2
        assert io.read_weights(spark, wout).count() == sum(
            4 + C.FIXTURE_SPEC.widths[mm] for mm in C.TOKEN_ORDER
        )


def test_single_label_and_source_members(spark):
    """The modes of the pipeline: one label only; the source's own patients."""
    csv = _study_csv(spark)
    wpath = scratch_path(spark, "init-weights")
    io.write_weights(SC.rule_weights(spark, C.FIXTURE_SPEC, 4), wpath)
    scorer = SC.class_logits_from_vocab(fx.linear_vocab_model(len(C.TOKEN_ORDER) * 4))
    wide = io.read_study_csv(spark, csv, position=PL.POSITION)
    k = C.CLASS_NAMES.index("Pneumonia")
    metrics, _ = PL.run_evaluation(
        spark, csv, wpath, scorer, scratch_path(spark, "results"), spec=C.FIXTURE_SPEC, label="Pneumonia", members="source"
    )
    n = {r["class_id"]: r["n"] for r in metrics.collect()}
    assert n[k] > 0 and all(v == 0 for c, v in n.items() if c != k)
    scaled, _ = PL.prepare_study(wide, C.FIXTURE_SPEC, label="Pneumonia", members="source", position=PL.POSITION)
    rows = scaled.select("haim_id", "split", F.get("y", F.lit(k)).alias("y")).collect()
    assert len(rows) == wide.where("Pneumonia in (0, 1)").count() and {r["y"] for r in rows} == {0.0, 1.0}
    assert n[k] == sum(r["split"] == "val" for r in rows)
    # the whole study, by NumPy and pandas: order of first appearance after the filters, seeded permutation
    both, _ = PL.prepare_study(wide, C.FIXTURE_SPEC, members="source", position=PL.POSITION)
    assert PL.POSITION not in both.columns and dict(both.dtypes)["vd"] == "array<float>"
    kept = wide.where("haim_id is not null").select("haim_id", PL.POSITION).orderBy(PL.POSITION).collect()
    ids = list(dict.fromkeys(r["haim_id"] for r in kept))
    val = {ids[j] for j in np.random.RandomState(C.SPLIT_SEED).permutation(len(ids))[: -(-len(ids) // 4)]}
    assert {r["haim_id"] for r in both.where("split = 'val'").select("haim_id").distinct().collect()} == val
    plain, _ = PL.prepare_study(wide, C.FIXTURE_SPEC, position=PL.POSITION)
    assert plain.columns == both.columns and plain.count() == both.count()


def test_runs_and_parts_are_kept_and_merged(spark):
    """Two scoring runs, one repeated, evaluate as one; statistics of two parts are those of all rows."""
    from mmcohort.operators import scaling as S

    scaled, stats = PL.prepare_study(io.read_study_csv(spark, _study_csv(spark)), C.FIXTURE_SPEC)
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4))
    scorer = SC.class_logits_from_vocab(fx.linear_vocab_model(len(C.TOKEN_ORDER) * 4))
    path, odd = scratch_path(spark, "runs"), F.col("haim_id") % 2 == 1
    for run, rows in (("odd", odd), ("even", ~odd), ("odd", odd)):
        PL.keep_scores(scaled.where(rows), w, scorer, C.FIXTURE_SPEC, path, run)
    key = lambda df: sorted(map(str, df.collect()))
    whole = PL.evaluate(PL.score_split(scaled, w, scorer, C.FIXTURE_SPEC))
    kept = PL.evaluate_kept(spark, path)
    assert key(kept[0]) == key(whole[0]) and key(kept[1]) == key(whole[1])
    only = PL.evaluate_kept(spark, path, runs=["odd"])[0].agg(F.sum("n")).first()[0]
    assert 0 < only < whole[0].agg(F.sum("n")).first()[0]
    states = scratch_path(spark, "stats")
    train = scaled.where("split = 'train'")
    for part, rows in (("a", odd), ("b", ~odd)):
        PL.keep_stats(train.where(rows), C.FIXTURE_SPEC, states, part)
    got, want = PL.kept_stats(spark, C.FIXTURE_SPEC, states).first(), S.fit_stats(train, C.STORED_ORDER, C.FIXTURE_SPEC.widths).first()
    assert got["n"] == want["n"]
    for m in C.STORED_ORDER:
        assert np.allclose(got[f"{m}__mean"], want[f"{m}__mean"], atol=1e-12) and np.allclose(got[f"{m}__std"], want[f"{m}__std"], rtol=1e-9)


def test_unlisted_or_absent_columns_raise(spark):
    import pytest
    from mmcohort.operators import cohort as K

    wide = io.read_study_csv(spark, _study_csv(spark))
    assert K.prepare(wide, C.FIXTURE_SPEC).columns == ["haim_id", "y", *C.STORED_ORDER]
    with pytest.raises(ValueError, match="no modality"):
        K.prepare(wide.withColumn("surprise", F.lit(1.0)), C.FIXTURE_SPEC)
    with pytest.raises(KeyError, match="img_id"):
        K.prepare(wide.drop("img_id"), C.FIXTURE_SPEC)


def test_csv_columns_go_by_name_and_flags_may_be_fractions(spark):
    import pytest

    path = scratch_path(spark, "csv")
    a = spark.createDataFrame([(1, 1, 2.0, "x,y")], "haim_id long, death_status int, vd_0 double, split string")
    io.write_wide_csv(a, f"{path}/a")
    io.write_wide_csv(a.selectExpr("vd_0 + 1 AS vd_0", "split", "CAST(NULL AS DOUBLE) AS death_status", "haim_id + 1 AS haim_id"), f"{path}/b")
    io.write_wide_csv(a.selectExpr("haim_id + 2 AS haim_id", "CAST(death_status AS DOUBLE) AS death_status", "vd_0 + 2 AS vd_0", "split"), f"{path}/c")
    got = sorted((r["haim_id"], r["death_status"], r["vd_0"], r["split"]) for r in io.read_study_csv(spark, path).collect())
    assert got == [(1, 1, 2.0, "x,y"), (2, None, 3.0, "x,y"), (3, 1, 4.0, "x,y")]
    io.write_wide_csv(a.selectExpr("haim_id", "0.5 AS death_status", "vd_0", "split"), f"{path}/d")
    with pytest.raises(Exception, match="not an integer"):
        io.read_study_csv(spark, path).collect()
    io.write_wide_csv(a.drop("vd_0"), f"{path}/e")
    with pytest.raises(Exception):
        io.read_study_csv(spark, path)
