"""Safe sinks (snapshots, replaced epochs) and states that merge (statistics, count tables)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mmcohort.operators import metrics as M
from mmcohort.operators import scaling as S
from mmcohort.operators import scoring as SC
from mmcohort import config as C
from mmcohort.session import scratch_path
from mmcohort.sources import io


def test_an_aborted_save_leaves_the_former_weights(spark):
    path = scratch_path(spark, "weights")
    first = SC.rule_weights(spark, C.FIXTURE_SPEC, 4, 0.5)
    io.write_weights(first, path)
    names = io.committed(spark, path)
    # a writer that dies among its files, and one that dies before its marker
    with pytest.raises(Exception, match="torn"):
        io.write_weights(first.withColumn("b", F.when(F.col("out_idx") > 2, F.raise_error(F.lit("torn"))).otherwise(F.col("b"))), path)
    first.select("modality", "layer", "out_idx", (F.col("b") + 9).alias("b"), "w").write.parquet(f"{path}/v000000002-dead")
    assert io.committed(spark, path) == names
    read = lambda: sorted(map(tuple, io.read_weights(spark, path).select("modality", "layer", "out_idx", "b").collect()))
    assert read() == sorted(map(tuple, first.select("modality", "layer", "out_idx", "b").collect()))
    for factor in (1.0, 2.0, 3.0):
        io.write_weights(SC.rule_weights(spark, C.FIXTURE_SPEC, 4, factor), path)
    assert len(io.committed(spark, path)) == io.SNAPSHOTS_KEPT
    assert read() == sorted(map(tuple, SC.rule_weights(spark, C.FIXTURE_SPEC, 4, 3.0).select("modality", "layer", "out_idx", "b").collect()))
    only = scratch_path(spark, "weights")
    first.write.parquet(f"{only}/v000000001-dead")
    with pytest.raises(ValueError, match="no committed"):
        io.read_weights(spark, only)
    plain = scratch_path(spark, "weights")
    first.write.parquet(plain)
    assert io.read_weights(spark, plain).count() == first.count()


def test_a_repeated_epoch_replaces_its_rows(spark):
    path = scratch_path(spark, "history")
    rows = lambda run, e, x: spark.createDataFrame([(run, e, s, x, [x]) for s in ("train", "val")], "run string, epoch int, split string, loss double, delta_p array<double>")
    for run, e, x in (("1", 1, 1.0), ("1", 2, 2.0), ("b", 1, 7.0), ("1", 2, 3.0), ("1", 2, 3.0)):
        io.write_history(rows(run, e, x), path)
    got = sorted((r["run"], r["epoch"], r["split"], r["loss"]) for r in io.read_history(spark, path).collect())
    assert got == sorted((r, e, s, x) for r, e, x in (("1", 1, 1.0), ("1", 2, 3.0), ("b", 1, 7.0)) for s in ("train", "val"))


def test_merged_statistics_equal_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (500, 4))
    x[:, 2] = 5.0
    df = spark.createDataFrame([(i % 7, v.tolist()) for i, v in enumerate(x)], "f int, v array<double>").repartition(5)
    states = S.partial_stats(df, ["v"], {"v": 4}, by=["f"], groups=3)
    assert sorted(r["n"] for r in states.collect()) == sorted(int((np.arange(500) % 7 == k).sum()) for k in range(7))
    row = S.merge_stats(states, ["v"], {"v": 4}).first()
    assert np.allclose(row["v__mean"], x.mean(0), rtol=1e-12) and row["n"] == 500
    assert np.allclose(row["v__std"], x.std(0, ddof=1), rtol=1e-8, atol=0) or row["v__std"][2] == 0.0
    one = S.merge_stats(states.where("f = 0").limit(0), ["v"], {"v": 4})
    assert one.first() is None
    single = spark.createDataFrame([([1.0],)], "v array<double>")
    assert S.merge_stats(S.partial_stats(single, ["v"], {"v": 1}), ["v"], {"v": 1}).first()["v__std"] is None


def test_merged_counts_look_at_no_score_again(spark):
    rows = spark.range(400).select(
        F.lit(0).alias("class_id"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 11 / 11).alias("p"),
        (F.col("id") % 11 > 5).cast("int").alias("pred"), "id",
    )
    path = scratch_path(spark, "state")
    for run in range(3):
        io.put_state(M.score_counts(rows.where(F.col("id") % 3 == run)), path, run=f"r{run}")
    merged = M.merge_counts(io.read_state(spark, path, M.COUNTS_SCHEMA, ["run"]))
    whole = M.count_table(rows)
    key = lambda df: sorted(map(str, df.select("class_id", "p", "pred", "n", "n_pos", "n_neg").collect()))
    assert key(merged) == key(whole)
    assert M.report_of(merged).first() == M.report_of(whole).first()


def test_a_cell_with_the_marker_is_no_header(spark):
    import os

    path = scratch_path(spark, "csv").replace("file:", "")
    os.makedirs(path)
    for name, text in (("a.csv", 'haim_id,"x, y"\n1,haim_id\n2,b\n'), ("b.csv", '\n"x, y",haim_id\nhaim_id,3\n'), ("empty.csv", "")):
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    heads = io.csv_headers(spark, path, "haim_id")
    assert [h[0] for h in heads] == [["haim_id", "x, y"], ["x, y", "haim_id"]]
    got = sorted((r["haim_id"], r["x, y"]) for r in io.read_study_csv(spark, path, strings=("x, y",)).collect())
    assert got == [(1, "haim_id"), (2, "b"), (3, "haim_id")]
    with open(f"{path}/c.csv", "w") as f:
        f.write("other,x\nhaim_id,1\n")
    with pytest.raises(ValueError, match="no column"):
        io.csv_headers(spark, path, "haim_id")


def test_headers_are_read_without_the_rest(spark):
    """One partition a file; the session's settings hold again afterwards."""
    path = scratch_path(spark, "csv")
    spark.range(400_000).selectExpr("id AS haim_id", "repeat('x', 200) AS t").repartition(2).write.option("header", True).csv(path)
    index = io.header_index(spark, path).collect()
    assert len(index) == 1 and index[0]["value"] == "haim_id,t" and len(index[0]["files"]) == 2
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(io._UNSPLIT)


def test_a_file_is_left_after_its_first_line():
    taken = []

    def lines():
        for x in ("", "  ", "h", "1", "2"):
            taken.append(x)
            yield (x,)

    assert list(io._first_line(lines())) == [("h",)] and taken == ["", "  ", "h"]
    assert list(io._first_line(iter([]))) == []


def test_blocked_projection_equals_numpy(spark):
    rng = np.random.default_rng(3)
    widths, latent = {"a": 7, "b": 3}, 5
    rows = [(i, rng.normal(size=7).tolist(), rng.normal(size=3).tolist()) for i in range(40)]
    w = {m: (rng.normal(size=(latent, d)).astype(np.float32), rng.normal(size=latent).astype(np.float32)) for m, d in widths.items()}
    table = spark.createDataFrame(
        [(m, "enc", i, W[i].tolist(), float(b[i])) for m, (W, b) in w.items() for i in range(latent)], SC.WEIGHTS_SCHEMA
    )
    df = spark.createDataFrame(rows, "k long, a array<float>, b array<float>")
    want = {
        r[0]: [np.maximum(np.float32(r[1 + j]).astype(float) @ w[m][0].T.astype(float) + w[m][1], 0) for j, m in enumerate("ab")] for r in rows
    }
    for limit in (1, 4, 20, 1000):
        got = SC.encode_blocked(df, table, widths, ["a", "b"], key="k", block_values=limit).collect()
        assert len(got) == 40
        assert all(np.allclose(r["code_a"], want[r["k"]][0]) and np.allclose(r["code_b"], want[r["k"]][1]) for r in got)
    assert SC.encode_blocked(df.where("false"), table, widths, ["a", "b"], key="k").collect() == []
    with pytest.raises(ValueError, match="encode_blocked"):
        SC.ProjectorWeights.from_table(table, max_values=10)


def test_settled_keeps_the_result_only(spark):
    import os

    from mmcohort.session import ensure_checkpoint_dir, materialize, settled

    base = ensure_checkpoint_dir(spark).replace("file:", "") + "/mmcohort"
    found = lambda name: [f for f in os.listdir(base) if f.startswith(name)]

    def build():
        inner = settled(spark, "inner-result", lambda: materialize(spark.range(5), "inner-step"))
        assert not found("inner-step") and found("inner-result")
        return materialize(inner, "outer-step")

    out = settled(spark, "outer-result", build)
    assert found("outer-result") and not any(found(n) for n in ("inner-step", "inner-result", "outer-step"))
    assert out.count() == 5
