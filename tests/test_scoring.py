import numpy as np
import pytest

from mmcohort import config as C
from mmcohort.operators import scoring as SC
from mmcohort.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_encode_paths_agree_with_numpy(spark):
    spec = C.FIXTURE_SPEC
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, spec, 4))
    m = fx.modal(spark, SF)
    a = SC.encode(m, w, spec.stored_order, decode=True).orderBy("study_id").collect()
    b = SC.encode_sql(m, w, spec.stored_order, decode=True).orderBy("study_id").collect()
    for ra, rb in zip(a, b):
        for mod in spec.stored_order:
            x = np.asarray(ra[mod], dtype=np.float64)
            W, bb = w.mats[mod]["W"].astype(np.float64), w.mats[mod]["b"].astype(np.float64)
            h = np.maximum(W @ x + bb, 0)
            assert np.allclose(ra[f"code_{mod}"], h, atol=1e-12)
            assert np.allclose(rb[f"code_{mod}"], h, atol=1e-12)
            V, c = w.mats[mod]["V"].astype(np.float64), w.mats[mod]["c"].astype(np.float64)
            assert np.allclose(ra[f"recon_{mod}"], V @ h + c, atol=1e-12)
            assert np.allclose(rb[f"recon_{mod}"], V @ h + c, atol=1e-12)


def test_joint_scorer_reads_vocab_positions(spark):
    spec = C.FIXTURE_SPEC
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, spec, 4))
    m = fx.modal(spark, SF)
    e = SC.encode(m, w, spec.stored_order)
    s = SC.score(e, SC.class_logits_from_vocab(fx.linear_vocab_model(24)), C.TOKEN_ORDER, 4, batch_size=7)
    for r in s.collect():
        flat = np.concatenate([r[f"code_{t}"] for t in C.TOKEN_ORDER])
        v = np.asarray(C.VOCAB_POSITIONS)[:, None]
        H = np.cos(5 * v + 3 * np.arange(24)[None, :]) * 0.25
        assert np.allclose(r["logits"], H @ flat, atol=1e-12)


def test_weights_broadcast_is_size_checked(spark):
    import pytest

    from mmcohort import config as C
    from mmcohort.operators import scoring as SC

    w = SC.rule_weights(spark, C.FIXTURE_SPEC, 4)
    assert SC.ProjectorWeights.from_table(w).latent["vd"] == 4
    with pytest.raises(ValueError, match="broadcast limit"):
        SC.ProjectorWeights.from_table(w, max_values=100)


def test_fused_encode_and_score_equals_two_passes(spark):
    from pyspark.sql import functions as F

    from mmcohort import config as C
    from mmcohort.operators import scoring as SC
    from mmcohort.sources import fixtures as fx

    m = fx.modal(spark, "/root/testdata/sf0.001")
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4))
    scorer = SC.class_logits_from_vocab(fx.linear_vocab_model(len(C.TOKEN_ORDER) * 4))
    two = SC.score(SC.encode(m, w, C.FIXTURE_SPEC.stored_order), scorer, C.TOKEN_ORDER, 4)
    one = SC.encode_and_score(m, w, scorer, C.TOKEN_ORDER, keep=["study_id"], batch_size=7)
    a = {r["study_id"]: r["logits"] for r in two.select("study_id", "logits").collect()}
    b = {r["study_id"]: r["logits"] for r in one.collect()}
    assert a.keys() == b.keys() and len(a) == 500
    assert all(max(abs(x - y) for x, y in zip(a[k], b[k])) < 1e-12 for k in a)
    assert one.where(F.size("logits") != 12).count() == 0


def test_fused_validation_pass_equals_two_passes(spark):
    import numpy as np

    from mmcohort import config as C
    from mmcohort.functions.columns import sq_err_sum
    from mmcohort.operators import scoring as SC
    from mmcohort.sources import fixtures as fx

    m = fx.modal(spark, "/root/testdata/sf0.001")
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4))
    head = fx.vocab_matrix(len(C.TOKEN_ORDER) * 4, C.VOCAB_POSITIONS)
    toks = list(C.TOKEN_ORDER)
    e = SC.encode(m, w, toks, decode=True)
    two = SC.score(e, SC.linear_head(head), toks, 4).select(
        "study_id", "logits", *[sq_err_sum(t, f"recon_{t}").alias(f"_se_{t}") for t in toks]
    )
    one = SC.encode_decode_score(m, w, SC.linear_head(head), toks, keep=["study_id"], batch_size=13)
    a = {r["study_id"]: r for r in two.collect()}
    b = {r["study_id"]: r for r in one.collect()}
    assert a.keys() == b.keys() and len(a) == 500
    for k in a:
        assert np.allclose(a[k]["logits"], b[k]["logits"], rtol=1e-12, atol=1e-12)
        for t in toks:
            assert abs(a[k][f"_se_{t}"] - b[k][f"_se_{t}"]) <= 1e-9 * max(1.0, abs(a[k][f"_se_{t}"]))
            assert b[k][f"_n_{t}"] == C.FIXTURE_SPEC.widths[t]


def test_isolated_pass_equals_two_passes(spark):
    m = fx.modal(spark, SF)
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4))
    scorer = SC.class_logits_from_vocab(fx.linear_vocab_model(len(C.TOKEN_ORDER) * 4))
    two = SC.score_isolated(SC.encode(m, w, C.TOKEN_ORDER), scorer, C.TOKEN_ORDER, 4)
    one = SC.encode_and_score_isolated(m, w, scorer, C.TOKEN_ORDER, keep=["study_id"], batch_size=11)
    a = {(r["study_id"], r["token_idx"], r["modality"]): r["logits"] for r in two.collect()}
    b = {(r["study_id"], r["token_idx"], r["modality"]): r["logits"] for r in one.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_half_precision_codes_match_numpy(spark):
    import __spark_entry__ as E

    got = {}
    for r in E.queries()["joint_scores_half"](spark, SF).collect():
        got.setdefault(r["study_id"], {})[r["class_id"]] = r["logit"]
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4)).mats
    head = fx.vocab_matrix(24, C.VOCAB_POSITIONS)
    rows = [r for r in fx.modal(spark, SF).collect() if r["study_id"] in got]
    assert len(rows) == len(got) > 0
    for r in rows:
        codes = [np.maximum(np.asarray(r[m], np.float32) @ w[m]["W"].T + w[m]["b"], 0) for m in C.TOKEN_ORDER]
        half = np.concatenate(codes).astype(np.float16).astype(np.float32)
        want = head @ half
        assert np.allclose([got[r["study_id"]][k] for k in range(12)], want, atol=2e-3 * max(1, np.abs(want).max()))


def test_ragged_or_missing_arrays_raise():
    import pyarrow as pa

    for rows in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(ValueError, match="one length"):
            SC.arrow_matrix(pa.array(rows, pa.list_(pa.float64())))


@pytest.mark.parametrize("name", ["joint_scores", "isolated_scores", "joint_scores_half"])
def test_one_python_pass(spark, name):
    import __spark_entry__ as E

    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_inlined_weights_are_size_checked(spark, monkeypatch):
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, C.FIXTURE_SPEC, 4))
    monkeypatch.setattr(SC, "MAX_INLINE_WEIGHT_VALUES", 10)
    with pytest.raises(ValueError, match="inline"):
        SC.encode_sql(fx.modal(spark, SF), w, C.FIXTURE_SPEC.stored_order)
