"""Catalog: the whole study pipeline (E1 -> E3) over lineitem x orders."""

from __future__ import annotations

import math

import numpy as np

from mmcohort import config as C
from mmcohort import pipeline as PL
from mmcohort.operators import scoring as SC
from mmcohort.plans import evaluation as EV
from mmcohort.plans.preparation import DROP, FEATURE_OF, LABELS, _SPLIT, _stats_sql, _z
from mmcohort.plans.registry import register, rounded
from mmcohort.sources import fixtures as fx

SPEC = fx.COHORT_SPEC
LATENT = 4
N_CLASSES = len(LABELS)
TOKENS = [m for m in SPEC.token_order if SPEC.widths[m] > 0]
COLS_OF = {m: [c for c, (mm, _) in FEATURE_OF.items() if mm == m] for m in SPEC.stored_order}


def _scorer():
    return SC.class_logits_from_vocab(fx.linear_vocab_model(len(TOKENS) * LATENT), C.VOCAB_POSITIONS[:N_CLASSES])


def _lit(x: float) -> str:
    return repr(float(x))


def _sql() -> str:
    # rows are handed over in single precision: what is packed, and what is scaled
    single = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    packed = ", ".join(f"{single(c)} AS {c}" for c in FEATURE_OF)
    split = _SPLIT.replace(f" AS y, {', '.join(FEATURE_OF)} FROM lab2", f" AS y, {packed} FROM lab2")
    zcols = ", ".join(f"{single(_z(c))} AS {c}" for c in FEATURE_OF)
    codes = []
    for m in TOKENS:
        d = SPEC.widths[m]
        for i in range(LATENT):
            terms = [f"{_lit(np.float32(math.sin(31 * i + 17 * j) / math.sqrt(d)))} * {COLS_OF[m][j]}" for j in range(d)]
            codes.append(f"greatest({' + '.join(terms)} + {_lit(np.float32(0.01 * i))}, 0.0) AS c_{m}_{i}")
    logits = []
    for k in range(N_CLASSES):
        v = C.VOCAB_POSITIONS[k]
        terms = []
        for t, m in enumerate(TOKENS):
            for i in range(LATENT):
                terms.append(f"{_lit(math.cos(5 * v + 3 * (t * LATENT + i)) * 0.25)} * c_{m}_{i}")
        logits.append(" + ".join(terms))
    return f"""WITH {split}, {_stats_sql()},
zs AS (SELECT haim_id, split, list_transform(y, lambda x: CASE WHEN x = -1 THEN 2.0 ELSE x END) AS y, {zcols} FROM sp, st),
cd AS (SELECT y, {', '.join(codes)} FROM zs WHERE split = 'val'),
lo AS (SELECT y, [{', '.join(logits)}] AS logits FROM cd),
lg AS (SELECT CAST(unnest(generate_series(0, {N_CLASSES - 1})) AS INTEGER) AS class_id, unnest(y) AS y, unnest(logits) AS z FROM lo)"""


def _scored_sql(rest: str) -> str:
    # the report's CTEs read ``sp``: a scope of its own, as the split above has that name too
    return f"""{_sql()},
ev AS (SELECT class_id, y, 1.0 / (1.0 + exp(-z)) AS p, CASE WHEN 1.0 / (1.0 + exp(-z)) > 0.5 THEN 1 ELSE 0 END AS pred FROM lg)
SELECT * FROM (WITH sp AS (SELECT * FROM ev), {rest})"""


def _counts(spark, sf_dir):
    scaled, _ = PL.prepare_study(
        fx.cohort(spark, sf_dir), SPEC, key="haim_id", label_cols=LABELS, drop_names=DROP, los="los", death="death"
    )
    w = SC.ProjectorWeights.from_table(SC.rule_weights(spark, SPEC, LATENT))
    return PL.score_split(scaled, w, _scorer(), SPEC)


@register("pipeline_report", "E1 -> E3 end to end over lineitem x orders: prepare, split, standardise, project, score, evaluate", _scored_sql(EV.report_sql()))
def q_pipeline(spark, sf_dir):
    return rounded(PL.evaluate(_counts(spark, sf_dir))[0])


@register("pipeline_roc", "E1 -> E3 end to end: the ROC points", _scored_sql(EV.roc_sql()))
def q_pipeline_roc(spark, sf_dir):
    return rounded(PL.evaluate(_counts(spark, sf_dir))[1])
