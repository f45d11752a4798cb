"""Catalog: per-class evaluation (confusion, threshold metrics, ROC, AUC, report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mmcohort.operators import metrics as M
from mmcohort.plans.registry import r, register, rounded
from mmcohort.sources import fixtures as fx

_VALID = "(y IS NOT NULL AND NOT isnan(y) AND y <> 2)"

_SCORED = f"""WITH {fx.SCORES_SQL},
sp AS (SELECT study_id, class_id, y, 1.0 / (1.0 + exp(-z)) AS p,
              CASE WHEN 1.0 / (1.0 + exp(-z)) > 0.5 THEN 1 ELSE 0 END AS pred FROM scores)"""

_TIES = f"""WITH {fx.TIE_SQL}, sp AS (SELECT * FROM tie)"""


def _conf_sql() -> str:
    return f"""conf AS (SELECT class_id,
    CAST(count(*) FILTER (WHERE {_VALID}) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE {_VALID} AND y = 0 AND pred = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE {_VALID} AND y = 0 AND pred = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE {_VALID} AND y = 1 AND pred = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE {_VALID} AND y = 1 AND pred = 1) AS BIGINT) AS tp
  FROM sp GROUP BY class_id)"""


def _metrics_sql() -> str:
    f1p = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0)"
    f1n = "coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 0.0)"
    hasn = "(tn + fp + fn > 0)"
    hasp = "(tp + fn + fp > 0)"
    f1 = (
        f"(CASE WHEN {hasn} THEN {f1n} ELSE 0.0 END + CASE WHEN {hasp} THEN {f1p} ELSE 0.0 END)"
        f" / nullif(CAST({hasn} AS INTEGER) + CAST({hasp} AS INTEGER), 0)"
    )
    return f"""met AS (SELECT class_id, n, tn, fp, fn, tp,
    {r('(tp + tn) / nullif(n, 0)')} AS accuracy,
    {r('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision,
    {r('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
    {r(f1)} AS f1_macro
  FROM conf)"""


def _auc_sql() -> str:
    return f"""cnt AS (SELECT class_id, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
  FROM sp WHERE {_VALID} GROUP BY class_id, p),
rk AS (SELECT *, coalesce(sum(n_neg) OVER (PARTITION BY class_id ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM cnt),
au AS (SELECT class_id, CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0 THEN
        sum(CAST(n_pos AS DOUBLE) * (neg_below + 0.5::DOUBLE * n_neg)) / (CAST(sum(n_pos) AS DOUBLE) * sum(n_neg)) END AS auc
  FROM rk GROUP BY class_id)"""


def _roc_sql() -> str:
    return f"""cnt AS (SELECT class_id, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
  FROM sp WHERE {_VALID} GROUP BY class_id, p),
rk AS (SELECT *,
   row_number() OVER w AS seq,
   sum(n_pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
   sum(n_neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
   lead(n_pos) OVER w AS next_pos, lead(n_neg) OVER w AS next_neg,
   count(*) OVER (PARTITION BY class_id) AS m,
   sum(n_pos) OVER (PARTITION BY class_id) AS tot_pos,
   sum(n_neg) OVER (PARTITION BY class_id) AS tot_neg
  FROM cnt WINDOW w AS (PARTITION BY class_id ORDER BY p DESC))"""


def _scored_long(spark, sf_dir):
    return M.predict(fx.scores(spark, sf_dir))


@register("confusion", "P18 P19 F1 F2 G17 G26", f"""{_SCORED}, {_conf_sql()}
SELECT * FROM conf""")
def q_confusion(spark, sf_dir):
    return M.confusion(_scored_long(spark, sf_dir))


@register("threshold_metrics", "G18 G19 G20 G21", f"""{_SCORED}, {_conf_sql()}, {_metrics_sql()}
SELECT * FROM met""")
def q_threshold_metrics(spark, sf_dir):
    return rounded(M.threshold_metrics(M.confusion(_scored_long(spark, sf_dir))))


@register("threshold_metrics_ties", "G17-G21 on a tied score", f"""{_TIES}, {_conf_sql()}, {_metrics_sql()}
SELECT * FROM met""")
def q_threshold_metrics_ties(spark, sf_dir):
    return rounded(M.threshold_metrics(M.confusion(fx.tie_scores(spark, sf_dir))))


@register("roc_auc", "G22 W2 O1", f"""{_SCORED}, {_auc_sql()}
SELECT class_id, {r('auc')} AS auc FROM au""")
def q_roc_auc(spark, sf_dir):
    return rounded(M.auc(_scored_long(spark, sf_dir)))


@register("roc_auc_ties", "G22 with 11 distinct scores", f"""{_TIES}, {_auc_sql()}
SELECT class_id, {r('auc')} AS auc FROM au""")
def q_roc_auc_ties(spark, sf_dir):
    return rounded(M.auc(fx.tie_scores(spark, sf_dir)))


_ROC_SELECT = f"""
SELECT class_id, CAST(0 AS BIGINT) AS seq,
       CASE WHEN tot_neg > 0 THEN 0.0 END AS fpr, CASE WHEN tot_pos > 0 THEN 0.0 END AS tpr,
       CAST('inf' AS DOUBLE) AS threshold
FROM (SELECT DISTINCT class_id, tot_pos, tot_neg FROM rk)
UNION ALL
SELECT class_id, CAST(seq AS BIGINT) AS seq,
       {r('fps / nullif(tot_neg, 0)')} AS fpr, {r('tps / nullif(tot_pos, 0)')} AS tpr, {r('p')} AS threshold
FROM rk
WHERE m <= 2 OR seq = 1 OR seq = m OR next_pos <> n_pos OR next_neg <> n_neg"""


@register("roc_points", "G23 W2 W3 O1", f"""{_SCORED}, {_roc_sql()}{_ROC_SELECT}""")
def q_roc_points(spark, sf_dir):
    return rounded(M.roc_points(_scored_long(spark, sf_dir)))


@register("roc_points_ties", "G23 W3 on 11 distinct scores", f"""{_TIES}, {_roc_sql()}{_ROC_SELECT}""")
def q_roc_points_ties(spark, sf_dir):
    return rounded(M.roc_points(fx.tie_scores(spark, sf_dir)))


@register("roc_trapezoid", "G24", f"""{_SCORED}, {_roc_sql()},
pts AS (SELECT class_id, fps / tot_neg AS x, tps / tot_pos AS yv,
               lag(fps, 1, 0) OVER w / tot_neg AS x0, lag(tps, 1, 0) OVER w / tot_pos AS y0, tot_pos, tot_neg
        FROM rk WINDOW w AS (PARTITION BY class_id ORDER BY seq))
SELECT class_id, {r('CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0 THEN sum((x - x0) * (yv + y0) / 2) END')} AS roc_auc
FROM pts GROUP BY class_id""")
def q_roc_trapezoid(spark, sf_dir):
    return rounded(M.roc_trapezoid(_scored_long(spark, sf_dir)))


def report_sql() -> str:
    """CTEs and SELECT of the full report over a CTE ``sp`` (class_id, y, p, pred)."""
    return f"""{_conf_sql()}, {_metrics_sql()}, {_auc_sql()}
SELECT met.*, {r('au.auc')} AS auc, {r('au.auc')} AS roc_auc FROM met LEFT JOIN au USING (class_id)"""


def roc_sql() -> str:
    """CTEs and SELECT of the ROC points over a CTE ``sp``."""
    return f"{_roc_sql()}{_ROC_SELECT}"


EVAL_REPORT_SQL = f"{_SCORED}, {report_sql()}"


@register("eval_report", "E3 G25 (flagship): G17-G22, G24", EVAL_REPORT_SQL)
def q_eval_report(spark, sf_dir):
    return rounded(M.report(_scored_long(spark, sf_dir)))


@register("predict_scores", "M6 F1 F2 F3 P21", f"""{_SCORED}
SELECT study_id, class_id, y, {r('p')} AS p, {r('1.0 - p')} AS p_neg, pred FROM sp""")
def q_predict_scores(spark, sf_dir):
    s = _scored_long(spark, sf_dir)
    return rounded(s.select("study_id", "class_id", "y", "p", (F.lit(1.0) - F.col("p")).alias("p_neg"), "pred"))
