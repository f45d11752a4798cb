"""Catalog: cohort labels, pruning, row filters, group split, standardisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.operators import cohort as K
from mmcohort.operators import scaling as S
from mmcohort.operators import split as SP
from mmcohort.plans.registry import r, register, rounded
from mmcohort.session import materialize, scratch_path
from mmcohort.sources import fixtures as fx
from mmcohort.sources import io

FEATURE_OF = {  # scalar fixture column -> (modality, index)
    "vd_0": ("vd", 0), "vd_1": ("vd", 1), "vmd_0": ("vmd", 0), "ts_ce_0": ("ts_ce", 0), "ts_le_0": ("ts_le", 0),
    "ts_pe_0": ("ts_pe", 0), "n_rad_0": ("n_rad", 0), "n_rad_1": ("n_rad", 1),
}
LABELS = ["lab_0", "lab_1", "Length-of-Stay", "48-hour Mortality"]
DROP = ["los", "death", "lab_0", "lab_1", "Length-of-Stay", "48-hour Mortality"]
ARRAYS = [m for m in C.STORED_ORDER]


def prepared(spark, sf_dir, los_mode="literal"):
    return K.prepare(
        fx.cohort(spark, sf_dir), fx.COHORT_SPEC, key="haim_id", label_cols=LABELS, drop_names=DROP,
        drop_prefixes=C.DROPPED_PREFIXES, los="los", death="death", los_mode=los_mode,
    )


def _flat(df, keep=("haim_id",)):
    """Scalar view of the packed fixture features (for comparable output)."""
    return df.select(*keep, *[F.col(m)[i].alias(c) for c, (m, i) in FEATURE_OF.items()])


# ------------------------------------------------------------------ DuckDB text
_CELL = """CASE WHEN los < 48 AND death = 1 THEN 'dead_lt' WHEN los >= 48 AND death = 0 THEN 'alive_ge'
            WHEN los >= 48 AND death = 1 THEN 'dead_ge' WHEN los < 48 AND death = 0 THEN 'alive_lt' END"""
_LABELED = f"""{fx.COHORT_SQL},
lab AS (SELECT *, {_CELL} AS cell FROM cohort),
lab2 AS (SELECT *,
   CAST(CASE WHEN cell IS NULL THEN NULL WHEN cell = 'dead_lt' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS mortality48,
   CAST(CASE WHEN cell IS NULL THEN NULL WHEN cell IN ('dead_lt', 'alive_lt') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS los_label,
   CAST(CASE WHEN death = 1 THEN 0.0 WHEN death = 0 AND los < 48 THEN 1.0 WHEN death = 0 AND los >= 48 THEN 0.0 END AS DOUBLE) AS los_intended
  FROM lab)"""
_NOT_OUT = "NOT (coalesce(n_rad_0 > 10 AND NOT isnan(n_rad_0), false) OR coalesce(n_rad_1 > 10 AND NOT isnan(n_rad_1), false))"
_COMPLETE = " AND ".join(["haim_id IS NOT NULL"] + [f"{c} IS NOT NULL AND NOT isnan({c})" for c in FEATURE_OF])
_FEATS = ", ".join(FEATURE_OF)
_PREP = f"""{_LABELED},
prep AS (SELECT haim_id, [lab_0, lab_1, los_label, mortality48] AS y, {_FEATS} FROM lab2 WHERE {_NOT_OUT} AND {_COMPLETE})"""
_SPLIT = f"""{_PREP},
ids AS (SELECT DISTINCT haim_id FROM prep),
rk AS (SELECT haim_id, row_number() OVER (ORDER BY md5('{C.SPLIT_SEED}:' || CAST(haim_id AS VARCHAR)), haim_id) AS rn,
              count(*) OVER () AS n FROM ids),
asg AS (SELECT haim_id, CASE WHEN rn <= ceil(n * {C.VAL_FRACTION}) THEN 'val' ELSE 'train' END AS split FROM rk),
sp AS (SELECT prep.*, split FROM prep JOIN asg USING (haim_id))"""


def _stats_sql() -> str:
    parts = []
    for c in FEATURE_OF:
        parts.append(f"avg({c}) AS {c}__m, stddev_samp({c}) AS {c}__s")
    return f"st AS (SELECT {', '.join(parts)}, count(*) AS n FROM sp WHERE split = 'train')"


def _z(c: str) -> str:
    return f"CASE WHEN n < 2 THEN NULL WHEN {c}__s <> 0 THEN ({c} - {c}__m) / {c}__s ELSE {c} END"


def sig_sql(expr: str, digits: int = 10) -> str:
    e = f"floor(log10(abs({expr})))"
    return f"(CASE WHEN {expr} IS NULL THEN NULL WHEN {expr} = 0 THEN 0.0 ELSE round({expr} / pow(10, {e}), {digits - 1}) * pow(10, {e}) END)"


def sig(col, digits: int = 10):
    e = F.floor(F.log10(F.abs(col)))
    return F.when(col == 0, F.lit(0.0)).otherwise(F.round(col / F.pow(F.lit(10.0), e), digits - 1) * F.pow(F.lit(10.0), e))


# ---------------------------------------------------------------------- queries

@register("cohort_cells", "P1 U1", f"""WITH {_LABELED}
SELECT cell, count(*) AS n FROM lab GROUP BY cell""")
def q_cells(spark, sf_dir):
    d = K.outcome_labels(fx.cohort(spark, sf_dir), los="los", death="death", cell_out="cell")
    return d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("label_mortality48", "P2 J3", f"""WITH {_LABELED}
SELECT mortality48, count(*) AS n FROM lab2 GROUP BY mortality48""")
def q_mort(spark, sf_dir):
    d = K.outcome_labels(fx.cohort(spark, sf_dir), los="los", death="death", mortality_out="mortality48", los_out="los_label")
    return d.groupBy("mortality48").agg(F.count(F.lit(1)).alias("n"))


@register("label_los_literal", "P3 D1 (literal)", f"""WITH {_LABELED}
SELECT los_label, count(*) AS n FROM lab2 GROUP BY los_label""")
def q_los_lit(spark, sf_dir):
    d = K.outcome_labels(fx.cohort(spark, sf_dir), los="los", death="death", mortality_out="mortality48", los_out="los_label")
    return d.groupBy("los_label").agg(F.count(F.lit(1)).alias("n"))


@register("label_los_intended", "P3 D1 (intended)", f"""WITH {_LABELED}
SELECT los_intended AS los_label, count(*) AS n FROM lab2 GROUP BY los_intended""")
def q_los_int(spark, sf_dir):
    d = K.outcome_labels(
        fx.cohort(spark, sf_dir), los="los", death="death", los_mode="intended", mortality_out="mortality48", los_out="los_label"
    )
    return d.groupBy("los_label").agg(F.count(F.lit(1)).alias("n"))


@register("label_pack_recode", "P4 P5 P17 X1 X2", f"""WITH {_LABELED},
pk AS (SELECT list_transform([lab_0, lab_1, los_label, mortality48], lambda x: CASE WHEN x = -1 THEN 2.0 ELSE x END) AS y FROM lab2),
lg AS (SELECT CAST(unnest(generate_series(0, 3)) AS INTEGER) AS class_id, unnest(y) AS y FROM pk)
SELECT class_id, y, count(*) AS n FROM lg GROUP BY class_id, y""")
def q_pack(spark, sf_dir):
    d = K.outcome_labels(fx.cohort(spark, sf_dir), los="los", death="death")
    d = K.recode_uncertain(K.pack_labels(d, LABELS))
    few = d.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))  # the few distinct label arrays, then their elements
    lg = few.select("_n", F.posexplode("y").alias("class_id", "y"))
    return lg.groupBy("class_id", "y").agg(F.sum("_n").alias("n"))


@register("prune_columns", "P6 P7 P8 P13 F13", f"""WITH {_LABELED}
SELECT haim_id, {_FEATS} FROM lab2""")
def q_prune(spark, sf_dir):
    d = K.outcome_labels(fx.cohort(spark, sf_dir), los="los", death="death")
    d = K.pack_labels(d, LABELS)
    d = K.prune(d, names=DROP, prefixes=C.DROPPED_PREFIXES)
    return d.drop("y")


@register("outlier_filter", "P9 F8 D2", f"""WITH {_LABELED}
SELECT haim_id, {_FEATS} FROM lab2 WHERE {_NOT_OUT}""")
def q_outlier(spark, sf_dir):
    d = K.pack_modalities(fx.cohort(spark, sf_dir), fx.COHORT_SPEC, keep=["haim_id"])
    return _flat(K.filter_outliers(d, col="n_rad"))


@register("incomplete_filter", "P10 P14", f"""WITH {_PREP}
SELECT haim_id, {_FEATS} FROM prep""")
def q_incomplete(spark, sf_dir):
    return _flat(prepared(spark, sf_dir))


@register("single_label", "P11 P12 D6", f"""WITH {fx.COHORT_SQL}
SELECT haim_id, lab_0 AS y, {_FEATS} FROM cohort WHERE lab_0 IN (0, 1)""")
def q_single(spark, sf_dir):
    d = K.single_label(fx.cohort(spark, sf_dir), "lab_0")
    return d.select("haim_id", "y", *FEATURE_OF)


def _single_sql() -> str:
    stats = ", ".join(f"avg({c}) AS {c}__m, stddev_samp({c}) AS {c}__s" for c in FEATURE_OF)
    z = lambda c: f"CASE WHEN {c}__s IS NULL THEN NULL WHEN {c}__s <> 0 THEN ({c} - {c}__m) / {c}__s ELSE {c} END"
    rows = "\nUNION ALL\n".join(
        f"SELECT split, y, '{m}' AS modality, CAST({i} AS INTEGER) AS idx, {z(c)} AS x FROM sp1, st1" for c, (m, i) in FEATURE_OF.items()
    )
    return f"""WITH {fx.COHORT_SQL},
s1 AS (SELECT haim_id, lab_0 AS y, {_FEATS} FROM cohort WHERE lab_0 IN (0, 1) AND haim_id IS NOT NULL),
i1 AS (SELECT DISTINCT haim_id FROM s1),
r1 AS (SELECT haim_id, row_number() OVER (ORDER BY md5('{C.SPLIT_SEED}:' || CAST(haim_id AS VARCHAR)), haim_id) AS rn, count(*) OVER () AS n FROM i1),
sp1 AS (SELECT s1.*, CASE WHEN rn <= ceil(n * {C.VAL_FRACTION}) THEN 'val' ELSE 'train' END AS split FROM s1 JOIN r1 USING (haim_id)),
st1 AS (SELECT {stats} FROM sp1 WHERE split = 'train'),
z1 AS ({rows})
SELECT split, modality, idx, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, CAST(sum(y) AS BIGINT) AS n_pos,
       {r('sum(x)', 6)} AS s1, {r('sum(x * x)', 6)} AS s2 FROM z1 GROUP BY split, modality, idx"""


@register("single_label_zscore", "P11 P12 G2 G3: single-label route, missing features kept and skipped by the statistics", _single_sql())
def q_single_zscore(spark, sf_dir):
    d = K.prepare_single(
        fx.cohort(spark, sf_dir), fx.COHORT_SPEC, "lab_0", drop_names=["los", "death", "lab_0", "lab_1"], drop_prefixes=C.DROPPED_PREFIXES
    )
    d = materialize(d, "single-prepared")  # read by the cutoff, two passes of statistics and their application
    d = SP.apply_split(d, "haim_id", SP.fit_split(d, "haim_id"))
    widths = fx.COHORT_SPEC.widths
    st = S.fit_stats(d.where(F.col("split") == "train"), ARRAYS, widths, skip_missing=True)
    return rounded(feature_sums(S.apply_stats(d, st, ARRAYS), [F.sum("y").cast("long").alias("n_pos")]), 6)


@register("group_split", "G1 W1 J1 J2", f"""WITH {_SPLIT}
SELECT haim_id, split, count(*) AS n_rows FROM sp GROUP BY haim_id, split""")
def q_split(spark, sf_dir):
    # the cutoff and its application both read the ids of the prepared rows: write them once
    d = SP.group_split(materialize(prepared(spark, sf_dir).select("haim_id"), "cohort-ids"), "haim_id")
    return d.groupBy("haim_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def _source_split_sql() -> str:
    """Ids numbered by first appearance in ``lineitem``; which numbers are
    validation is NumPy's permutation for the fixture's numbers of ids."""
    groups = (150, 1_500, 14_999)  # of the three scales
    perms = ", ".join(
        f"({n}, {np.random.RandomState(C.SPLIT_SEED).permutation(n)[: int(np.ceil(n * C.VAL_FRACTION))].tolist()})" for n in groups
    )
    numbered = _LABELED.replace("FROM lineitem JOIN", "FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) li JOIN").replace(
        "l_linenumber AS vmp_0", "l_linenumber AS vmp_0, rid"
    )
    return f"""WITH {numbered},
seen AS (SELECT haim_id, min(rid) AS rid0, count(*) AS n_rows FROM lab2 WHERE {_NOT_OUT} AND {_COMPLETE} GROUP BY haim_id),
ranked AS (SELECT haim_id, n_rows, row_number() OVER (ORDER BY rid0) - 1 AS id_rank, count(*) OVER () AS n FROM seen),
perm AS (SELECT * FROM (VALUES {perms}) v(n, ranks)),
val AS (SELECT n, unnest(ranks) AS id_rank FROM perm WHERE n = (SELECT count(*) FROM seen))
SELECT haim_id, CAST(id_rank AS BIGINT) AS id_rank, CASE WHEN val.n IS NULL THEN 'train' ELSE 'val' END AS split, n_rows
FROM ranked LEFT JOIN val USING (id_rank)"""


@register("group_split_source", "W1 G1 J1 J2: the source's own members (order of first appearance, seeded permutation)", _source_split_sql())
def q_split_source(spark, sf_dir):
    d = K.prepare(
        fx.cohort(spark, sf_dir, position="pos"), fx.COHORT_SPEC, key="haim_id", label_cols=LABELS, drop_names=DROP,
        drop_prefixes=C.DROPPED_PREFIXES, los="los", death="death", extra_keep=["pos"],
    )
    d = materialize(d.select("haim_id", "pos"), "cohort-positions")
    split = SP.apply_split(d, "haim_id", SP.fit_split(d, "haim_id", members="source", position="pos"))
    per = split.groupBy("haim_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    ranks = SP.first_seen(d, "haim_id", "pos").select(F.col("_id").alias("haim_id"), F.col("_rank").alias("id_rank"))
    return per.join(ranks, "haim_id").select("haim_id", "id_rank", "split", "n_rows")


@register("split_disjoint", "U2", f"""WITH {_SPLIT},
tr AS (SELECT DISTINCT haim_id FROM sp WHERE split = 'train'),
va AS (SELECT DISTINCT haim_id FROM sp WHERE split = 'val')
SELECT (SELECT count(*) FROM tr) AS n_train_groups, (SELECT count(*) FROM va) AS n_val_groups,
       (SELECT count(*) FROM (SELECT haim_id FROM tr INTERSECT SELECT haim_id FROM va)) AS n_both""")
def q_disjoint(spark, sf_dir):
    d = SP.group_split(materialize(prepared(spark, sf_dir).select("haim_id"), "cohort-ids"), "haim_id")
    per_id = d.groupBy("haim_id").agg(
        F.count_if(F.col("split") == "train").alias("_t"), F.count_if(F.col("split") == "val").alias("_v")
    )
    return per_id.agg(
        F.count_if(F.col("_t") > 0).alias("n_train_groups"),
        F.count_if(F.col("_v") > 0).alias("n_val_groups"),
        F.count_if((F.col("_t") > 0) & (F.col("_v") > 0)).alias("n_both"),
    )


def _stats_long_sql() -> str:
    rows = []
    for c, (m, i) in FEATURE_OF.items():
        rows.append(
            f"SELECT '{m}' AS modality, CAST({i} AS INTEGER) AS idx, {sig_sql(c + '__m')} AS mean, "
            f"{sig_sql(c + '__s')} AS std, n FROM st"
        )
    return "\nUNION ALL\n".join(rows)


def _train_stats(spark, sf_dir):
    # the prepared cohort feeds the cutoff, the statistics and their application: write it once
    d = materialize(prepared(spark, sf_dir), "cohort-prepared")
    d = SP.apply_split(d, "haim_id", SP.fit_split(d, "haim_id"))
    return d, S.fit_stats(d.where(F.col("split") == "train"), ARRAYS, widths=fx.COHORT_SPEC.widths)


@register("zscore_stats", "G2", f"""WITH {_SPLIT}, {_stats_sql()}
{_stats_long_sql()}""")
def q_zstats(spark, sf_dir):
    return _stats_rows(_train_stats(spark, sf_dir)[1])


@register("zscore_stats_merged", "G2 from kept states: one per part of the table, one of them written twice, then merged", f"""WITH {_SPLIT}, {_stats_sql()}
{_stats_long_sql()}""")
def q_zstats_merged(spark, sf_dir):
    d = materialize(prepared(spark, sf_dir), "cohort-prepared")
    d = SP.apply_split(d, "haim_id", SP.fit_split(d, "haim_id")).where(F.col("split") == "train")
    path, widths = scratch_path(spark, "states"), fx.COHORT_SPEC.widths
    for part, rows in (("a", F.col("haim_id") % 3 == 0), ("b", F.col("haim_id") % 3 > 0), ("a", F.col("haim_id") % 3 == 0)):
        io.put_state(S.partial_stats(d.where(rows), ARRAYS, widths), path, part=part)
    return _stats_rows(S.merge_stats(io.read_state(spark, path, S.STATE_SCHEMA, ["part"]), ARRAYS, widths))


def _stats_rows(st):
    parts = []
    for m in ARRAYS:
        parts.append(
            st.select(
                F.lit(m).alias("modality"),
                F.posexplode(F.arrays_zip(F.col(f"{m}__mean").alias("m"), F.col(f"{m}__std").alias("s"))).alias("idx", "ms"),
                "n",
            ).select("modality", "idx", sig(F.col("ms.m")).alias("mean"), sig(F.col("ms.s")).alias("std"), "n")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_features(df, arrays, widths, keep=("split",)):
    """(keep..., modality, idx, x): one row per array element (for per-feature aggregates).

    Widths are known, so each element is a plain ``element_at`` inside one
    generated projection (no lambda per element)."""
    elems = [
        F.struct(F.lit(m).alias("modality"), F.lit(i).alias("idx"), F.col(m)[i].cast("double").alias("x"))
        for m in arrays
        for i in range(widths[m])
    ]
    return df.select(*keep, F.inline(F.array(*elems)))


def feature_sums(df, extra=()):
    """Per split and feature: rows, NULLs, sum and sum of squares. One aggregate
    row per split holds all features; only those few rows are unfolded."""
    elems = {(m, i): F.col(m)[i].cast("double") for m in ARRAYS for i in range(fx.COHORT_SPEC.widths[m])}
    aggs = []
    for (m, i), x in elems.items():
        aggs += [F.count_if(x.isNull()).alias(f"{m}_{i}_k"), F.sum(x).alias(f"{m}_{i}_s"), F.sum(x * x).alias(f"{m}_{i}_q")]
    wide = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *extra, *aggs)
    rows = [
        F.struct(
            F.lit(m).alias("modality"), F.lit(i).alias("idx"), F.col(f"{m}_{i}_k").alias("n_null"),
            F.col(f"{m}_{i}_s").alias("s1"), F.col(f"{m}_{i}_q").alias("s2"),
        )
        for m, i in elems
    ]
    names = [c for c in wide.columns[1 : len(wide.columns) - len(aggs)]]
    return wide.select("split", *names, F.inline(F.array(*rows)))


def _zapply_sql() -> str:
    rows = []
    for c, (m, i) in FEATURE_OF.items():
        rows.append(f"SELECT split, '{m}' AS modality, CAST({i} AS INTEGER) AS idx, {_z(c)} AS x FROM sp, st")
    u = "\nUNION ALL\n".join(rows)
    return f"""z AS ({u})
SELECT split, modality, idx, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null,
       {r('sum(x)', 6)} AS s1, {r('sum(x * x)', 6)} AS s2 FROM z GROUP BY split, modality, idx"""


@register("zscore_apply", "G3 J6", f"""WITH {_SPLIT}, {_stats_sql()}, {_zapply_sql()}""")
def q_zapply(spark, sf_dir):
    d, st = _train_stats(spark, sf_dir)
    z = S.apply_stats(d, st, ARRAYS)
    return rounded(feature_sums(z), 6)
