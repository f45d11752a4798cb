"""Catalog: class weights, masked losses, batches, projection, scoring, epoch losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort import pipeline as PL
from mmcohort.functions.columns import half
from mmcohort.operators import batches as B
from mmcohort.operators import cohort as K
from mmcohort.operators import losses as L
from mmcohort.operators import metrics as M
from mmcohort.operators import scaling as S
from mmcohort.operators import scoring as SC
from mmcohort.operators import split as SP
from mmcohort.operators.prefix import ordered_prefix
from mmcohort.plans import evaluation as EV
from mmcohort.plans.preparation import long_features, sig, sig_sql
from mmcohort.plans.registry import r, register, rounded
from mmcohort.session import materialize
from mmcohort.sources import fixtures as fx

SPEC = C.FIXTURE_SPEC
LATENT = 4
N_TOK = len(C.TOKEN_ORDER)


# ------------------------------------------------------------------ Spark side

def modal_split(spark, sf_dir):
    """Modal fixture through the preparation stages: filters, group split, uncertain -> 2."""
    m = fx.modal(spark, sf_dir)
    m = K.filter_outliers(m, col="n_rad")
    m = K.drop_incomplete(m, scalars=["haim_id"], arrays=list(SPEC.stored_order))
    m = SP.group_split(m, "haim_id")
    return K.recode_uncertain(m, col="y")


def label_long(spark, sf_dir, ms=None):
    """(study_id, split, class_id, y): labels alone, no scorer."""
    ms = modal_split(spark, sf_dir) if ms is None else ms
    return ms.select("study_id", "split", F.posexplode("y").alias("class_id", "y"))


def modal_long(spark, sf_dir, ms=None):
    """Labels and the frozen scorer's logits, long: one Python pass."""
    s = SC.encode_and_score(modal_split(spark, sf_dir) if ms is None else ms, fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=KEEP)
    return L.to_long(s, keep=("study_id", "split"), y="y", z="logits")


def fixture_weights(spark, factor: float = 1.0):
    return SC.ProjectorWeights.from_table(SC.rule_weights(spark, SPEC, LATENT, factor))


def fixture_scorer():
    return SC.class_logits_from_vocab(fx.linear_vocab_model(N_TOK * LATENT))


KEEP = ("study_id", "split", "y")


def scored(spark, sf_dir, *, isolated=False, factor=1.0):
    """Narrow scores of every row: labels, logits and squared reconstruction
    errors, with batch numbers; written once. No code or reconstruction leaves
    the workers."""
    s = SC.encode_decode_score(
        modal_split(spark, sf_dir), fixture_weights(spark, factor), fixture_scorer(), C.TOKEN_ORDER, keep=KEEP, isolated=isolated
    )
    s = materialize(s, "scored")
    return B.batch_numbers(s, "study_id", partition=("split",), keep=[c for c in s.columns if c not in ("study_id", "split")])


# ------------------------------------------------------------------ DuckDB text

_MODAL_SPLIT = f"""WITH {fx.MODAL_SQL},
ids AS (SELECT DISTINCT haim_id FROM modal),
rk AS (SELECT haim_id, row_number() OVER (ORDER BY md5('{C.SPLIT_SEED}:' || CAST(haim_id AS VARCHAR)), haim_id) AS rn,
              count(*) OVER () AS n FROM ids),
asg AS (SELECT haim_id, CASE WHEN rn <= ceil(n * {C.VAL_FRACTION}) THEN 'val' ELSE 'train' END AS split FROM rk),
ms AS (SELECT modal.* REPLACE (list_transform(y, lambda x: CASE WHEN x = -1 THEN 2.0 ELSE x END) AS y), split
       FROM modal JOIN asg USING (haim_id)),
lab AS (SELECT study_id, split, CAST(unnest(generate_series(0, 11)) AS INTEGER) AS class_id, unnest(y) AS y FROM ms)"""

_VALID = "(y IS NOT NULL AND NOT isnan(y) AND y <> 2)"
_SIG = "(1.0 / (1.0 + exp(-z)))"


def _gamma_case(gammas) -> str:
    return "CASE class_id " + " ".join(f"WHEN {i} THEN {float(g)}" for i, g in enumerate(gammas)) + " END"


def _asl_term_sql(gexpr: str) -> str:
    pm = f"greatest({_SIG} - {C.ASL_CLIP}, 0.0)"
    return (
        f"(y * (1.0 - {_SIG}) * ln(greatest({_SIG}, {C.ASL_EPS})) + "
        f"(1.0 - y) * pow({pm}, {gexpr}) * ln(greatest(1.0 - {pm}, {C.ASL_EPS})))"
    )


def _asl_sql(src: str, by: str, gammas) -> str:
    return (
        f"SELECT {by}, class_id, coalesce(-avg(CASE WHEN {_VALID} THEN {_asl_term_sql(_gamma_case(gammas))} END), 0.0) AS loss "
        f"FROM {src} GROUP BY {by}, class_id"
    )


_WEIGHTS = f"""cc AS (SELECT class_id, count(*) AS n, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
        FROM lab WHERE split = 'train' GROUP BY class_id),
cw AS (SELECT class_id, CAST(n AS DOUBLE) / ({2.0 * C.BCE_K} * n0 + {C.BCE_EPS}) AS w0,
              CAST(n AS DOUBLE) / ({2.0 * C.BCE_K} * n1 + {C.BCE_EPS}) AS w1 FROM cc)"""

_BCE = f"""bl AS (SELECT split, class_id, coalesce(avg(CASE WHEN {_VALID} THEN
          (CASE WHEN y = 1 THEN w1 ELSE w0 END) * (greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))) END), 0.0) AS loss
        FROM jl JOIN cw USING (class_id) GROUP BY split, class_id)"""


def _feature_rows_sql(src: str, keep: str) -> str:
    rows = []
    for m in SPEC.stored_order:
        d = SPEC.widths[m]
        rows.append(
            f"SELECT {keep}, '{m}' AS modality, {d} AS d, CAST(unnest({m}) AS DOUBLE) AS x, "
            f"CAST(unnest(generate_series(0, {d - 1})) AS INTEGER) AS j FROM {src}"
        )
    return "\nUNION ALL\n".join(rows)


_TOK = "tok AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {t})" for t, m in enumerate(C.TOKEN_ORDER)) + ") v(modality, t))"

_CLS = "cls AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(C.VOCAB_POSITIONS)) + ") v(class_id, pos))"

_CODES = f"""xl AS ({_feature_rows_sql('ms', 'study_id, split')}),
lat AS (SELECT CAST(range AS INTEGER) AS i FROM range({LATENT})),
code AS (SELECT study_id, split, modality, i,
           greatest(sum(CAST(CAST(sin(31 * i + 17 * j) / sqrt(d) AS FLOAT) AS DOUBLE) * x)
                    + CAST(CAST(0.01::DOUBLE * i AS FLOAT) AS DOUBLE), 0.0) AS code
         FROM xl CROSS JOIN lat GROUP BY study_id, split, modality, d, i),
recon AS (SELECT x.study_id, x.split, x.modality, x.j, x.x,
            sum(CAST(CAST(cos(29 * x.j + 11 * c.i) / sqrt({LATENT}) AS FLOAT) AS DOUBLE) * c.code)
              + CAST(CAST(0.005::DOUBLE * x.j AS FLOAT) AS DOUBLE) AS xhat
          FROM xl x JOIN code c USING (study_id, split, modality) GROUP BY x.study_id, x.split, x.modality, x.j, x.x),
{_TOK},
{_CLS},
joint AS (SELECT c.study_id, c.split, k.class_id,
            sum(cos(5 * k.pos + 3 * (tok.t * {LATENT} + c.i)) * 0.25 * c.code) AS z
          FROM code c JOIN tok USING (modality) CROSS JOIN cls k GROUP BY c.study_id, c.split, k.class_id),
iso AS (SELECT c.study_id, c.split, c.modality, k.class_id,
            sum(cos(5 * k.pos + 3 * c.i) * 0.25 * c.code) AS z
          FROM code c CROSS JOIN cls k GROUP BY c.study_id, c.split, c.modality, k.class_id),
bt AS (SELECT study_id, split, CAST((row_number() OVER (PARTITION BY split ORDER BY study_id) - 1) // {C.BATCH_SIZE} + 1 AS BIGINT) AS batch_id
       FROM ms),
ylong AS (SELECT study_id, split, CAST(unnest(generate_series(0, 11)) AS INTEGER) AS class_id, unnest(y) AS y FROM ms),
jl AS (SELECT joint.*, ylong.y, bt.batch_id FROM joint JOIN ylong USING (study_id, split, class_id) JOIN bt USING (study_id, split)),
il AS (SELECT iso.*, ylong.y, bt.batch_id FROM iso JOIN ylong USING (study_id, split, class_id) JOIN bt USING (study_id, split)),
mse_b AS (SELECT split, batch_id, modality, sum((xhat - x) * (xhat - x)) / count(*) AS mse
          FROM recon JOIN bt USING (study_id, split) GROUP BY split, batch_id, modality)"""


# ---------------------------------------------------------------------- queries

@register("class_counts", "G4", f"""{_MODAL_SPLIT}
SELECT class_id, count(*) AS n, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
FROM lab WHERE split = 'train' GROUP BY class_id""")
def q_class_counts(spark, sf_dir):
    return L.class_counts(label_long(spark, sf_dir).where(F.col("split") == "train"))


@register("class_weights", "G5 D4", f"""{_MODAL_SPLIT}, {_WEIGHTS}
SELECT class_id, {sig_sql('w0')} AS w0, {sig_sql('w1')} AS w1 FROM cw""")
def q_class_weights(spark, sf_dir):
    w = L.class_weights(label_long(spark, sf_dir).where(F.col("split") == "train"))
    return w.select("class_id", sig(F.col("w0")).alias("w0"), sig(F.col("w1")).alias("w1"))


def _split_once(spark, sf_dir):
    """The prepared rows with their split, written: weights and scores read them."""
    return materialize(modal_split(spark, sf_dir), "modal-split")


def _bce(spark, sf_dir):
    ms = _split_once(spark, sf_dir)
    w = L.class_weights(label_long(spark, sf_dir, ms).where(F.col("split") == "train"))
    return L.bce(modal_long(spark, sf_dir, ms), w, by=("split",), classes=range(C.NUM_CLASSES))


@register("bce_masked", "G6 P19 P22 J5 X3", f"""{_MODAL_SPLIT}, {_CODES}, {_WEIGHTS}, {_BCE}
SELECT split, class_id, {r('loss')} AS loss FROM bl""")
def q_bce(spark, sf_dir):
    return rounded(_bce(spark, sf_dir))


@register("bce_weighted_total", "G7", f"""{_MODAL_SPLIT}, {_CODES}, {_WEIGHTS}, {_BCE}
SELECT split, {r(f'sum(loss) / {float(C.NUM_CLASSES)}')} AS loss FROM bl GROUP BY split""")
def q_bce_total(spark, sf_dir):
    return rounded(L.total(_bce(spark, sf_dir), by=("split",), divide_by=C.NUM_CLASSES))


@register("asl_joint", "G8 F4 F5 F6", f"""{_MODAL_SPLIT}, {_CODES}, a AS ({_asl_sql('jl', 'split', C.GAMMAS_JOINT)})
SELECT split, class_id, {r('loss')} AS loss FROM a""")
def q_asl_joint(spark, sf_dir):
    return rounded(L.asymmetric(modal_long(spark, sf_dir), L.class_params(spark, C.GAMMAS_JOINT), by=("split",), classes=range(C.NUM_CLASSES)))


@register("asl_isolated_gammas", "G8 G9", f"""{_MODAL_SPLIT}, {_CODES}, a AS ({_asl_sql('jl', 'split', C.GAMMAS_ISOLATED)})
SELECT split, class_id, {r('loss')} AS loss FROM a""")
def q_asl_iso(spark, sf_dir):
    return rounded(L.asymmetric(modal_long(spark, sf_dir), L.class_params(spark, C.GAMMAS_ISOLATED), by=("split",), classes=range(C.NUM_CLASSES)))


@register("asl_total", "G11", f"""{_MODAL_SPLIT}, {_CODES}, a AS ({_asl_sql('jl', 'split', C.GAMMAS_JOINT)})
SELECT split, {r('sum(loss)')} AS loss FROM a GROUP BY split""")
def q_asl_total(spark, sf_dir):
    per = L.asymmetric(modal_long(spark, sf_dir), L.class_params(spark, C.GAMMAS_JOINT), by=("split",))
    return rounded(L.total(per, by=("split",)))


BCE_CLASSES = (1, 4, 6, 9, 11)  # of the mixed loss; the others have the asymmetric one


@register("loss_mixed", "X3 G6 G8: a loss function per class (weighted BCE for some, asymmetric with its own gamma for the others)", f"""{_MODAL_SPLIT}, {_CODES}, {_WEIGHTS}, {_BCE},
a AS ({_asl_sql('jl', 'split', C.GAMMAS_ISOLATED)})
SELECT split, class_id, {r('loss')} AS loss FROM bl WHERE class_id IN {BCE_CLASSES}
UNION ALL
SELECT split, class_id, {r('loss')} AS loss FROM a WHERE class_id NOT IN {BCE_CLASSES}""")
def q_loss_mixed(spark, sf_dir):
    ms = _split_once(spark, sf_dir)
    w = L.class_weights(label_long(spark, sf_dir, ms).where(F.col("split") == "train"))
    losses = L.class_losses(w, C.GAMMAS_ISOLATED, BCE_CLASSES)
    return rounded(L.mixed(modal_long(spark, sf_dir, ms), losses, by=("split",), classes=range(C.NUM_CLASSES)))


@register("delta_p", "G10 P22", f"""{_MODAL_SPLIT}, {_CODES}
SELECT split, class_id, {r(f'''CASE WHEN count(*) FILTER (WHERE {_VALID}) = 0 THEN {C.DELTA_P_DEFAULT} ELSE
   coalesce(avg(CASE WHEN {_VALID} AND y = 1 THEN {_SIG} END), {C.DELTA_P_DEFAULT})
 - coalesce(avg(CASE WHEN {_VALID} AND y = 0 THEN 1.0 - {_SIG} END), {C.DELTA_P_DEFAULT}) END''')} AS delta_p
FROM jl GROUP BY split, class_id""")
def q_delta_p(spark, sf_dir):
    return rounded(L.delta_p(modal_long(spark, sf_dir), by=("split",)))


@register("batch_numbers", "W4", f"""{_MODAL_SPLIT}
SELECT study_id, split, CAST(rn AS BIGINT) AS row_idx, CAST((rn - 1) // {C.BATCH_SIZE} + 1 AS BIGINT) AS batch_id
FROM (SELECT study_id, split, row_number() OVER (PARTITION BY split ORDER BY study_id) AS rn FROM ms)""")
def q_batches(spark, sf_dir):
    return B.batch_numbers(modal_split(spark, sf_dir), "study_id", partition=("split",)).select("study_id", "split", "row_idx", "batch_id")


@register("batch_numbers_nulls", "W4 with NULL partition values and a NULL key", f"""{_MODAL_SPLIT},
nn AS (SELECT CASE WHEN study_id = 7 THEN NULL ELSE study_id END AS study_id, CASE WHEN label = 3 THEN NULL ELSE split END AS split FROM ms)
SELECT study_id, split, CAST(rn AS BIGINT) AS row_idx, CAST((rn - 1) // {C.BATCH_SIZE} + 1 AS BIGINT) AS batch_id
FROM (SELECT study_id, split, row_number() OVER (PARTITION BY split ORDER BY study_id NULLS FIRST) AS rn FROM nn)""")
def q_batches_nulls(spark, sf_dir):
    d = modal_split(spark, sf_dir).select(
        F.when(F.col("study_id") != 7, F.col("study_id")).alias("study_id"),
        F.when(F.col("label") != 3, F.col("split")).alias("split"),
    )
    return B.batch_numbers(d, "study_id", partition=("split",)).select("study_id", "split", "row_idx", "batch_id")


@register("epoch_shuffle", "W5", f"""{_MODAL_SPLIT},
ep AS (SELECT CAST(range AS INTEGER) AS epoch FROM range(1, 3))
SELECT epoch, study_id, CAST((rn - 1) // {C.BATCH_SIZE} + 1 AS BIGINT) AS batch_id FROM (
  SELECT epoch, study_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('e' || CAST(epoch AS VARCHAR) || ':' || CAST(study_id AS VARCHAR)), study_id) AS rn
  FROM ms CROSS JOIN ep WHERE split = 'train')""")
def q_shuffle(spark, sf_dir):
    tr = modal_split(spark, sf_dir).where(F.col("split") == "train")
    out = B.epoch_batches(tr, "study_id", (1, 2), partition=())
    return out.select(F.col("epoch").cast("int").alias("epoch"), "study_id", "batch_id")


@register("epoch_shuffle_xxhash", "W5 (xxhash64 order: batch sizes, and the rows they hold)", f"""{_MODAL_SPLIT},
tr AS (SELECT (row_number() OVER () - 1) // {C.BATCH_SIZE} + 1 AS b FROM ms WHERE split = 'train')
SELECT CAST(b AS BIGINT) AS batch_id, count(*) AS n, CAST((SELECT sum(study_id) FROM ms WHERE split = 'train') AS BIGINT) AS id_sum
FROM tr GROUP BY b""")
def q_shuffle_xx(spark, sf_dir):
    tr = modal_split(spark, sf_dir).where(F.col("split") == "train").select("study_id")
    d = B.quantile_buckets(tr.withColumn("_k", B.shuffle_key("study_id", 1, method="xxhash")), "_k")
    ranked = ordered_prefix(d, "_k", F.col("_qbucket").cast("int"), rank="row_idx")
    per = ranked.groupBy((F.floor((F.col("row_idx") - 1) / C.BATCH_SIZE) + 1).cast("long").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("study_id").alias("_s")
    )
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per batch
    return per.select("batch_id", "n", F.sum("_s").over(every).alias("id_sum"))


def _zmodal_sql() -> str:
    rows = _feature_rows_sql("ms", "study_id, split")
    return f"""{_MODAL_SPLIT}, xl AS ({rows}),
st AS (SELECT modality, j, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM xl WHERE split = 'train' GROUP BY modality, j),
z AS (SELECT split, modality, j, CASE WHEN n < 2 THEN NULL WHEN s <> 0 THEN (x - m) / s ELSE x END AS x FROM xl JOIN st USING (modality, j))
SELECT split, modality, CAST(j AS INTEGER) AS idx, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null,
       {r('sum(x)', 6)} AS s1, {r('sum(x * x)', 6)} AS s2 FROM z GROUP BY split, modality, j"""


@register("zscore_modal", "G2 G3 on arrays (Summarizer)", _zmodal_sql())
def q_zmodal(spark, sf_dir):
    arrays = list(SPEC.stored_order)
    # a scaled array keeps its element type: double here
    ms = modal_split(spark, sf_dir).withColumns({m: F.col(m).cast("array<double>") for m in arrays})
    st = S.fit_stats(ms.where(F.col("split") == "train"), arrays, widths=SPEC.widths)
    z = S.apply_stats(ms, st, arrays)
    lf = long_features(z, arrays, SPEC.widths)
    agg = lf.groupBy("split", "modality", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"),
        F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"),
    )
    return rounded(agg, 6)


_WIDE_SQL = f"""{_MODAL_SPLIT},
wd AS (SELECT split, list_concat(embedding, list_reverse(embedding)) AS w FROM ms JOIN embeddings ON ms.study_id = embeddings.vec_id),
wl AS (SELECT split, CAST(unnest(w) AS DOUBLE) AS x, CAST(unnest(generate_series(0, 127)) AS INTEGER) AS idx FROM wd),
wst AS (SELECT idx, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n FROM wl WHERE split = 'train' GROUP BY idx),
wz AS (SELECT split, idx, CASE WHEN n < 2 THEN NULL WHEN s <> 0 THEN (x - m) / s ELSE x END AS x FROM wl JOIN wst USING (idx))
SELECT split, idx, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, {r('sum(x)', 6)} AS s1, {r('sum(x * x)', 6)} AS s2
FROM wz GROUP BY split, idx"""


@register("zscore_wide", "G2 G3 on a 128-wide array (the embedding, then itself reversed)", _WIDE_SQL)
def q_zwide(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("study_id"), F.concat("embedding", F.reverse("embedding")).cast("array<double>").alias("w")
    )
    ms = modal_split(spark, sf_dir).select("study_id", "split").join(e, "study_id")
    st = S.fit_stats(ms.where(F.col("split") == "train"), ["w"], {"w": 128})
    z = S.apply_stats(ms, st, ["w"])
    long = z.select("split", F.posexplode("w").alias("idx", "x"))
    return rounded(long.groupBy("split", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"),
        F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"),
    ), 6)


@register("modality_slices", "P14 P15 P20 F11", f"""WITH {fx.MODAL_SQL}, {_TOK},
sl AS ({' UNION ALL '.join(
    f"SELECT study_id, '{m}' AS modality, CAST(len({m}) AS INTEGER) AS width, list_sum(list_transform({m}, lambda x: CAST(x AS DOUBLE))) AS total FROM modal"
    for m in C.STORED_ORDER)})
SELECT study_id, CAST(t AS INTEGER) AS token_idx, modality, width, {r('total')} AS total FROM sl JOIN tok USING (modality)""")
def q_slices(spark, sf_dir):
    mo = fx.modal(spark, sf_dir)
    vec = mo.select("study_id", F.concat(*[F.col(m) for m in SPEC.stored_order]).cast("array<float>").alias("v"))
    offs = SPEC.offsets()
    toks = []
    for t, m in enumerate(C.TOKEN_ORDER):
        a, b = offs[m]
        sl = F.slice("v", a + 1, b - a)
        toks.append(F.struct(
            F.lit(t).alias("token_idx"), F.lit(m).alias("modality"), F.size(sl).alias("width"),
            F.aggregate(sl, F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("total"),
        ))
    out = vec.select("study_id", F.explode(F.array(*toks)).alias("t")).select("study_id", "t.*")
    return rounded(out)


@register("encode_small", "M1 M3 S2", f"""{_MODAL_SPLIT}, {_CODES}
SELECT study_id, modality, i AS out_idx, {r('code')} AS code FROM code""")
def q_encode(spark, sf_dir):
    e = SC.encode(modal_split(spark, sf_dir), fixture_weights(spark), SPEC.stored_order)
    return rounded(_codes_long(e))


def _codes_long(e):
    parts = [
        F.transform(F.col(f"code_{m}"), (lambda mm: lambda x, i: F.struct(F.lit(mm).alias("modality"), i.alias("out_idx"), x.alias("code")))(m))
        for m in SPEC.stored_order
    ]
    return e.select("study_id", F.explode(F.concat(*parts)).alias("c")).select("study_id", "c.*")


@register("encode_small_sql", "M1 (all-JVM path)", f"""{_MODAL_SPLIT}, {_CODES}
SELECT study_id, modality, i AS out_idx, {r('code')} AS code FROM code""")
def q_encode_sql(spark, sf_dir):
    e = SC.encode_sql(modal_split(spark, sf_dir), fixture_weights(spark), SPEC.stored_order)
    return rounded(_codes_long(e))


@register("encode_blocked", "S2 M1: weights in blocks of at most 100 values, partial codes summed; nothing broadcast", f"""{_MODAL_SPLIT}, {_CODES}
SELECT study_id, modality, i AS out_idx, {r('code')} AS code FROM code""")
def q_encode_blocked(spark, sf_dir):
    ms = modal_split(spark, sf_dir).select("study_id", *SPEC.stored_order)
    table = SC.rule_weights(spark, SPEC, LATENT)
    return rounded(_codes_long(SC.encode_blocked(ms, table, SPEC.widths, SPEC.stored_order, key="study_id", block_values=100)))


@register("decode_mse", "M2 G12", f"""{_MODAL_SPLIT}, {_CODES}
SELECT split, modality, {r('sum((xhat - x) * (xhat - x)) / count(*)')} AS mse FROM recon GROUP BY split, modality""")
def q_decode_mse(spark, sf_dir):
    return rounded(L.mse_of_sums(_errors(spark, sf_dir), SPEC.stored_order, by=("split",)))


def _errors(spark, sf_dir):
    """Logits and squared errors in one pass, read once: nothing is written."""
    return SC.encode_decode_score(modal_split(spark, sf_dir), fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=KEEP)


@register("joint_scores", "M4 X4 F10 F11", f"""{_MODAL_SPLIT}, {_CODES}
SELECT study_id, class_id, {r('z')} AS logit FROM joint""")
def q_joint(spark, sf_dir):
    s = SC.encode_and_score(modal_split(spark, sf_dir), fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=["study_id"])
    return rounded(s.select("study_id", F.posexplode("logits").alias("class_id", "logit")))


# the nearest half-precision value of a code (a code is never negative)
_HALF = """CASE WHEN code = 0 THEN 0.0 WHEN code >= 65520 THEN CAST('inf' AS DOUBLE)
     ELSE round_even(code / pow(2, greatest(e, -14) - 10), 0) * pow(2, greatest(e, -14) - 10) END"""


_HALF_CODES = f"""{_MODAL_SPLIT}, {_CODES},
ex AS (SELECT *, CASE WHEN code = 0 THEN 0 ELSE floor(log2(code)) END AS e0 FROM code),
hc AS (SELECT study_id, modality, i, {_HALF} AS code FROM (SELECT *, CASE WHEN pow(2, e0) > code THEN e0 - 1 WHEN pow(2, e0 + 1) <= code THEN e0 + 1 ELSE e0 END AS e FROM ex))"""


@register("codes_half", "F12: codes rounded to half precision by built-in functions", f"""{_HALF_CODES}
SELECT study_id, modality, i AS out_idx, code FROM hc""")
def q_codes_half(spark, sf_dir):
    e = SC.encode(modal_split(spark, sf_dir), fixture_weights(spark), SPEC.stored_order)
    return _codes_long(e.select("study_id", *[F.transform(f"code_{m}", half).alias(f"code_{m}") for m in SPEC.stored_order]))


@register("joint_scores_half", "M4 F12: scores of half-precision codes, one Python pass", f"""{_HALF_CODES},
hj AS (SELECT c.study_id, k.class_id, sum(cos(5 * k.pos + 3 * (tok.t * {LATENT} + c.i)) * 0.25 * c.code) AS z
       FROM hc c JOIN tok USING (modality) CROSS JOIN cls k GROUP BY c.study_id, k.class_id)
SELECT study_id, class_id, {r('z')} AS logit FROM hj""")
def q_joint_half(spark, sf_dir):
    s = SC.encode_and_score(
        modal_split(spark, sf_dir), fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=["study_id"], half=True
    )
    return rounded(s.select("study_id", F.posexplode("logits").alias("class_id", "logit")))


@register("isolated_scores", "M5 X4", f"""{_MODAL_SPLIT}, {_CODES}
SELECT study_id, modality, class_id, {r('z')} AS logit FROM iso""")
def q_iso(spark, sf_dir):
    iso = SC.encode_and_score_isolated(modal_split(spark, sf_dir), fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=["study_id"])
    return rounded(iso.select("study_id", "modality", F.posexplode("logits").alias("class_id", "logit")))


BY_BATCH = ("split", "batch_id")


def _batch_losses(spark, sf_dir, factor=1.0):
    """(narrow scores, reported loss per split and batch)."""
    b = materialize(scored(spark, sf_dir, factor=factor), "batched")
    return b, L.batch_losses(b, C.TOKEN_ORDER, L.class_params(spark, C.GAMMAS_JOINT), by=BY_BATCH)


_COMBINED_SQL = f"""ab AS ({_asl_sql('jl', 'split, batch_id', C.GAMMAS_JOINT)}),
lb AS (SELECT split, batch_id, sum(loss) AS l FROM ab GROUP BY split, batch_id),
cb AS (SELECT split, batch_id, l + {C.BETA} * sum(mse) AS loss FROM lb JOIN mse_b USING (split, batch_id) GROUP BY split, batch_id, l)"""


@register("loss_combined", "G13 G14 M8", f"""{_MODAL_SPLIT}, {_CODES}, {_COMBINED_SQL}
SELECT split, batch_id, {r('loss')} AS loss FROM cb""")
def q_loss_combined(spark, sf_dir):
    return rounded(_batch_losses(spark, sf_dir)[1])


@register("epoch_loss", "G16 M8", f"""{_MODAL_SPLIT}, {_CODES}, {_COMBINED_SQL}
SELECT split, {r('avg(loss)')} AS epoch_loss, count(*) AS n_batches FROM cb GROUP BY split""")
def q_epoch_loss(spark, sf_dir):
    return rounded(L.epoch_loss(_batch_losses(spark, sf_dir)[1], by=("split",)))


@register("loss_isolated", "G15 M5 D5", f"""{_MODAL_SPLIT}, {_CODES},
ai AS ({_asl_sql('il', 'split, batch_id, modality', C.GAMMAS_ISOLATED)}),
li AS (SELECT split, batch_id, modality, sum(loss) AS l FROM ai GROUP BY split, batch_id, modality)
SELECT split, batch_id, {r(f'sum(l + {C.BETA} * mse)')} AS loss
FROM li JOIN mse_b USING (split, batch_id, modality) GROUP BY split, batch_id""")
def q_loss_iso(spark, sf_dir):
    b = materialize(scored(spark, sf_dir, isolated=True), "batched")
    return rounded(L.isolated_batch_losses(b, C.TOKEN_ORDER, L.class_params(spark, C.GAMMAS_ISOLATED), by=BY_BATCH))


_VAL_BCE_SQL = f"""{_WEIGHTS},
vb AS (SELECT batch_id, class_id, coalesce(avg(CASE WHEN {_VALID} THEN
          (CASE WHEN y = 1 THEN w1 ELSE w0 END) * (greatest(z, 0.0) - z * y + ln(1 + exp(-abs(z)))) END), 0.0) AS loss
        FROM jl JOIN cw USING (class_id) WHERE split = 'val' GROUP BY batch_id, class_id),
vl AS (SELECT batch_id, sum(loss) / {float(C.NUM_CLASSES)} AS l FROM vb GROUP BY batch_id),
vc AS (SELECT batch_id, l + {C.BETA} * sum(mse) AS loss FROM vl JOIN (SELECT * FROM mse_b WHERE split = 'val') USING (batch_id) GROUP BY batch_id, l)"""


def _validation(spark, sf_dir, loss):
    ms = modal_split(spark, sf_dir)
    head = fx.vocab_matrix(N_TOK * LATENT, C.VOCAB_POSITIONS)
    weights = L.class_weights(label_long(spark, sf_dir).where(F.col("split") == "train")) if loss == "bce" else None
    out = PL.validation_loss(
        ms.where(F.col("split") == "val"), fixture_weights(spark), head, C.TOKEN_ORDER, key="study_id", loss=loss, class_w=weights
    )
    return rounded(out.select(F.col("loss").alias("epoch_loss"), "n_batches"))


@register("validate_joint", "M8 G16: validation loss of the pipeline, mean of batch losses", f"""{_MODAL_SPLIT}, {_CODES}, {_COMBINED_SQL}
SELECT {r('avg(loss)')} AS epoch_loss, count(*) AS n_batches FROM cb WHERE split = 'val'""")
def q_validate_joint(spark, sf_dir):
    return _validation(spark, sf_dir, "asl")


@register("validate_bce", "M8 G16 G7: the same with class-weighted BCE", f"""{_MODAL_SPLIT}, {_CODES}, {_VAL_BCE_SQL}
SELECT {r('avg(loss)')} AS epoch_loss, count(*) AS n_batches FROM vc""")
def q_validate_bce(spark, sf_dir):
    return _validation(spark, sf_dir, "bce")


def _modal_eval_sql(rest: str) -> str:
    # a scope of its own: the report's CTEs share names with the split's
    return f"""{_MODAL_SPLIT}, {_CODES},
ev AS (SELECT class_id, y, {_SIG} AS p, CASE WHEN {_SIG} > 0.5 THEN 1 ELSE 0 END AS pred FROM jl WHERE split = 'val')
SELECT * FROM (WITH sp AS (SELECT * FROM ev), {rest})"""


def modal_counts(spark, sf_dir):
    """Count table of the validation split's scores: the one scorer pass."""
    val = modal_split(spark, sf_dir).where(F.col("split") == "val")
    s = SC.encode_and_score(val, fixture_weights(spark), fixture_scorer(), C.TOKEN_ORDER, keep=["study_id", "y"])
    return M.count_table(M.predict(L.to_long(s, keep=("study_id",), y="y", z="logits")))


@register("modal_eval_report", "E3 end to end: M1 M4 M6 G17-G22 G24 on the validation split", _modal_eval_sql(EV.report_sql()))
def q_modal_report(spark, sf_dir):
    return rounded(M.report_of(modal_counts(spark, sf_dir)))


@register("modal_eval_roc", "E3 end to end: ROC points of the validation split", _modal_eval_sql(EV.roc_sql()))
def q_modal_roc(spark, sf_dir):
    return rounded(M.roc_points_of(modal_counts(spark, sf_dir)))
