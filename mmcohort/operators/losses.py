"""Masked multi-label losses as aggregations over the long (row, class) table.

Every loss is an expression per (row, class) followed by a grouped average:
partial aggregation runs map-side, the shuffle carries one row per group per
partition. Masked rows (label NULL / NaN / 2) contribute nothing; a group
with no valid row gets the documented default (loss 0.0, delta-p 0.1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.functions.columns import required, sigmoid, sq_err_sum, valid_label


def to_long(df: DataFrame, *, keep: Sequence[str] = ("study_id",), y: str = "y", z: str = "logits") -> DataFrame:
    """(keep..., class_id, y, z): one row per (row, class) from the label and logit arrays."""
    return df.select(*keep, F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(z).alias("z"))).alias("class_id", "_yz")).select(
        *keep, "class_id", F.col("_yz.y").cast("double").alias("y"), F.col("_yz.z").cast("double").alias("z")
    )


def class_params(spark: SparkSession, gammas: Sequence[float] = C.GAMMAS_JOINT, names: Sequence[str] = C.CLASS_NAMES) -> DataFrame:
    """(class_id, name, gamma): a tiny per-class parameter table (joined by broadcast)."""
    rows = [(i, names[i] if i < len(names) else f"class_{i}", float(g)) for i, g in enumerate(gammas)]
    return spark.createDataFrame(rows, "class_id int, name string, gamma double")


# -- class weights -------------------------------------------------------------

def class_counts(long: DataFrame, *, y: str = "y") -> DataFrame:
    """(class_id, n, n0, n1): n counts every row (missing and uncertain labels too)."""
    yc = F.col(y)
    return long.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(yc == 0).cast("long").alias("n0"),
        F.count_if(yc == 1).cast("long").alias("n1"),
    )


def class_weights(long: DataFrame, *, k: int = C.BCE_K, eps: float = C.BCE_EPS, y: str = "y") -> DataFrame:
    """Inverse-frequency weights w_v = n / (2 k n_v + eps) for v in {0, 1}."""
    c = class_counts(long, y=y)
    n = F.col("n").cast("double")
    return c.select(
        "class_id",
        (n / (F.lit(2.0 * k) * F.col("n0") + F.lit(eps))).alias("w0"),
        (n / (F.lit(2.0 * k) * F.col("n1") + F.lit(eps))).alias("w1"),
    )


# -- per-row terms ---------------------------------------------------------------

def bce_term(z: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy with logits."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def asl_term(z: Column, y: Column, gamma: Column, *, clip: float = C.ASL_CLIP, eps: float = C.ASL_EPS) -> Column:
    """Asymmetric-loss summand (before the minus sign and the mean)."""
    p = sigmoid(z)
    pm = F.greatest(p - F.lit(clip), F.lit(0.0))
    pos = y * (F.lit(1.0) - p) * F.ln(F.greatest(p, F.lit(eps)))
    neg = (F.lit(1.0) - y) * F.pow(pm, gamma) * F.ln(F.greatest(F.lit(1.0) - pm, F.lit(eps)))
    return pos + neg


# -- grouped losses ----------------------------------------------------------------

def _class_losses(terms: DataFrame, by: Sequence[str], sign: float, classes: Sequence[int] | None) -> DataFrame:
    """Mean of ``_term`` per (by..., class), 0.0 where there is none. With
    ``classes`` every group gets each of them, seen or not."""
    per = terms.groupBy(*by, "class_id").agg(F.coalesce(F.lit(sign) * F.avg("_term"), F.lit(0.0)).alias("loss"))
    if classes is None:
        return per
    held = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("class_id", "loss"))).alias("_l"))
    every = held.select(*by, "_l", F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class_id"))
    return every.select(*by, "class_id", F.coalesce(F.get(F.map_values(F.map_filter("_l", lambda k, _: k == F.col("class_id"))), F.lit(0)), F.lit(0.0)).alias("loss"))


def bce(long: DataFrame, weights: DataFrame, *, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """Weighted masked BCE per (by..., class): mean over valid rows of w_y * term; empty -> 0.0.

    A class with valid rows but no weight fails the job; ``classes`` adds
    those without any row."""
    j = long.join(weights.select("class_id", "w0", "w1"), "class_id", "left")
    w = required(F.when(F.col("y") == 1, F.col("w1")).otherwise(F.col("w0")), "a class has no weights")
    term = F.when(valid_label("y"), w * bce_term(F.col("z"), F.col("y")))
    return _class_losses(j.withColumn("_term", term), by, 1.0, classes)


def asymmetric(
    long: DataFrame, params: DataFrame, *, by: Sequence[str] = (), clip: float = C.ASL_CLIP, eps: float = C.ASL_EPS,
    classes: Sequence[int] | None = None,
) -> DataFrame:
    """Asymmetric loss per (by..., class): -mean over valid rows; empty -> 0.0.

    ``params`` carries ``gamma`` per class_id; a class with valid rows but no
    gamma fails the job; ``classes`` adds those without any row.
    """
    j = long.join(params.select("class_id", "gamma"), "class_id", "left")
    gamma = required("gamma", "a class has no gamma")
    term = F.when(valid_label("y"), asl_term(F.col("z"), F.col("y"), gamma, clip=clip, eps=eps))
    return _class_losses(j.withColumn("_term", term), by, -1.0, classes)


# -- a loss function per class --------------------------------------------------------

#: name -> (z, y, parameters as columns) -> loss of one row, before the mean
LOSS_TERMS: dict[str, Callable[[Column, Column, dict[str, Column]], Column]] = {
    "bce": lambda z, y, p: F.when(y == 1, p["w1"]).otherwise(p["w0"]) * bce_term(z, y),
    "asl": lambda z, y, p: -asl_term(z, y, p["gamma"]),
}
LOSS_DEFAULTS: dict[str, dict[str, float]] = {"bce": {"w0": 1.0, "w1": 1.0}, "asl": {}}


def register_loss(name: str, term: Callable[[Column, Column, dict[str, Column]], Column], **defaults: float) -> None:
    """Make ``term(z, y, parameters)`` available to :class:`ClassLoss` as ``name``."""
    if name in LOSS_TERMS:
        raise ValueError(f"loss {name!r} exists")
    LOSS_TERMS[name], LOSS_DEFAULTS[name] = term, dict(defaults)


@dataclass(frozen=True)
class ClassLoss:
    """The loss function of one class and its parameters."""

    name: str
    params: Mapping[str, float] = field(default_factory=dict)

    def values(self) -> dict[str, float]:
        if self.name not in LOSS_TERMS:
            raise ValueError(f"unknown loss {self.name!r}; known: {sorted(LOSS_TERMS)}")
        return {**LOSS_DEFAULTS[self.name], **self.params}


def mixed_term(z: Column, y: Column, class_id: Column, losses: Mapping[int, ClassLoss]) -> Column:
    """One CASE over the class: classes of one function share its branch, in
    which their parameters are a CASE of literals. A class without a loss fails
    the job."""
    by_name: dict[str, list[int]] = {}
    for k, c in losses.items():
        by_name.setdefault(c.name, []).append(int(k))
    out = None
    for name, classes in by_name.items():
        values = {k: losses[k].values() for k in classes}
        params = {}
        for p in sorted({p for v in values.values() for p in v}):
            missing = [k for k in classes if p not in values[k]]
            if missing:
                raise ValueError(f"classes {missing} lack the parameter {p!r} of {name!r}")
            groups: dict[float, list[int]] = {}
            for k in classes:
                groups.setdefault(float(values[k][p]), []).append(k)
            first, *rest = groups
            expr = F.lit(first)
            for v in rest:
                expr = F.when(class_id.isin(groups[v]), F.lit(v)).otherwise(expr)
            params[p] = expr
        branch = LOSS_TERMS[name](z, y, params)
        out = F.when(class_id.isin(classes), branch) if out is None else out.when(class_id.isin(classes), branch)
    missing = F.raise_error(F.concat(F.lit("no loss for class "), class_id.cast("string"))).cast("double")
    return missing if out is None else out.otherwise(missing)


def mixed(long: DataFrame, losses: Mapping[int, ClassLoss], *, by: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """Loss per (by..., class), each class by its own function: mean over valid
    rows, empty -> 0.0. Parameters are literals of the plan (a few per class), no join."""
    term = F.when(valid_label("y"), mixed_term(F.col("z"), F.col("y"), F.col("class_id"), losses))
    return _class_losses(long.withColumn("_term", term), by, 1.0, classes)


def class_losses(weights: DataFrame | None, gammas: Sequence[float], bce_classes: Sequence[int]) -> dict[int, ClassLoss]:
    """Losses of the study: weighted BCE for ``bce_classes`` (weights of
    :func:`class_weights`, one row per class), the asymmetric loss for the others."""
    w = {r["class_id"]: r for r in weights.collect()} if weights is not None else {}  # one row per class
    out = {}
    for k, g in enumerate(gammas):
        if k in bce_classes:
            out[k] = ClassLoss("bce", {"w0": w[k]["w0"], "w1": w[k]["w1"]} if k in w else {})
        else:
            out[k] = ClassLoss("asl", {"gamma": float(g)})
    return out


def delta_p(long: DataFrame, *, by: Sequence[str] = (), default: float = C.DELTA_P_DEFAULT) -> DataFrame:
    """mean(p | y=1) - mean(1-p | y=0); a side without rows counts ``default``; an empty class is ``default``."""
    v = valid_label("y")
    p = sigmoid(F.col("z"))
    yc = F.col("y")
    return long.groupBy(*by, "class_id").agg(
        F.when(
            F.count_if(v) == 0, F.lit(default)
        ).otherwise(
            F.coalesce(F.avg(F.when(v & (yc == 1), p)), F.lit(default))
            - F.coalesce(F.avg(F.when(v & (yc == 0), F.lit(1.0) - p)), F.lit(default))
        ).alias("delta_p")
    )


def total(per_class: DataFrame, *, by: Sequence[str] = (), col: str = "loss", divide_by: int | None = None) -> DataFrame:
    """Sum of class losses per group; ``divide_by`` = 12 gives the BCE convention (always 12)."""
    s = F.sum(col)
    if divide_by:
        s = s / F.lit(float(divide_by))
    return per_class.groupBy(*by).agg(s.alias("loss"))


# -- reconstruction ------------------------------------------------------------------

def mse(df: DataFrame, pairs: dict, *, by: Sequence[str] = ()) -> DataFrame:
    """Per (by..., modality): sum of squared errors / number of elements.

    ``pairs`` maps modality -> (input array column, reconstruction array column).
    One aggregate computes the sums of every modality (one pass over ``df``);
    ``stack`` then turns them into one row per modality.
    """
    mods = list(pairs)
    aggs = []
    for i, m in enumerate(mods):
        x, xh = pairs[m]
        aggs += [F.sum(sq_err_sum(x, xh)).alias(f"_se{i}"), F.sum(F.size(x)).cast("double").alias(f"_n{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    stacked = ", ".join(f"'{m}', `_se{i}` / `_n{i}`" for i, m in enumerate(mods))
    return wide.selectExpr(*[f"`{c}`" for c in by], f"stack({len(mods)}, {stacked}) AS (modality, mse)")


def mse_of_sums(per_row: DataFrame, modalities: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """:func:`mse` from per-row sums ``_se_<m>`` and counts ``_n_<m>`` (the narrow
    output of the fused scoring passes): no code or reconstruction is needed."""
    aggs = [F.sum(f"_{k}_{m}").alias(f"_{k}_{m}") for m in modalities for k in ("se", "n")]
    stacked = ", ".join(f"'{m}', `_se_{m}` / `_n_{m}`" for m in modalities)
    wide = per_row.groupBy(*by).agg(*aggs)
    return wide.selectExpr(*[f"`{c}`" for c in by], f"stack({len(modalities)}, {stacked}) AS (modality, mse)")


def combined(asl_total: DataFrame, mse_df: DataFrame, *, by: Sequence[str], beta: float = C.BETA, main: str | None = None) -> DataFrame:
    """Reported loss L + beta * sum_i mse_i per group (the value the training loop
    logs); ``main`` names a column to keep L in."""
    m = mse_df.groupBy(*by).agg(F.sum("mse").alias("_mse_sum"))
    bare = [F.col("loss").alias(main)] if main else []
    return asl_total.join(m, list(by)).select(*by, *bare, (F.col("loss") + F.lit(beta) * F.col("_mse_sum")).alias("loss"))


def epoch_loss(batch_losses: DataFrame, *, by: Sequence[str] = ("split",)) -> DataFrame:
    """Unweighted mean of batch losses (a short last batch weighs as a full one)."""
    return batch_losses.groupBy(*by).agg(F.avg("loss").alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))


def batch_losses(
    scored: DataFrame, modalities: Sequence[str], params: DataFrame | Mapping[int, ClassLoss], *, by: Sequence[str], beta: float = C.BETA,
    loss: str = "asl", n_classes: int = C.NUM_CLASSES, main: str | None = None,
) -> DataFrame:
    """Reported loss per group from narrow scores (y, logits, _se_<m>, _n_<m>).

    ``loss`` "asl": asymmetric loss summed over classes, ``params`` with
    ``gamma``; "bce": weighted BCE averaged over ``n_classes``, ``params`` with
    ``w0``, ``w1``; "mixed": each class by its own function, ``params`` a mapping
    class -> :class:`ClassLoss`, summed. Plus ``beta`` times the summed
    reconstruction errors; ``main`` names a column for the part without them.
    """
    lg = to_long(scored, keep=by, y="y", z="logits")
    if loss == "mixed":
        per = total(mixed(lg, params, by=by), by=by)
    elif loss == "bce":
        per = total(bce(lg, params, by=by), by=by, divide_by=n_classes)
    else:
        per = total(asymmetric(lg, params, by=by), by=by)
    return combined(per, mse_of_sums(scored, modalities, by=by), by=by, beta=beta, main=main)


def isolated_batch_losses(
    scored: DataFrame, token_order: Sequence[str], params: DataFrame, *, by: Sequence[str], beta: float = C.BETA
) -> DataFrame:
    """Isolated loss per group: sum over modalities of (asymmetric loss of the
    modality's own logits + ``beta`` x its reconstruction error), from narrow
    scores with one array of logits per token in ``_iso``."""
    names = F.array(*[F.lit(m) for m in token_order])
    tok = scored.select(*by, "y", F.posexplode("_iso").alias("_t", "logits")).withColumn("modality", F.get(names, F.col("_t")))
    groups = [*by, "modality"]
    per = total(asymmetric(to_long(tok, keep=groups, y="y", z="logits"), params, by=groups), by=groups)
    j = per.join(mse_of_sums(scored, token_order, by=by), groups)
    return j.groupBy(*by).agg(F.sum(F.col("loss") + F.lit(beta) * F.col("mse")).alias("loss"))
