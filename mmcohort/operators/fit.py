"""Data-parallel projector fit with a frozen linear head.

One optimisation step = one Spark job:

1. the current parameters are broadcast;
2. ``mapInArrow`` computes, per partition, the gradient SUM of
   L + beta * sum_m mse_m (asymmetric loss through the frozen head, masked per
   class, and reconstruction error) and the loss sums — one row per partition;
3. the gradient is cut in chunks (a row per chunk per partition) and
   ``Summarizer.sum`` adds them per chunk in the JVM, so the reduction of a
   model-sized vector is spread over many tasks instead of one;
4. the driver clips each projector's gradient norm and takes an Adam step
   (L2 weight decay added to the gradient), then re-broadcasts.

Means are global: the per-class valid-row counts N_c and the row count are
computed once before the first step, so partition sums add up exactly to the
full-batch gradient. The batch is the whole training split, not 32 rows;
pass a materialized (written) training table so every step re-reads columnar
data instead of recomputing its lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mmcohort import config as C
from mmcohort.functions.columns import valid_label

PARAM_NAMES = ("W", "b", "V", "c")


def _flatten(params: dict, mods: Sequence[str]) -> np.ndarray:
    return np.concatenate([params[m][k].astype(np.float64).ravel() for m in mods for k in PARAM_NAMES])


def _unflatten(vec: np.ndarray, like: dict, mods: Sequence[str]) -> dict:
    out, pos = {}, 0
    for m in mods:
        out[m] = {}
        for k in PARAM_NAMES:
            shape = like[m][k].shape
            n = int(np.prod(shape))
            out[m][k] = vec[pos: pos + n].reshape(shape)
            pos += n
    return out


def _asl(Z: np.ndarray, y: np.ndarray, valid: np.ndarray, inv_n: np.ndarray, g: np.ndarray, clip: float, eps: float):
    """Asymmetric loss summed over classes (each class: -mean over its valid rows) and dL/dZ."""
    P = 1.0 / (1.0 + np.exp(-Z))
    pm = np.maximum(P - clip, 0.0)
    lp = np.log(np.maximum(P, eps))
    ln_ = np.log(np.maximum(1.0 - pm, eps))
    pmg = np.power(pm, g)
    ell = y * (1 - P) * lp + (1 - y) * pmg * ln_
    L = float(-(np.where(valid, ell, 0.0) * inv_n).sum())
    # d ell / d p
    d_pos = y * (-lp + (1 - P) * np.where(P > eps, 1.0 / np.maximum(P, eps), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        pmg1 = np.where(g > 0, g * np.power(np.where(pm > 0, pm, 1.0), g - 1) * (pm > 0), 0.0)
    d_pm = pmg1 * ln_ + pmg * np.where(1 - pm > eps, -1.0 / np.maximum(1 - pm, eps), 0.0)
    d_neg = (1 - y) * d_pm * (P - clip > 0)
    return L, -(d_pos + d_neg) * P * (1 - P) * inv_n * valid


def loss_and_grad(
    X: dict, Y: np.ndarray, params: dict, head: np.ndarray, token_order: Sequence[str], gammas: np.ndarray,
    n_valid: np.ndarray, n_rows: float, *, beta: float = C.BETA, clip: float = C.ASL_CLIP, eps: float = C.ASL_EPS,
    shared_mult: dict | None = None, dp_sums: bool = False, loss: str = "asl", class_w: np.ndarray | None = None,
    isolated: bool = False,
):
    """Loss sums and gradient sums for one block of rows.

    X: modality -> (B, d) inputs; Y: (B, K) labels (NaN / 2 masked); head: (K, T*latent).
    ``loss``: "asl" (asymmetric, summed over classes; ``gammas``) or "bce"
    (weighted BCE with ``class_w`` (K, 2) = (w0, w1), averaged over the K classes).
    ``isolated`` (asl only): every modality's code is scored alone as a
    one-token sequence (head columns of the first position) and the loss is
    the sum of the modalities' losses; delta-p sums then come from the joint logits.
    Returns (L_sum, {m: se_sum/(n_rows d)}, grads dict like params).
    """
    if loss not in ("asl", "bce"):
        raise ValueError("loss must be 'asl' or 'bce'")
    if isolated and loss != "asl":
        raise ValueError("the isolated variant uses the asymmetric loss")
    mult = shared_mult or {}
    H, A, R = {}, {}, {}
    for m in token_order:
        p = params[m]
        A[m] = X[m] @ p["W"].T + p["b"]
        H[m] = np.maximum(A[m], 0.0)
        R[m] = H[m] @ p["V"].T + p["c"]
    lat = params[token_order[0]]["W"].shape[0]
    Fl = np.concatenate([H[m] for m in token_order], axis=1)
    Z = Fl @ head.T
    P = 1.0 / (1.0 + np.exp(-Z))
    valid = ~np.isnan(Y) & (Y != 2)
    y = np.where(valid, Y, 0.0)
    inv_n = np.where(n_valid > 0, 1.0 / np.maximum(n_valid, 1), 0.0)[None, :]
    if loss == "bce":
        k = Z.shape[1]
        w = np.where(y == 1, class_w[None, :, 1], class_w[None, :, 0])
        term = np.maximum(Z, 0.0) - Z * y + np.log1p(np.exp(-np.abs(Z)))
        L = float((np.where(valid, w * term, 0.0) * inv_n).sum() / k)
        dF = (np.where(valid, w * (P - y), 0.0) * inv_n / k) @ head
    elif isolated:
        h1 = head[:, :lat]
        L, parts = 0.0, []
        for m in token_order:
            Lm, dZm = _asl(H[m] @ h1.T, y, valid, inv_n, gammas[None, :], clip, eps)
            L += Lm
            parts.append(dZm @ h1)
        dF = np.concatenate(parts, axis=1)
    else:
        L, dZ = _asl(Z, y, valid, inv_n, gammas[None, :], clip, eps)
        dF = dZ @ head
    return _backprop(X, params, token_order, H, A, R, P, valid, y, L, dF, n_rows, beta, mult, dp_sums)


def _backprop(X, params, token_order, H, A, R, P, valid, y, L, dF, n_rows, beta, mult, dp_sums):
    """Gradients of L (given dL/d codes, (B, T*latent)) + beta * sum_m mse_m through the projectors."""
    grads, mse = {}, {}
    lat = params[token_order[0]]["W"].shape[0]
    for t, m in enumerate(token_order):
        p = params[m]
        d = X[m].shape[1]
        diff = R[m] - X[m]
        mse[m] = float((diff * diff).sum() / (n_rows * d))
        dR = beta * 2.0 * diff / (n_rows * d)
        dV = dR.T @ H[m]
        dc = dR.sum(axis=0)
        dH = mult.get(m, 1.0) * dF[:, t * lat:(t + 1) * lat] + dR @ p["V"]
        dA = dH * (A[m] > 0)
        grads[m] = {"W": dA.T @ X[m], "b": dA.sum(axis=0), "V": dV, "c": dc}
    if dp_sums:
        # per class: sum p over y=1, count y=1, sum 1-p over y=0, count y=0 (for delta-p)
        pos, neg = valid & (y == 1), valid & (y == 0)
        sums = np.concatenate([(P * pos).sum(axis=0), pos.sum(axis=0), ((1 - P) * neg).sum(axis=0), neg.sum(axis=0)])
        return L, mse, grads, sums
    return L, mse, grads


def delta_p_from_sums(sums: np.ndarray, k: int, default: float = C.DELTA_P_DEFAULT) -> np.ndarray:
    """Delta-p per class from the sums of :func:`loss_and_grad` (a side without rows counts ``default``)."""
    sp, npos, sn, nneg = sums[:k], sums[k:2 * k], sums[2 * k:3 * k], sums[3 * k:]
    mp = np.where(npos > 0, sp / np.maximum(npos, 1), default)
    mn = np.where(nneg > 0, sn / np.maximum(nneg, 1), default)
    return np.where(npos + nneg > 0, mp - mn, default)


@dataclass
class FitState:
    params: dict
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)
    t: int = 0


def adam_step(state: FitState, grads: dict, mods: Sequence[str], *, lr: float, wd: float, max_norm: float) -> None:
    """Per-projector grad-norm clip, then Adam with L2 weight decay (added to the gradient)."""
    state.t += 1
    b1, b2, e = 0.9, 0.999, 1e-8
    for m in mods:
        norm = np.sqrt(sum(float((grads[m][k] ** 2).sum()) for k in PARAM_NAMES))
        scale = min(1.0, max_norm / (norm + 1e-6))
        for k in PARAM_NAMES:
            key = (m, k)
            g = grads[m][k] * scale + wd * state.params[m][k]
            state.m[key] = b1 * state.m.get(key, 0.0) + (1 - b1) * g
            state.v[key] = b2 * state.v.get(key, 0.0) + (1 - b2) * g * g
            mh = state.m[key] / (1 - b1 ** state.t)
            vh = state.v[key] / (1 - b2 ** state.t)
            state.params[m][k] = state.params[m][k] - lr * mh / (np.sqrt(vh) + e)


def fit_projectors(
    train: DataFrame,
    init: dict,
    head: np.ndarray,
    *,
    token_order: Sequence[str] = C.TOKEN_ORDER,
    gammas: Sequence[float] = C.GAMMAS_JOINT,
    steps: int = 1,
    lr: float = C.LEARNING_RATE,
    weight_decay: float = C.WEIGHT_DECAY,
    max_norm: float = C.GRAD_CLIP,
    beta: float = C.BETA,
    accumulate_shared: bool = False,
    y: str = "y",
    chunk_size: int = 1 << 16,
    max_tasks: int | None = None,
    state: "FitState | None" = None,
    loss: str = "asl",
    class_w: np.ndarray | None = None,
    isolated: bool = False,
):
    """Fit the projectors on ``train`` (rows with modality arrays and label array ``y``).

    ``init``: modality -> {W, b, V, c} NumPy arrays. Returns (params, history list of
    dicts with step, loss, asl, mse). ``accumulate_shared`` reproduces the
    source's accumulation of the shared loss gradient ((j+1)-fold for the j-th projector).
    Pass a ``state`` (a :class:`FitState`) to continue a fit across calls
    (Adam moments kept); ``init`` is then ignored. History entries carry the
    training delta-p per class from the same forward pass.

    Every task emits one model-sized gradient, so the input is coalesced (no
    shuffle) to at most ``max_tasks`` partitions (default: the cluster's
    parallelism): the gradient traffic per step is bounded by cores x model
    size, not by the number of input splits.
    """
    spark = train.sparkSession
    mods = list(token_order)
    k = len(gammas)
    # global normalisers (one aggregate job)
    counts = train.select(F.posexplode(y).alias("class_id", "yv")).groupBy("class_id").agg(
        F.count_if(valid_label("yv")).alias("nv")
    ).collect()
    n_valid = np.zeros(k)
    for r in counts:
        if r["class_id"] >= k:
            raise ValueError(f"class {r['class_id']} has labels but no gamma ({k} given)")
        n_valid[r["class_id"]] = r["nv"]
    n_rows = float(train.count())
    if state is None:
        state = FitState(params={m: {kk: np.asarray(init[m][kk], dtype=np.float64).copy() for kk in PARAM_NAMES} for m in mods})
    mult = {m: float(j + 1) for j, m in enumerate(mods)} if accumulate_shared else None
    gam = np.asarray(gammas, dtype=np.float64)
    cw = None if class_w is None else np.asarray(class_w, dtype=np.float64)
    if loss == "bce" and (cw is None or cw.shape != (k, 2)):
        raise ValueError("loss='bce' needs class_w of shape (n_classes, 2)")
    hd = np.asarray(head, dtype=np.float64)
    cols = train.select(y, *mods).coalesce(max_tasks or spark.sparkContext.defaultParallelism)
    n_par = len(_flatten(state.params, mods))
    n_tot = n_par + 1 + len(mods) + 4 * k
    chunks = max(1, -(-n_tot // chunk_size))
    out_schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    history = []
    for step in range(1, steps + 1):
        bc = spark.sparkContext.broadcast(state.params)

        def part(batches, bc=bc):
            import pyarrow as pa

            from mmcohort.operators.scoring import arrow_matrix

            params = bc.value
            acc = np.zeros(n_tot)
            for b in batches:
                if not b.num_rows:
                    continue
                X = {m: arrow_matrix(b.column(b.schema.get_field_index(m))) for m in mods}
                Y = arrow_matrix(b.column(b.schema.get_field_index(y)))  # NULL labels -> NaN (masked)
                L, mse, g, dps = loss_and_grad(
                    X, Y, params, hd, mods, gam, n_valid, n_rows, beta=beta, shared_mult=mult, dp_sums=True,
                    loss=loss, class_w=cw, isolated=isolated,
                )
                acc[:n_par] += _flatten(g, mods)
                acc[n_par] += L
                acc[n_par + 1:n_par + 1 + len(mods)] += [mse[m] for m in mods]
                acc[n_par + 1 + len(mods):] += dps
            # one row per chunk: the reduction below is spread over `chunks` tasks
            offs = np.minimum(np.arange(chunks + 1, dtype=np.int64) * chunk_size, n_tot).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(chunks, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(acc))],
                names=["chunk", "g"],
            )

        sums = (
            cols.mapInArrow(part, out_schema)
            .select("chunk", array_to_vector("g").alias("g"))
            .groupBy("chunk")
            .agg(vector_to_array(Summarizer.sum(F.col("g"))).alias("s"))
            .collect()  # the summed gradient: size of the model, not of the data
        )
        bc.unpersist()
        total = np.concatenate([np.asarray(r["s"]) for r in sorted(sums, key=lambda r: r["chunk"])])
        grads = _unflatten(total[:n_par], state.params, mods)
        L = float(total[n_par])
        mse = dict(zip(mods, total[n_par + 1:n_par + 1 + len(mods)].tolist()))
        dp = delta_p_from_sums(total[n_par + 1 + len(mods):], k)
        history.append({"step": step, "loss": L + beta * sum(mse.values()), "asl": L, "mse": mse, "delta_p": dp.tolist()})
        adam_step(state, grads, mods, lr=lr, wd=weight_decay, max_norm=max_norm)
    return state.params, history


def params_from_weights(w) -> dict:
    """ProjectorWeights -> modality -> {W, b, V, c} (float64)."""
    return {m: {k: np.asarray(v[k], dtype=np.float64) for k in PARAM_NAMES} for m, v in w.mats.items()}


def params_to_table(spark, params: dict) -> DataFrame:
    """Parameters -> weights table (modality, layer, out_idx, w, b)."""
    import pyarrow as pa

    from mmcohort.operators.scoring import WEIGHTS_SCHEMA

    parts = []
    for m, p in params.items():
        for layer, w, b in (("enc", p["W"], p["b"]), ("dec", p["V"], p["c"])):
            n, d = w.shape
            rows = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(w, np.float32).ravel())
            )
            parts.append(pa.table({
                "modality": pa.array([m] * n), "layer": pa.array([layer] * n), "out_idx": pa.array(np.arange(n, dtype=np.int32)),
                "w": rows, "b": pa.array(np.asarray(b, np.float32)),
            }))
    return spark.createDataFrame(pa.concat_tables(parts), WEIGHTS_SCHEMA)
