"""Projection and scoring: the only place where Python runs per batch.

* Projector weights live in a table (modality, layer, out_idx, w, b); they are
  read once on the driver (size fixed by the model, ~54 MB at full width),
  shipped with ``SparkContext.broadcast`` and turned into NumPy matrices once
  per Python worker.
* ``encode`` runs ``mapInArrow``: one Arrow batch = one matrix product per
  modality (relu(X Wᵀ + b)), optional reconstruction (H Vᵀ + c).
* ``score`` feeds the codes, in token order, to a pluggable frozen scorer with
  ``pyspark.ml.functions.predict_batch_udf`` (Arrow batches of ``batch_size``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mmcohort import config as C
from mmcohort.config import ModalitySpec
from mmcohort.functions.columns import half as to_half

WEIGHTS_SCHEMA = "modality string, layer string, out_idx int, w array<float>, b float"

# Largest projector set shipped to the workers: 2^28 float32 values (1 GiB). The
# size is a property of the model (six projectors at full width ≈ 13.4 M values,
# 54 MB), not of the data; it is checked before anything reaches the driver.
MAX_BROADCAST_WEIGHT_VALUES = 1 << 28
MAX_INLINE_WEIGHT_VALUES = 10_000  # literals in one plan

# per Python worker (they outlive a task): scorer token -> loaded predict function,
# and (weights token, precision) -> matrices converted once
_SCORERS: dict = {}
_MATRICES: dict = {}


def _matrices(token: str, held, dtype) -> dict:
    key = (token, np.dtype(dtype).name)
    if key not in _MATRICES:
        _MATRICES.clear()  # one model at a time
        _MATRICES[key] = {m: {k: v.astype(dtype) for k, v in mm.items()} for m, mm in held.value.items()}
    return _MATRICES[key]


def _scorer(token: str, make: Callable) -> Callable:
    if token not in _SCORERS:
        _SCORERS[token] = make()
    return _SCORERS[token]


# -- weights -------------------------------------------------------------------

def rule_weights(spark: SparkSession, spec: ModalitySpec, latent: int, factor: float = 1.0) -> DataFrame:
    """Deterministic projector weights generated by Spark from a rule (test fixture):
    encoder w[i][j] = sin(31 i + 17 j) / sqrt(d), b[i] = 0.01 i, both times ``factor``;
    decoder v[j][i] = cos(29 j + 11 i) / sqrt(latent), c[j] = 0.005 j."""
    parts = []
    for m in spec.stored_order:
        d = spec.widths[m]
        if d == 0:
            continue
        enc = spark.range(latent).select(
            F.lit(m).alias("modality"), F.lit("enc").alias("layer"), F.col("id").cast("int").alias("out_idx"),
            F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda j: (F.sin(F.col("id") * 31 + j * 17) / F.lit(math.sqrt(d))).cast("float") * F.lit(factor).cast("float")).alias("w"),
            ((F.col("id") * 0.01).cast("float") * F.lit(factor).cast("float")).alias("b"),
        )
        dec = spark.range(d).select(
            F.lit(m).alias("modality"), F.lit("dec").alias("layer"), F.col("id").cast("int").alias("out_idx"),
            F.transform(F.sequence(F.lit(0), F.lit(latent - 1)),
                        lambda i: (F.cos(F.col("id") * 29 + i * 11) / F.lit(math.sqrt(latent))).cast("float")).alias("w"),
            (F.col("id") * 0.005).cast("float").alias("b"),
        )
        parts += [enc, dec]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ProjectorWeights:
    """Driver-side handle: per modality encoder (W, b) and decoder (V, c), broadcast once."""

    def __init__(self, spark: SparkSession, mats: dict):
        self.mats = mats
        self.token = uuid.uuid4().hex  # names the set in a worker's cache
        self.latent = {m: v["W"].shape[0] for m, v in mats.items()}
        self.bc = spark.sparkContext.broadcast(mats)

    @classmethod
    def from_table(cls, weights: DataFrame, *, max_values: int = MAX_BROADCAST_WEIGHT_VALUES) -> "ProjectorWeights":
        n_values = weights.agg(F.sum(F.size("w") + F.lit(1)).alias("n")).first()["n"] or 0
        if n_values > max_values:
            raise ValueError(
                f"projector weights hold {n_values} values, above the broadcast limit of {max_values}; "
                "use encode_blocked, or raise max_values if the executors can hold it"
            )
        t = weights.select("modality", "layer", "out_idx", "w", "b").orderBy("modality", "layer", "out_idx").toArrow()  # size checked above
        mats: dict = {}
        group = np.char.add(np.char.add(t["modality"].to_numpy().astype(str), "/"), t["layer"].to_numpy().astype(str))
        for g in np.unique(group):
            part = t.filter(group == g)
            m, layer = str(g).split("/")
            e = mats.setdefault(m, {})
            w = arrow_matrix(part["w"].combine_chunks()).astype(np.float32)
            bias = part["b"].to_numpy().astype(np.float32)
            if layer == "enc":
                e["W"], e["b"] = w, bias
            else:
                e["V"], e["c"] = w, bias
        return cls(weights.sparkSession, mats)


# -- projection ------------------------------------------------------------------

def encode(
    df: DataFrame,
    weights: ProjectorWeights,
    modalities: Sequence[str],
    *,
    decode: bool = False,
    precision: str = "float64",
) -> DataFrame:
    """Add ``code_<m>`` (relu(W x + b)) and, with ``decode``, ``recon_<m>`` (V h + c)."""
    bc, token = weights.bc, weights.token
    mods = [m for m in modalities]
    dt = np.float64 if precision == "float64" else np.float32
    fields = list(df.schema.fields)
    for m in mods:
        fields.append(T.StructField(f"code_{m}", T.ArrayType(T.DoubleType())))
    if decode:
        for m in mods:
            fields.append(T.StructField(f"recon_{m}", T.ArrayType(T.DoubleType())))
    schema = T.StructType(fields)

    names = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        from mmcohort.operators import scoring as this  # the imported module: its cache outlives the task

        mats = this._matrices(token, bc, dt)
        for batch in batches:
            n = batch.num_rows
            extra = []
            hs = {}
            for m in mods:
                W, b = mats[m]["W"], mats[m]["b"]
                X = arrow_matrix(batch.column(batch.schema.get_field_index(m))).astype(dt) if n else np.zeros((0, W.shape[1]), dtype=dt)
                hs[m] = np.maximum(X @ W.T + b, 0.0)
                extra.append(_list_column(hs[m]))
            if decode:
                extra += [_list_column(hs[m] @ mats[m]["V"].T + mats[m]["c"]) for m in mods]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return df.mapInArrow(run, schema)


BLOCK_VALUES = 1 << 22  # weights, and features, in a block of the blocked projection


def encode_blocked(
    df: DataFrame,
    weights: DataFrame,
    widths: dict,
    modalities: Sequence[str],
    *,
    key: str,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(key, code_<m>...): the codes of :func:`encode` for weights of any size.

    No task holds more than a block of the weights table, nothing is broadcast
    and nothing reaches the driver but counts: encoder rows are cut in blocks of
    (range of outputs x range of inputs), a row's features in the same input
    ranges; a block of rows meets each block of weights of its modality and
    input range in one matrix product, and the partial codes of a row are
    summed over the input ranges in their order (the bias goes with the first).
    ``key`` must name the rows; ``block_values`` bounds both sides of a product.
    """
    import pyarrow as pa

    side = max(1, math.isqrt(block_values))
    per_in = {m: min(widths[m], side) for m in modalities}
    rows_in_block = max(1, block_values // max(per_in.values()))
    n_blocks = max(1, math.ceil(df.count() / rows_in_block))
    enc = weights.where((F.col("layer") == "enc") & F.col("modality").isin(list(modalities)))
    step = F.element_at(F.create_map(*[F.lit(x) for m in modalities for x in (m, per_in[m])]), F.col("modality"))
    pieces = F.ceil(F.size("w") / step).cast("int")
    enc = (
        enc.withColumn("ob", F.floor(F.col("out_idx") / side).cast("int"))
        .withColumn("ib", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("w", F.slice("w", F.col("ib") * step + 1, step).cast("array<double>"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    outs = weights.where(F.col("layer") == "enc").groupBy("modality").agg((F.max(F.floor(F.col("out_idx") / side)) + 1).cast("int").alias("n_ob"))
    outs = {r["modality"]: r["n_ob"] for r in outs.collect()}  # a row per modality
    parts = [
        F.struct(
            F.lit(m).alias("modality"), F.lit(ib).alias("ib"), F.lit(outs[m]).alias("n_ob"),
            F.slice(F.col(m).cast("array<double>"), ib * per_in[m] + 1, per_in[m]).alias("x"),
        )
        for m in modalities
        for ib in range(math.ceil(widths[m] / per_in[m]))
    ]
    rows = df.select(F.col(key).alias("_k"), F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("rb"), F.inline(F.array(*parts)))
    rows = rows.withColumn("ob", F.explode(F.sequence(F.lit(0), F.col("n_ob") - 1)))
    cell = ["modality", "ib", "ob", "rb"]
    kind = df.schema[key].dataType.simpleString()

    def product(left, right):
        names = ["_k", "modality", "ob", "ib", "part"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (left.schema.field("_k").type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))], names=names)
        x = arrow_matrix(left.column("x").combine_chunks())
        right = right.sort_by("out_idx")
        part = x @ arrow_matrix(right.column("w").combine_chunks()).T
        if right.column("ib")[0].as_py() == 0:
            part = part + right.column("b").to_numpy().astype(np.float64)
        return pa.table([left.column("_k"), left.column("modality"), left.column("ob"), left.column("ib"), _list_column(part)], names=names)

    partial = (
        rows.select("_k", "x", *cell).groupBy(*cell)
        .cogroup(enc.select("out_idx", "w", "b", *cell).groupBy(*cell))
        .applyInArrow(product, f"_k {kind}, modality string, ob int, ib int, part array<double>")
    )
    in_order = F.sort_array(F.collect_list(F.struct("ib", "part")))  # input ranges of one output range
    summed = partial.groupBy("_k", "modality", "ob").agg(
        F.reduce(in_order, F.array().cast("array<double>"), lambda s, p: F.when(F.size(s) == 0, p["part"]).otherwise(F.zip_with(s, p["part"], lambda a, b: a + b))).alias("code")
    )
    relu = F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ob", "code"))), lambda o: o["code"])), lambda v: F.greatest(v, F.lit(0.0)))
    codes = summed.groupBy("_k", "modality").agg(relu.alias("code"))
    return codes.groupBy(F.col("_k").alias(key)).agg(*[F.first(F.when(F.col("modality") == m, F.col("code")), ignorenulls=True).alias(f"code_{m}") for m in modalities])


def encode_sql(df: DataFrame, weights: ProjectorWeights, modalities: Sequence[str], *, decode: bool = False) -> DataFrame:
    """Same as :func:`encode` with built-in array functions only (weights inlined as
    literals) — the all-JVM path for narrow projectors and a cross-check."""
    size = sum(weights.mats[m][k].size for m in modalities for k in ("W", "V") if k == "W" or decode)
    if size > MAX_INLINE_WEIGHT_VALUES:
        raise ValueError(f"{size} weights are too many to inline (limit {MAX_INLINE_WEIGHT_VALUES}): use encode()")
    out = df
    for m in modalities:
        mm = weights.mats[m]
        x = F.col(m).cast("array<double>")
        codes = []
        for i in range(mm["W"].shape[0]):
            w = F.array(*[F.lit(float(v)) for v in mm["W"][i]])
            s = F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(mm["b"][i]))
            codes.append(F.greatest(s, F.lit(0.0)))
        out = out.withColumn(f"code_{m}", F.array(*codes))
    if decode:
        for m in modalities:
            mm = weights.mats[m]
            h = F.col(f"code_{m}")
            rec = []
            for j in range(mm["V"].shape[0]):
                v = F.array(*[F.lit(float(t)) for t in mm["V"][j]])
                rec.append(F.aggregate(F.zip_with(h, v, lambda a, c: a * c), F.lit(0.0), lambda acc, t: acc + t) + F.lit(float(mm["c"][j])))
            out = out.withColumn(f"recon_{m}", F.array(*rec))
    return out


# -- scoring -----------------------------------------------------------------------

def class_logits_from_vocab(make_model_fn: Callable, vocab_positions: Sequence[int] = C.VOCAB_POSITIONS) -> Callable:
    """Adapt a frozen sequence model to a class scorer.

    ``make_model_fn()`` returns ``model(seq: ndarray (B, T, D)) -> ndarray (B, T, V)``
    (vocabulary logits); the class logits are the last position at ``vocab_positions``.
    """
    pos = np.asarray(list(vocab_positions))

    def make():
        model = make_model_fn()

        def predict(seq):
            logits = model(seq)
            return logits[:, -1, :][:, pos]

        return predict

    return make


def score(
    df: DataFrame,
    make_scorer: Callable,
    modalities: Sequence[str],
    latent: int,
    *,
    out: str = "logits",
    batch_size: int = C.BATCH_SIZE,
    half: bool = False,
) -> DataFrame:
    """Joint scoring: the codes of ``modalities`` (token order) form one sequence per row.

    ``make_scorer()`` returns ``predict(seq: (B, T, latent)) -> (B, n_classes)``.
    ``half`` rounds the codes to float16 first, like a half-precision model input
    (built-in functions: :func:`mmcohort.functions.columns.half`).
    """
    n_tok = len(modalities)

    def make_predict_fn():
        predict = make_scorer()

        def fn(flat):
            seq = np.asarray(flat, dtype=np.float64).reshape(-1, n_tok, latent)
            return np.asarray(predict(seq), dtype=np.float64)

        return fn

    udf = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n_tok * latent]]
    )
    flat = F.flatten(F.array(*[F.col(f"code_{m}") for m in modalities]))
    return df.withColumn(out, udf(F.transform(flat, to_half) if half else flat))


def score_isolated(
    df: DataFrame,
    make_scorer: Callable,
    modalities: Sequence[str],
    latent: int,
    *,
    keep: Sequence[str] = ("study_id",),
    out: str = "logits",
    batch_size: int = C.BATCH_SIZE,
) -> DataFrame:
    """Isolated scoring: every modality's code alone is a one-token sequence.

    Returns (keep..., token_idx, modality, logits).
    """
    toks = F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"code_{m}").alias("code")) for m in modalities])
    long = df.select(*keep, F.posexplode(toks).alias("token_idx", "t")).select(*keep, "token_idx", "t.modality", "t.code")
    long = long.withColumn("code_tok", F.col("code"))
    return score(long, make_scorer, ["tok"], latent, out=out, batch_size=batch_size).drop("code_tok", "code")


def _list_column(mat: np.ndarray):
    """Arrow list<double> column from a (rows, width) matrix (one buffer, no row loop)."""
    import pyarrow as pa

    n, k = (mat.shape[0], mat.shape[1]) if mat.ndim == 2 else (0, 0)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat, dtype=np.float64).ravel(), type=pa.float64()))


def arrow_matrix(col) -> np.ndarray:
    """(rows, width) float64 matrix of an Arrow list column of equal-length
    lists, converted in one vectorised step (no Python loop over rows). NULL
    elements become NaN; a NULL list or lists of different lengths are an error."""
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    widths = np.diff(np.asarray(col.offsets))
    if col.null_count or (widths != widths[0]).any():
        raise ValueError(f"arrays of one length are expected, found {col.null_count} NULL and lengths {sorted(set(widths.tolist()))[:5]}")
    vals = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(vals, dtype=np.float64).reshape(n, int(widths[0]))


def _fused(
    df: DataFrame,
    weights: ProjectorWeights,
    make_scorer: Callable,
    token_order: Sequence[str],
    keep: Sequence[str],
    *,
    out: str,
    isolated: bool,
    decode: bool,
    batch_size: int,
    half: bool,
    precision: str,
) -> DataFrame:
    """Projection, scoring and (``decode``) reconstruction error in ONE Python pass.

    Rows are taken ``batch_size`` at a time within an Arrow batch, so a worker
    never holds the codes of more rows than a scorer batch. Codes (several times wider than the
    input) and reconstructions never leave the worker: only (keep..., logits)
    and per modality the squared error and element count do. ``isolated``:
    ``out`` holds one array of logits per token instead of one for the sequence.
    """
    bc, wtoken, stoken = weights.bc, weights.token, uuid.uuid4().hex
    toks, keep = list(token_order), list(keep)
    dt = np.float64 if precision == "float64" else np.float32
    kind = T.ArrayType(T.ArrayType(T.DoubleType())) if isolated else T.ArrayType(T.DoubleType())
    fields = [df.schema[c] for c in keep] + [T.StructField(out, kind)]
    if decode:
        for m in toks:
            fields += [T.StructField(f"_se_{m}", T.DoubleType()), T.StructField(f"_n_{m}", T.LongType())]
    names = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        from mmcohort.operators import scoring as this  # the imported module: its caches outlive the task

        mats, predict = this._matrices(wtoken, bc, dt), this._scorer(stoken, make_scorer)
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                n = part.num_rows
                codes, errors = [], []
                for m in toks:
                    X = arrow_matrix(part.column(part.schema.get_field_index(m))).astype(dt)
                    H = np.maximum(X @ mats[m]["W"].T + mats[m]["b"], 0.0)
                    codes.append(H)
                    if decode:
                        R = H @ mats[m]["V"].T + mats[m]["c"]
                        errors += [
                            pa.array(((R - X) ** 2).sum(axis=1, dtype=np.float64), type=pa.float64()),
                            pa.array(np.full(n, X.shape[1], dtype=np.int64)),
                        ]
                seq = np.stack(codes, axis=1)  # (B, T, latent)
                if half:
                    seq = seq.astype(np.float16).astype(dt)
                if isolated:
                    per = np.stack([np.asarray(predict(seq[:, t : t + 1]), dtype=np.float64) for t in range(len(toks))], axis=1)
                    inner = _list_column(per.reshape(n * len(toks), -1))
                    logits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(toks)), inner)
                else:
                    logits = _list_column(np.asarray(predict(seq), dtype=np.float64))
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, logits, *errors], names=names)

    return df.select(*dict.fromkeys([*keep, *toks])).mapInArrow(run, T.StructType(fields))


def encode_and_score(
    df: DataFrame,
    weights: ProjectorWeights,
    make_scorer: Callable,
    token_order: Sequence[str],
    *,
    keep: Sequence[str],
    out: str = "logits",
    batch_size: int = 1024,
    half: bool = False,
    precision: str = "float64",
) -> DataFrame:
    """Projection and joint scoring in one Python pass: (keep..., logits). Same
    numbers as :func:`encode` followed by :func:`score`. ``half`` rounds the
    codes to float16 first; ``precision`` "float32" halves the worker's memory."""
    return _fused(df, weights, make_scorer, token_order, keep, out=out, isolated=False, decode=False,
                  batch_size=batch_size, half=half, precision=precision)


def encode_and_score_isolated(
    df: DataFrame, weights: ProjectorWeights, make_scorer: Callable, token_order: Sequence[str], *,
    keep: Sequence[str], batch_size: int = 1024, half: bool = False, precision: str = "float64",
) -> DataFrame:
    """Isolated scoring in one Python pass: (keep..., token_idx, modality, logits),
    the numbers of :func:`encode` followed by :func:`score_isolated`."""
    s = _fused(df, weights, make_scorer, token_order, keep, out="_iso", isolated=True, decode=False,
               batch_size=batch_size, half=half, precision=precision)
    return by_token(s, token_order, keep)


def by_token(scored: DataFrame, token_order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per token from the isolated logits ``_iso``."""
    long = scored.select(*keep, F.posexplode("_iso").alias("token_idx", "logits"))
    names = F.array(*[F.lit(m) for m in token_order])
    return long.select(*keep, "token_idx", F.get(names, F.col("token_idx")).alias("modality"), "logits")


def encode_decode_score(
    df: DataFrame,
    weights: ProjectorWeights,
    make_scorer: Callable,
    token_order: Sequence[str],
    *,
    keep: Sequence[str] = ("y",),
    batch_size: int = 1024,
    isolated: bool = False,
    precision: str = "float64",
) -> DataFrame:
    """Validation pass in one Python step: (keep..., logits, _se_<m>, _n_<m>);
    with ``isolated`` the logits are per token, in ``_iso`` (see :func:`by_token`)."""
    return _fused(df, weights, make_scorer, token_order, keep, out="_iso" if isolated else "logits", isolated=isolated,
                  decode=True, batch_size=batch_size, half=False, precision=precision)


def linear_head(head: np.ndarray) -> Callable:
    """Scorer of a frozen linear head (K, T * latent) on the flattened code sequence
    (the head the projector fit trains through)."""
    h = np.asarray(head, dtype=np.float64)

    def make():
        def predict(seq):
            flat = seq.reshape(seq.shape[0], -1)
            return flat @ h[:, : flat.shape[1]].T

        return predict

    return make
