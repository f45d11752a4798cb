"""Cohort preparation: outcome labels, label packing, pruning, row filters.

All operators are ``DataFrame -> DataFrame`` and compile to projections and
filters (no shuffle); Catalyst prunes every column that is not needed later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.config import ModalitySpec
from mmcohort.functions.columns import all_present, any_above, present, recode


def q(name: str):
    """Column reference that survives spaces, hyphens and dots in names."""
    return F.col(f"`{name}`")


# -- outcome labels -----------------------------------------------------------

def cohort_cell(los, death, hours: float = C.STAY_HOURS):
    """Which of the four (stay < hours) x (died) cells a row is in; NULL if none."""
    lt = los < F.lit(hours)
    ge = los >= F.lit(hours)
    return (
        F.when(lt & (death == 1), F.lit("dead_lt"))
        .when(ge & (death == 0), F.lit("alive_ge"))
        .when(ge & (death == 1), F.lit("dead_ge"))
        .when(lt & (death == 0), F.lit("alive_lt"))
    )


def outcome_labels(
    df: DataFrame,
    *,
    los: str = "img_length_of_stay",
    death: str = "death_status",
    hours: float = C.STAY_HOURS,
    los_mode: str = "literal",
    mortality_out: str = "48-hour Mortality",
    los_out: str = "Length-of-Stay",
    cell_out: str | None = None,
) -> DataFrame:
    """Derive the mortality and length-of-stay labels in one projection.

    mortality: 1 if stay < hours and died, 0 in the other three cells.
    length of stay, ``literal``: 1 iff stay < hours (dead or alive), 0 in the
    other cells; ``intended``: 1 iff stay < hours and alive, 0 if died (stay
    may be missing) or stay >= hours. Rows outside every cell get NULL.
    """
    if los_mode not in ("literal", "intended"):
        raise ValueError("los_mode must be 'literal' or 'intended'")
    lc, dc = q(los), q(death)
    cell = cohort_cell(lc, dc, hours)
    mort = F.when(cell.isNull(), F.lit(None)).when(cell == "dead_lt", F.lit(1.0)).otherwise(F.lit(0.0))
    if los_mode == "literal":
        stay = F.when(cell.isNull(), F.lit(None)).when(cell.isin("dead_lt", "alive_lt"), F.lit(1.0)).otherwise(F.lit(0.0))
    else:
        stay = (
            F.when(dc == 1, F.lit(0.0))
            .when((dc == 0) & (lc < F.lit(hours)), F.lit(1.0))
            .when((dc == 0) & (lc >= F.lit(hours)), F.lit(0.0))
        )
    out = df.withColumn(mortality_out, mort.cast("double")).withColumn(los_out, stay.cast("double"))
    if cell_out:
        out = out.withColumn(cell_out, cell)
    return out


def pack_labels(df: DataFrame, cols: Sequence[str], *, out: str = "y") -> DataFrame:
    """Pack label columns, in the given order, into one ``array<double>``."""
    return df.withColumn(out, F.array(*[q(c).cast("double") for c in cols]))


def recode_uncertain(df: DataFrame, *, col: str = "y", src: float = C.UNCERTAIN_SRC, dst: float = C.UNCERTAIN_DST) -> DataFrame:
    """Uncertain label code ``src`` -> ``dst`` inside the label array; NULL stays NULL."""
    return df.withColumn(col, recode(col, src, dst))


# -- pruning ------------------------------------------------------------------

def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def prune(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), *, strict: bool = True) -> DataFrame:
    """Drop columns by name and by prefix; unlike ``DataFrame.drop`` a missing
    name raises when ``strict`` (listing a name twice is fine)."""
    have = set(df.columns)
    missing = sorted({n for n in names if n not in have})
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    gone = set(names)
    for p in prefixes:
        gone.update(columns_with_prefix(df, p))
    return df.select(*[q(c) for c in df.columns if c not in gone])


def only_known(df: DataFrame, spec: ModalitySpec, keep: Sequence[str]) -> None:
    """Raise on a column that is neither kept nor belongs to a modality."""
    odd = [c for c in df.columns if c not in keep and not any(c.startswith(spec.prefixes[m]) for m in spec.stored_order)]
    if odd:
        raise ValueError(f"columns that belong to no modality: {odd}")


def pack_modalities(df: DataFrame, spec: ModalitySpec, *, keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Replace the scalar feature columns of each modality by one array column.

    Columns are matched by prefix and kept in table order; the width of each
    modality is checked against ``spec`` so an unexpected column fails here
    instead of shifting every later slice.
    """
    arrays = []
    for m in spec.stored_order:
        cols = columns_with_prefix(df, spec.prefixes[m])
        if len(cols) != spec.widths[m]:
            raise ValueError(f"modality {m}: expected {spec.widths[m]} columns with prefix {spec.prefixes[m]!r}, found {len(cols)}")
        arr = F.array(*[q(c).cast(dtype) for c in cols]) if cols else F.array().cast(f"array<{dtype}>")
        arrays.append(arr.alias(m))
    return df.select(*[q(c) for c in keep], *arrays)


# -- row filters --------------------------------------------------------------

def filter_outliers(df: DataFrame, *, col: str = "n_rad", limit: float = C.OUTLIER_LIMIT) -> DataFrame:
    """Drop rows where any element of ``col`` is strictly above ``limit``.

    NaN / NULL elements never count as above (they are left to
    :func:`drop_incomplete`), so every stage keeps the same rows as the
    pandas formulation.
    """
    return df.where(~any_above(col, limit))


def drop_incomplete(df: DataFrame, *, scalars: Sequence[str] = (), arrays: Sequence[str] = ()) -> DataFrame:
    """Drop rows with a missing (NULL or NaN) scalar or array element.

    The label array is not listed: missing labels inside it are masked later.
    """
    cond = F.lit(True)
    types = dict(df.dtypes)
    for c in scalars:
        cond = cond & (present(q(c)) if types[c] in ("double", "float") else q(c).isNotNull())
    for a in arrays:
        cond = cond & all_present(q(a))
    return df.where(cond)


def single_label(df: DataFrame, label: str, *, out: str = "y") -> DataFrame:
    """Single-label cohort: keep rows whose ``label`` is 0 or 1 and use it as target."""
    return df.where(q(label).isin(0, 1)).withColumn(out, q(label).cast("double"))


def prepare_single(
    df: DataFrame,
    spec: ModalitySpec,
    label: str,
    *,
    key: str = "haim_id",
    drop_names: Sequence[str] = (),
    drop_prefixes: Sequence[str] = C.DROPPED_PREFIXES,
    extra_keep: Sequence[str] = (),
    dtype: str = "double",
) -> DataFrame:
    """Single-label route: rows with label 0 / 1 -> prune -> pack. Rows with
    missing features stay (the statistics skip missing elements); a NULL or
    NaN element stays missing through the scaling. Returns (key, *extra_keep, y, <modality arrays>)."""
    d = prune(single_label(df, label), names=drop_names, prefixes=drop_prefixes)
    keep = [key, *extra_keep, "y"]
    only_known(d, spec, keep)
    return pack_modalities(d, spec, keep=keep, dtype=dtype).where(q(key).isNotNull())


def prepare(
    df: DataFrame,
    spec: ModalitySpec,
    *,
    key: str = "haim_id",
    label_cols: Sequence[str] = C.CLASS_NAMES,
    drop_names: Sequence[str] = C.DROPPED_COLUMNS,
    drop_prefixes: Sequence[str] = C.DROPPED_PREFIXES,
    los: str = "img_length_of_stay",
    death: str = "death_status",
    los_mode: str = "literal",
    outlier_col: str = "n_rad",
    extra_keep: Sequence[str] = (),
    dtype: str = "double",
) -> DataFrame:
    """Labels -> label array -> prune -> pack modalities -> outlier -> incomplete.

    A drop name that is absent, or a column that is neither kept, dropped nor
    part of a modality, raises. ``dtype``: element type of the packed arrays.

    Returns (key, *extra_keep, y, <modality arrays>).
    """
    d = outcome_labels(df, los=los, death=death, los_mode=los_mode)
    d = pack_labels(d, label_cols)
    d = prune(d, names=drop_names, prefixes=drop_prefixes)
    only_known(d, spec, [key, *extra_keep, "y"])
    d = pack_modalities(d, spec, keep=[key, *extra_keep, "y"], dtype=dtype)
    d = filter_outliers(d, col=outlier_col)
    return drop_incomplete(d, scalars=[key], arrays=list(spec.stored_order))
