"""Column -> Column helpers (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(z) -> Column:
    """Logistic function; exp overflow yields 0.0 / 1.0 without error."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def hard_pred(p) -> Column:
    """Round-half-to-even of a probability: 0.5 -> 0, so prediction is p > 0.5."""
    return F.when(col(p) > 0.5, F.lit(1)).otherwise(F.lit(0))


def valid_label(y) -> Column:
    """Label mask: present, not NaN and not the uncertain code 2."""
    y = col(y)
    return y.isNotNull() & ~F.isnan(y) & (y != F.lit(2.0))


def present(x) -> Column:
    """Not NULL and not NaN."""
    x = col(x)
    return x.isNotNull() & ~F.isnan(x)


def any_above(arr, limit: float) -> Column:
    """True iff some element is strictly above ``limit``, whatever the length.

    NULL and NaN elements do not count (pandas semantics: NaN > x is false),
    and the result is never NULL.
    """
    above = lambda x: F.coalesce((x > F.lit(limit)) & ~F.isnan(x), F.lit(False))
    return F.coalesce(F.exists(col(arr), above), F.lit(False))


def all_present(arr) -> Column:
    """True iff the array itself and every element are present (no NULL / NaN), whatever the length."""
    a = col(arr)
    return a.isNotNull() & F.coalesce(F.forall(a, present), F.lit(False))


def sized(arr, width: int) -> Column:
    """The array itself; fails the job on a row whose array has another length (NULL passes)."""
    a = col(arr)
    wrong = F.raise_error(F.concat(F.lit(f"an array of {width} elements is expected, found "), F.size(a).cast("string")))
    return F.when(a.isNull() | (F.size(a) == F.lit(width)), a).otherwise(wrong)


def required(x, what: str) -> Column:
    """The value itself; fails the job on a row where it is NULL or NaN."""
    x = col(x)
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.raise_error(F.lit(what)))


def recode(arr, src: float, dst: float) -> Column:
    """Replace ``src`` by ``dst`` inside an array; NULL stays NULL."""
    return F.transform(col(arr), lambda x: F.when(x == F.lit(src), F.lit(dst)).otherwise(x))


def sq_err_sum(a, b) -> Column:
    """Sum of squared element differences of two equal-length arrays."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def half(x) -> Column:
    """The nearest IEEE half-precision value (ties to even) as a double, from
    built-ins: 11 significant bits, multiples of 2**-24 below 2**-14 and
    infinity from 65520 on; NULL, NaN, the sign and infinities stay."""
    x = col(x).cast("double")
    a = F.abs(x)
    e = F.floor(F.log2(a))
    # the logarithm may be off by one next to a power of two
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    unit = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    near = F.rint(x / unit) * unit
    big = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(F.isnan(x) | (a == 0), x).when(a >= 65520.0, big).otherwise(near)


def rnd(x, digits: int = 9) -> Column:
    """Round for stable comparison; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(col(x), digits) + F.lit(0.0)
