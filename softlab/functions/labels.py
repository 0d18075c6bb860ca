"""Label algebra as Column expressions.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen where Spark allows it (the array lambdas fall back to
interpreted evaluation, but still run JVM-side, never in Python).

Three hard-label rules exist and they disagree at exactly p = 0.5; they are
named separately on purpose and none is a default of another:

* ``binarize_strict``   p >  t   (0.5 -> 0)
* ``round_half_even``   bround   (0.5 -> 0, 1.5 -> 2)
* ``predict_at``        p >= t   (0.5 -> 1)
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- hard labels
def binarize_strict(p: ColumnOrName, threshold: float = 0.5) -> Column:
    """``(p > t)`` as int; p = t gives 0."""
    return (_c(p) > F.lit(threshold)).cast("int")


def round_half_even(p: ColumnOrName) -> Column:
    """Python ``round`` (banker's rounding) as int; 0.5 gives 0."""
    return F.bround(_c(p), 0).cast("int")


def predict_at(p: ColumnOrName, threshold: float = 0.5) -> Column:
    """``(p >= t)`` as int; p = t gives 1."""
    return (_c(p) >= F.lit(threshold)).cast("int")


# ------------------------------------------------------------ vector helpers
# A per-row scalar referenced inside an array lambda (``transform(v, x -> x /
# sum(v))``) is re-evaluated for every element once Catalyst inlines it: an
# O(K^2) expression per row.  ``with_scalar`` passes the scalar as a repeated
# array next to ``v`` instead, so it is evaluated once per row.
def with_scalar(v: Column, s: Column, fn) -> Column:
    """``[fn(x, s) for x in v]`` with ``s`` evaluated once per row."""
    return F.zip_with(v, F.array_repeat(s, F.size(v)), fn)


def vsum(v: ColumnOrName) -> Column:
    """Sum of an ``array<double>`` in index order."""
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def argmax(v: ColumnOrName) -> Column:
    """0-based index of the first maximum."""
    v = _c(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def to_binary_vector(p: ColumnOrName) -> Column:
    """P10: ``[1 - p, p]``."""
    p = _c(p).cast("double")
    return F.array(F.lit(1.0) - p, p)


def normalize(v: ColumnOrName) -> Column:
    """Divide by the sum; a zero-sum vector gives null (rejected row)."""
    v = _c(v)
    s = vsum(v)
    return F.when(s != 0, with_scalar(v, s, lambda x, t: x / t))


def max_prob(v: ColumnOrName) -> Column:
    """Largest probability."""
    return F.array_max(_c(v))


def top_gap(v: ColumnOrName) -> Column:
    """Largest minus second largest (0 for a 1-element vector)."""
    s = F.sort_array(_c(v), asc=False)
    return F.when(F.size(s) >= 2, s[0] - s[1]).otherwise(F.lit(0.0))


def entropy_norm(v: ColumnOrName, eps: float = 1e-10) -> Column:
    """``-sum p*ln(p+eps) / ln K``."""
    v = _c(v)
    h = F.aggregate(v, F.lit(0.0).cast("double"),
                    lambda acc, x: acc - x * F.log(x + F.lit(eps)))
    k = F.size(v).cast("double")
    return F.when(k > 1, h / F.log(k)).otherwise(F.lit(0.0))   # ANSI: no 0/0 for K = 1


def softmax(v: ColumnOrName) -> Column:
    """P20: shift by the max; denominator + 1e-12."""
    v = _c(v)
    e = with_scalar(v, F.array_max(v), lambda x, m: F.exp(x - m))
    d = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x) + F.lit(1e-12)
    return with_scalar(e, d, lambda x, t: x / t)


def one_hot(idx: ColumnOrName, k: int) -> Column:
    """Indicator vector of length k as ``array<double>``."""
    seq = F.sequence(F.lit(0), F.lit(k - 1))
    return with_scalar(seq, _c(idx), lambda i, j: (i == j).cast("double"))


def probs_to_one_hot(v: ColumnOrName) -> Column:
    """One-hot of the argmax."""
    v = _c(v)
    seq = F.sequence(F.lit(0), F.size(v) - 1)
    return with_scalar(seq, argmax(v), lambda i, a: (i == a).cast("double"))


def round_vector(v: ColumnOrName, digits: int = 3) -> Column:
    """Round every element (half-even, like Python's ``round``)."""
    return F.transform(_c(v), lambda x: F.bround(x, digits))


def format_vector(v: ColumnOrName, digits: int = 3) -> Column:
    """``"a,b,c"`` with fixed decimals."""
    fmt = f"%.{digits}f"
    return F.array_join(F.transform(_c(v), lambda x: F.format_string(fmt, x)), ",")


def parse_vector(s: ColumnOrName) -> Column:
    """``"a,b,c"`` back to ``array<double>``."""
    return F.transform(F.split(F.trim(_c(s)), r"\s*,\s*"), lambda x: x.cast("double"))


def label_map(names: Sequence[str], v: ColumnOrName) -> Column:
    """Class name -> probability map."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), _c(v))


def label_index(names: Sequence[str], name: ColumnOrName, default: int = 1) -> Column:
    """Class name -> index; unknown names map to ``default``."""
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.element_at(m, _c(name)), F.lit(default)).cast("int")


def map_label(col: ColumnOrName, mapping: dict) -> Column:
    """Value lookup through a literal map; unmapped values become null."""
    m = F.create_map(*[x for k, val in mapping.items() for x in (F.lit(k), F.lit(val))])
    return F.element_at(m, _c(col))


def shift_label(col: ColumnOrName, by: int = 1) -> Column:
    """1-based class -> 0-based."""
    return (_c(col) - F.lit(by)).cast("int")


def borderline_weight(p: ColumnOrName, exponent: float = 1.0,
                      min_weight: float = 0.0) -> Column:
    """``min + (1-min) * (2|p-.5|)^exp`` clipped to [min, 1].

    Only defined for binary soft labels; parameters are validated eagerly.
    """
    if exponent < 0 or not math.isfinite(exponent):
        raise ValueError("exponent must be a finite number >= 0")
    if not 0.0 <= min_weight <= 1.0:
        raise ValueError("min_weight must be in [0, 1]")
    d = F.pow(F.lit(2.0) * F.abs(_c(p) - F.lit(0.5)), F.lit(float(exponent)))
    w = F.lit(min_weight) + F.lit(1.0 - min_weight) * d
    return F.least(F.greatest(w, F.lit(min_weight)), F.lit(1.0))


# ---------------------------------------------------------- validation
VALID, CLIPPED, RENORMALISED, OUT_OF_RANGE, ZERO_SUM, BAD_LENGTH = (
    "valid", "clipped", "renormalised", "out_of_range", "zero_sum", "bad_length")


def validate_soft_label_status(v: ColumnOrName, k: int | None = None,
                               atol: float = 1e-5) -> Column:
    """P12 status: which rule a vector trips, first match wins."""
    v = _c(v)
    lo, hi = -atol, 1.0 + atol
    bad = F.exists(v, lambda x: (x < F.lit(lo)) | (x > F.lit(hi)) | x.isNull() | F.isnan(x))
    clipped = F.transform(v, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    s = vsum(clipped)
    changed = F.exists(v, lambda x: (x < F.lit(0.0)) | (x > F.lit(1.0)))
    chain = F.when(bad, F.lit(OUT_OF_RANGE)).when(s == 0, F.lit(ZERO_SUM)) \
        .when(F.abs(s - F.lit(1.0)) > F.lit(atol), F.lit(RENORMALISED)) \
        .when(changed, F.lit(CLIPPED)).otherwise(F.lit(VALID))
    if k is not None:
        return F.when(F.size(v) != F.lit(k), F.lit(BAD_LENGTH)).otherwise(chain)
    return chain


def validate_soft_label(v: ColumnOrName, atol: float = 1e-5) -> Column:
    """P12 value: clip to [0,1] and renormalise when the sum is off by more
    than ``atol`` (the reference leaves sums off by atol..2*atol alone and
    then fails them; these are renormalised here); out-of-range or zero-sum
    vectors give null."""
    v = _c(v)
    lo, hi = -atol, 1.0 + atol
    bad = F.exists(v, lambda x: (x < F.lit(lo)) | (x > F.lit(hi)) | x.isNull() | F.isnan(x))
    clipped = F.transform(v, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    s = vsum(clipped)
    fixed = F.when(F.abs(s - F.lit(1.0)) > F.lit(atol),
                   with_scalar(clipped, s, lambda x, t: x / t)).otherwise(clipped)
    return F.when(~bad & (s != 0), fixed)


def strict_soft_label(v: ColumnOrName, atol: float = 1e-5) -> Column:
    """P12 strict mode: like ``validate_soft_label`` but fails the job."""
    out = validate_soft_label(v, atol)
    return F.when(out.isNull(), F.raise_error(F.lit("invalid soft label"))).otherwise(out)
