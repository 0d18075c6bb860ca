"""Row filters and predicates (F1–F16).

Plain ``filter`` predicates: Catalyst pushes the scalar ones (F1, F2, F9)
into the Parquet scan when ``p`` is a stored column.  Vector predicates
(F3–F6) cannot be pushed down; materialise ``max_prob`` / ``top_gap`` /
``entropy`` at ingest (``with_label_stats``) to make them pushable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------- predicates
def margin_strict(p: ColumnOrName, m: float) -> Column:
    """keep p < .5-m or p > .5+m (m = 0 drops exactly p = .5)."""
    p = _c(p)
    return (p < F.lit(0.5 - m)) | (p > F.lit(0.5 + m))


def margin_inclusive(p: ColumnOrName, m: float) -> Column:
    """keep p <= .5-m or p >= .5+m (m = 0 keeps all)."""
    p = _c(p)
    return (p <= F.lit(0.5 - m)) | (p >= F.lit(0.5 + m))


def margin_multiclass(v: ColumnOrName, m: float, k: int) -> Column:
    """keep max < 1/K - m or max > 1/K + m."""
    mx = L.max_prob(v)
    return (mx < F.lit(1.0 / k - m)) | (mx > F.lit(1.0 / k + m))


def top_gap_at_least(v: ColumnOrName, gap: float) -> Column:
    """largest minus second largest >= gap."""
    return L.top_gap(v) >= F.lit(gap)


def max_prob_at_least(v: ColumnOrName, t: float) -> Column:
    """max probability >= t."""
    return L.max_prob(v) >= F.lit(t)


def entropy_at_most(v: ColumnOrName, t: float) -> Column:
    """normalised entropy <= t."""
    return L.entropy_norm(v) <= F.lit(t)


def valid_vector(v: ColumnOrName, k: int) -> Column:
    """label vector has length K (null vectors are invalid)."""
    return F.coalesce(F.size(_c(v)) == F.lit(k), F.lit(False))


def non_blank(text: ColumnOrName) -> Column:
    """Text has at least one non-whitespace character (Unicode aware)."""
    return F.coalesce(_c(text).rlike(r"(?U)\S"), F.lit(False))


def valid_vector_and_text(v: ColumnOrName, text: ColumnOrName, k: int) -> Column:
    """F8: F7 and non-blank text."""
    return valid_vector(v, k) & non_blank(text)


def is_finite(x: ColumnOrName) -> Column:
    """not NaN and not infinite (null is not finite)."""
    x = _c(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


# ------------------------------------------------------------ DataFrame ops
def drop_unlabelled(df: DataFrame, label: str = "label", missing: float = -1.0) -> DataFrame:
    """drop label == -1, then binarise with > .5 and cast to int."""
    return df.filter(F.col(label) != F.lit(missing)) \
        .withColumn(label, (F.col(label) > F.lit(0.5)).cast("int"))


def numeric_judgement(df: DataFrame, score: str = "judge_score",
                      k: int | None = None) -> DataFrame:
    """keep rows whose judged score parsed as a number (scalar) or as a
    length-K vector of numbers.  Booleans never parse to double here because
    the score is read with a typed schema."""
    s = F.col(score)
    if k is None:
        return df.filter(s.isNotNull() & ~F.isnan(s))
    return df.filter(valid_vector(s, k) & F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x)))


def check_range(score: ColumnOrName, confidence: ColumnOrName | None = None,
                k: int | None = None) -> Column:
    """status string for a judgement: 'ok' or the first failed rule."""
    s = _c(score)
    if k is None:
        bad_score = s.isNull() | (s < 0) | (s > 1)
    else:
        bad_score = ~valid_vector(s, k) | F.exists(s, lambda x: x.isNull() | (x < 0) | (x > 1))
    st = F.when(bad_score, F.lit("score_out_of_range"))
    if confidence is not None:
        c = _c(confidence)
        st = st.when(c.isNull() | (c < 0) | (c > 1), F.lit("confidence_out_of_range"))
    return st.otherwise(F.lit("ok"))


def require_list_label(df: DataFrame, label: str = "label",
                       corrupt: str = "_corrupt_record") -> DataFrame:
    """multiclass rows whose label is not a list are dropped.  With a
    typed JSON read such rows surface as null label / corrupt record."""
    cond = F.col(label).isNotNull()
    if corrupt in df.columns:
        cond = cond & F.col(corrupt).isNull()
    return df.filter(cond)


def clean_training_rows(df: DataFrame, k: int, text: str = "text",
                        label: str = "label") -> DataFrame:
    """drop null/blank text, cast labels to int and *fail* the job if any
    label lies outside [0, K-1] (checked inside the plan, no collect)."""
    lab = F.col(label).cast("int")
    bad = lab.isNull() | (lab < 0) | (lab > F.lit(k - 1))
    return (df.filter(non_blank(text))
            .withColumn(label, F.when(bad, F.raise_error(
                F.concat(F.lit("label outside [0, %d]: " % (k - 1)), F.col(label).cast("string"))))
                .otherwise(lab).cast("int")))


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """split into (valid, rejected) with the same predicate."""
    v = F.coalesce(valid, F.lit(False))
    return df.filter(v), df.filter(~v)


def threshold_sweep(df: DataFrame, v: ColumnOrName, method: str,
                    thresholds: Sequence[float]) -> DataFrame:
    """F16: rows surviving each threshold, computed in one pass.

    The statistic is computed once per row; one conditional count per
    threshold is aggregated map-side, then the single row is unpivoted.
    No join and no cross product with the thresholds."""
    stat = {"top_gap": L.top_gap, "max_prob": L.max_prob, "entropy": L.entropy_norm}[method](v)
    keep = (lambda t: F.col("_s") <= F.lit(t)) if method == "entropy" else (lambda t: F.col("_s") >= F.lit(t))
    s = df.select(stat.alias("_s"))
    agg = s.agg(F.count(F.lit(1)).alias("n_total"),
                *[F.count(F.when(keep(t), 1)).alias(f"_k{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(t)).alias("threshold"),
                              F.col(f"_k{i}").alias("n_kept")) for i, t in enumerate(thresholds)])
    return agg.select(F.lit(method).alias("method"), "n_total", F.inline(rows))


def with_label_stats(df: DataFrame, v: ColumnOrName = "label") -> DataFrame:
    """Materialise max_prob / top_gap / entropy so F3–F6 become scalar,
    pushable predicates once the table is written."""
    return df.withColumns({"max_prob": L.max_prob(v), "top_gap": L.top_gap(v),
                           "entropy": L.entropy_norm(v)})
