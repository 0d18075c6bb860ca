"""Agreement between requested and judged labels.

All aggregates; the only ranks (Spearman) come from the two-level prefix
table, and the only Python is the p-value of a correlation, evaluated on a
one-row result through a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import correlation_p
from ..session import shared_table
from .binning import bin_left_closed, bin_table
from .common import one_row, scalar_of
from .ranking import value_ranks
from .similarity import cosine_similarity, l2_distance

ColumnOrName = Column | str
# fixed default bins of the reference's bin-wise MAE
DEFAULT_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_pairs(df: DataFrame, judged: str) -> DataFrame:
    """Keep rows whose judged score is a number."""
    j = F.col(judged)
    return df.filter(j.isNotNull() & ~F.isnan(j))


def bin_mae(df: DataFrame, orig: str, judged: str, edges: Sequence[float] = DEFAULT_EDGES) -> DataFrame:
    """Per [lo, hi) bin of the *original* label (last bin closed):
    count, MAE, mean original, mean judged, population std / min / max of
    the absolute error.  Empty bins report zeros."""
    n = len(edges) - 1
    d = valid_pairs(df, judged).select(
        F.col(orig).cast("double").alias("o"), F.col(judged).cast("double").alias("j"))
    d = d.withColumn("e", F.abs(F.col("o") - F.col("j")))
    t = bin_table(d, bin_left_closed("o", edges), n, {
        "n": F.count(F.lit(1)), "sum_e": F.sum("e"), "std_e": F.stddev_pop("e"),
        "sum_o": F.sum("o"), "sum_j": F.sum("j"), "min_e": F.min("e"), "max_e": F.max("e")})
    cnt = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    nd = F.col("n").cast("double")
    nz = F.col("n") > 0
    mean_e = F.col("sum_e") / nd
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("bin") + 1)
    z = F.lit(0.0)
    return t.select(
        "bin", lo.alias("bin_lo"), hi.alias("bin_hi"), cnt.alias("count"),
        F.when(nz, mean_e).otherwise(z).alias("mean_absolute_error"),
        F.when(nz, F.col("sum_o") / nd).otherwise(z).alias("mean_original_label"),
        F.when(nz, F.col("sum_j") / nd).otherwise(z).alias("mean_judged_score"),
        F.when(nz, F.col("std_e")).otherwise(z).alias("std_error"),
        F.when(nz, F.col("min_e")).otherwise(z).alias("min_error"),
        F.when(nz, F.col("max_e")).otherwise(z).alias("max_error"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r over valid pairs and n."""
    d = valid_pairs(df, y)
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col(x).cast("double"),
                                                      F.col(y).cast("double")).alias("pearson_r"))


def distinct_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """(_x, _y, _w): the distinct valid pairs and their numbers of rows, written once."""
    pairs = valid_pairs(df, y).groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .agg(F.count(F.lit(1)).alias("_w"))
    return shared_table(pairs, "pairs")


def _weighted_r(table: DataFrame, x: str, y: str, mean_x: Column, mean_y: Column, out: str) -> DataFrame:
    """(n, out): Pearson's r of two columns of pairs that stand for ``_w`` rows each."""
    w = F.col("_w").cast("double")
    dx, dy = F.col(x) - mean_x, F.col(y) - mean_y
    sums = table.agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("long").alias("n"), F.sum(w * dx * dy).alias("xy"),
                     F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return sums.select("n", F.when((F.col("xx") > 0) & (F.col("yy") > 0),
                                   F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias(out))


def _spearman(pairs: DataFrame) -> DataFrame:
    ranked = (pairs.join(value_ranks(pairs, "_x", "_rx", F.col("_w")), "_x")
              .join(value_ranks(pairs, "_y", "_ry", F.col("_w")), "_y"))
    mean = (scalar_of(pairs.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"))).getField("n") + 1) / 2.0     # of both ranks
    return _weighted_r(ranked, "_rx", "_ry", mean, mean, "spearman_r")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman rho = Pearson r of tie-averaged ranks.

    Works on the distinct (x, y) pairs and their counts: both marginals are
    ranked by weight, and ranks are joined to pairs, not rows, so values that
    many rows share (0 and 1 in soft labels) stay single rows.  The rows are read
    once."""
    return _spearman(distinct_pairs(df, x, y))


def correlations(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """A30 + A31 with two-sided p-values (t with n - 2 df), both from the distinct
    pairs; the rows are read once."""
    pairs = distinct_pairs(df, x, y)
    w = F.col("_w").cast("double")
    means = scalar_of(pairs.agg((F.sum(w * F.col("_x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("y")))
    p = _weighted_r(pairs, "_x", "_y", means.getField("x"), means.getField("y"), "pearson_r")
    r = one_row(p, _spearman(pairs).select("spearman_r"))
    if not with_p:
        return r
    r = r.select(F.inline(F.array(F.struct("*"))))     # so that the p-values' expressions don't repeat the subqueries
    return r.select("n", "pearson_r", correlation_p(F.col("pearson_r"), F.col("n")).alias("pearson_p"),
                    "spearman_r", correlation_p(F.col("spearman_r"), F.col("n")).alias("spearman_p"))


def error_summary(df: DataFrame, orig: str, judged: str) -> DataFrame:
    """MAE, RMSE, valid and total pairs."""
    j = F.col(judged).cast("double")
    ok = j.isNotNull() & ~F.isnan(j)
    e = F.when(ok, F.abs(F.col(orig).cast("double") - j))
    return df.agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                  F.count(e).alias("valid_pairs"), F.count(F.lit(1)).alias("total_pairs"))


def vector_alignment(df: DataFrame, orig: str, judged: str) -> DataFrame:
    """Mean and population std of cosine similarity and L2 distance."""
    d = df.select(cosine_similarity(orig, judged).alias("cos"), l2_distance(orig, judged).alias("l2"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("cos").alias("mean_cosine"),
                 F.stddev_pop("cos").alias("std_cosine"), F.avg("l2").alias("mean_l2"),
                 F.stddev_pop("l2").alias("std_l2"))


def vector_alignment_rows(df: DataFrame, key: str, orig: str, judged: str) -> DataFrame:
    """(key, cosine_similarity, l2_distance) of every pair; pairs without a
    judged vector of numbers as long as the original go."""
    o, j = F.col(orig), F.col(judged)
    ok = (F.size(j) == F.size(o)) & F.forall(j, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.filter(ok).select(key, cosine_similarity(orig, judged).alias("cosine_similarity"), l2_distance(orig, judged).alias("l2_distance"))


def alignment(df: DataFrame, orig: str, judged: str, kind: str) -> DataFrame:
    """Scalar alignment for binary sets, vector alignment otherwise."""
    if kind == "binary":
        return one_row(correlations(df, orig, judged, with_p=False), error_summary(df, orig, judged))
    return vector_alignment(df, orig, judged)


def judge_summary(df: DataFrame, status: ColumnOrName) -> DataFrame:
    """Successful / failed judgement counts."""
    ok = _c(status) == F.lit("ok")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
                  F.count_if(~ok | _c(status).isNull()).alias("failed"))


def judge_metadata(df: DataFrame, status: ColumnOrName, settings: dict, timestamp: str | None = None) -> DataFrame:
    """One row with a judging run's settings (a column each), its time and
    its numbers of texts, successful and failed judgements."""
    at = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    s = judge_summary(df, status)
    return s.select(*[F.lit(v).alias(k) for k, v in settings.items()], at.alias("timestamp"), F.col("total").alias("total_texts"),
                    F.col("successful").alias("successful_judgments"), F.col("failed").alias("failed_judgments"))


def label_change(df: DataFrame, before: str, after: str, margin: float) -> DataFrame:
    """Mean |after - before| overall, in the ambiguous region (strictly
    inside .5 +- m) and in the confident region."""
    b = F.col(before).cast("double")
    ch = F.abs(F.col(after).cast("double") - b)
    amb = (b > F.lit(0.5 - margin)) & (b < F.lit(0.5 + margin))
    return df.agg(F.avg(ch).alias("mean_change"),
                  F.avg(F.when(amb, ch)).alias("mean_change_ambiguous"),
                  F.avg(F.when(~amb, ch)).alias("mean_change_confident"),
                  F.count_if(amb).alias("n_ambiguous"))
