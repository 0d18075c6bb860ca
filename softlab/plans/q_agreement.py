"""Label-fidelity queries: A28, A30–A35, A37."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import filters as Fi
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import bin_lc, edge_values_of

E = A.DEFAULT_EDGES


@query("bin_mae", ops="A28 J7", sql=f"""
WITH d AS (SELECT p AS o, q AS j, abs(p - q) AS e FROM judged_binary WHERE q IS NOT NULL AND NOT isnan(q)),
b AS (SELECT {bin_lc('o', E)} AS bin, o, j, e FROM d),
g AS (SELECT bin, count(*) AS n, avg(e) AS mae, avg(o) AS mo, avg(j) AS mj, stddev_pop(e) AS se,
             min(e) AS mn, max(e) AS mx FROM b WHERE bin IS NOT NULL GROUP BY bin),
spine(bin, lo, hi) AS (VALUES {edge_values_of(E)})
SELECT CAST(s.bin AS INTEGER) AS bin, round(s.lo, 9) AS bin_lo, round(s.hi, 9) AS bin_hi,
       CAST(coalesce(g.n, 0) AS BIGINT) AS count,
       round(coalesce(g.mae, 0.0), 9) AS mean_absolute_error, round(coalesce(g.mo, 0.0), 9) AS mean_original_label,
       round(coalesce(g.mj, 0.0), 9) AS mean_judged_score, round(coalesce(g.se, 0.0), 9) AS std_error,
       round(coalesce(g.mn, 0.0), 9) AS min_error, round(coalesce(g.mx, 0.0), 9) AS max_error
FROM spine s LEFT JOIN g ON g.bin = s.bin""")
def bin_mae(spark, sf_dir):
    return rounded(A.bin_mae(X.judged_binary(spark, sf_dir), "p", "q"))


_SPEARMAN = """
WITH r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp,
                  rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rq
           FROM judged_binary WHERE q IS NOT NULL)"""


@query("pearson_spearman", ops="A30 A31 W2", sql=_SPEARMAN + """
SELECT (SELECT count(*) FROM judged_binary WHERE q IS NOT NULL) AS n,
       round((SELECT corr(p, q) FROM judged_binary WHERE q IS NOT NULL), 9) AS pearson_r,
       round(corr(rp, rq), 9) AS spearman_r FROM r""")
def pearson_spearman(spark, sf_dir):
    return rounded(A.correlations(X.judged_binary(spark, sf_dir), "p", "q", with_p=False))


def _p_sql(r: str) -> str:
    """Two-sided p-value: 1 - I_y(1/2, (n - 2) / 2) at y = r^2, by the power series of the incomplete beta function."""
    a, b, y = "0.5", "((n - 2) / 2.0)", f"({r} * {r})"
    term = (f"exp((0.5 + k) * ln({y}) + {b} * ln(1 - {y}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b} + k) "
            f"+ lgamma({a} + 1) - lgamma({a} + 1 + k))")
    return f"round(greatest(1 - (SELECT sum({term}) FROM range(0, 200000) t(k)), 0), 9)"


@query("correlation_pvalues", ops="A30 A31 p-values", sql=_SPEARMAN + f""", c AS (
SELECT (SELECT count(*) FROM judged_binary WHERE q IS NOT NULL) AS n,
       (SELECT corr(p, q) FROM judged_binary WHERE q IS NOT NULL) AS pr, corr(rp, rq) AS sr FROM r)
SELECT n, round(pr, 9) AS pearson_r, {_p_sql('pr')} AS pearson_p, round(sr, 9) AS spearman_r, {_p_sql('sr')} AS spearman_p FROM c""")
def correlation_pvalues(spark, sf_dir):
    return rounded(A.correlations(X.judged_binary(spark, sf_dir), "p", "q", with_p=True))


@query("mae_rmse", ops="A32", sql="""
SELECT round(avg(abs(p - q)), 9) AS mae, round(sqrt(avg((p - q) * (p - q))), 9) AS rmse,
       count(q) AS valid_pairs, count(*) AS total_pairs FROM judged_binary""")
def mae_rmse(spark, sf_dir):
    return rounded(A.error_summary(X.judged_binary(spark, sf_dir), "p", "q"))


@query("alignment_binary", ops="A34 A30 A31 A32", sql=_SPEARMAN + """
SELECT (SELECT count(*) FROM judged_binary WHERE q IS NOT NULL) AS n,
       round((SELECT corr(p, q) FROM judged_binary WHERE q IS NOT NULL), 9) AS pearson_r,
       round(corr(rp, rq), 9) AS spearman_r,
       (SELECT round(avg(abs(p - q)), 9) FROM judged_binary) AS mae,
       (SELECT round(sqrt(avg((p - q) * (p - q))), 9) FROM judged_binary) AS rmse,
       (SELECT count(q) FROM judged_binary) AS valid_pairs,
       (SELECT count(*) FROM judged_binary) AS total_pairs FROM r""")
def alignment_binary(spark, sf_dir):
    return rounded(A.alignment(X.judged_binary(spark, sf_dir), "p", "q", "binary"))


@query("judge_summary", ops="A35 F11", sql="""
SELECT count(*) AS total,
       count(*) FILTER (WHERE q IS NOT NULL AND q >= 0 AND q <= 1) AS successful,
       count(*) FILTER (WHERE NOT (q IS NOT NULL AND q >= 0 AND q <= 1)) AS failed
FROM judged_binary""")
def judge_summary(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir).withColumn("status", Fi.check_range("q"))
    return A.judge_summary(jb, "status")


@query("judge_metadata", ops="A35 (run metadata) F11", sql="""
SELECT 'binary' AS data_type, 'judge' AS model, 0.7::DOUBLE AS temperature, 16 AS batch_size, '2024-01-01 00:00:00' AS timestamp,
       count(*) AS total_texts, count(*) FILTER (WHERE q >= 0 AND q <= 1) AS successful_judgments,
       count(*) - count(*) FILTER (WHERE q >= 0 AND q <= 1) AS failed_judgments FROM judged_binary""")
def judge_metadata(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir).withColumn("status", Fi.check_range("q"))
    settings = {"data_type": "binary", "model": "judge", "temperature": 0.7, "batch_size": 16}
    return A.judge_metadata(jb, "status", settings, "2024-01-01 00:00:00")


@query("vector_alignment_rows", ops="A33 (a row per pair) P21 P22", sql="""
SELECT id, round(list_dot_product(label, judged) / sqrt(list_dot_product(label, label) * list_dot_product(judged, judged)), 9) AS cosine_similarity,
       round(sqrt(list_sum(list_transform(list_zip(label, judged), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS l2_distance
FROM judged_vector WHERE id % 11 <> 0 AND id % 13 <> 0""")
def vector_alignment_rows(spark, sf_dir):
    """Failed judgements (a short vector, none at all) are among the rows."""
    jv = X.judged_vector(spark, sf_dir)
    judged = F.when(F.col("id") % 11 == 0, F.slice("judged", 1, 5)).when(F.col("id") % 13 != 0, F.col("judged"))
    return rounded(A.vector_alignment_rows(jv.withColumn("judged", judged), "id", "label", "judged"))


@query("label_change", ops="A37", sql="""
SELECT round(avg(abs(q - p)), 9) AS mean_change,
       round(avg(abs(q - p)) FILTER (WHERE p > 0.3 AND p < 0.7), 9) AS mean_change_ambiguous,
       round(avg(abs(q - p)) FILTER (WHERE NOT (p > 0.3 AND p < 0.7)), 9) AS mean_change_confident,
       count(*) FILTER (WHERE p > 0.3 AND p < 0.7) AS n_ambiguous
FROM judged_binary""")
def label_change(spark, sf_dir):
    return rounded(A.label_change(X.judged_binary(spark, sf_dir), "p", "q", 0.2))


@query("correlation_pvalues_weak", ops="A30 A31 p-values", sql=f"""
WITH d AS (SELECT CAST(label AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y FROM emb_labeled WHERE label < 3),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d),
c AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT corr(x, y) FROM d) AS pr, (SELECT corr(rx, ry) FROM k) AS sr)
SELECT n, round(pr, 9) AS pearson_r, {_p_sql('pr')} AS pearson_p, round(sr, 9) AS spearman_r, {_p_sql('sr')} AS spearman_p FROM c""")
def correlation_pvalues_weak(spark, sf_dir):
    """Three classes of the labelled embeddings against one feature: p-values inside (0, 1)."""
    d = X.emb_labeled(spark, sf_dir).filter("label < 3")
    return rounded(A.correlations(d.select(F.col("label").cast("double").alias("x"), F.col("embedding")[0].alias("y")), "x", "y"))
