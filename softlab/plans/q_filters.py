"""Filter queries: F1–F9, F11, F13, F14, F16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as Fi
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import dbl

K = X.K_VECTOR
M = 0.2
SWEEP = [round(0.05 * i, 2) for i in range(11)]
_TOPGAP = "(list_reverse_sort(label)[1] - list_reverse_sort(label)[2])"
_ENTROPY = f"(-list_sum(list_transform(label, lambda x: x * ln(x + 1e-10))) / ln({K}))"


@query("margin_strict", ops="F1", sql=f"""
SELECT id, p, y FROM soft_binary WHERE p < {dbl(0.5 - M)} OR p > {dbl(0.5 + M)}""")
def margin_strict(spark, sf_dir):
    return X.soft_binary(spark, sf_dir).filter(Fi.margin_strict("p", M))


@query("margin_inclusive", ops="F2", sql=f"""
SELECT id, p, y FROM soft_binary WHERE p <= {dbl(0.5 - M)} OR p >= {dbl(0.5 + M)}""")
def margin_inclusive(spark, sf_dir):
    return X.soft_binary(spark, sf_dir).filter(Fi.margin_inclusive("p", M))


@query("margin_counts", ops="F1 F2 at every margin", sql="\nUNION ALL\n".join(
    f"SELECT CAST({m} AS DOUBLE) AS margin, count(*) FILTER (WHERE p < {dbl(0.5 - m)} OR p > {dbl(0.5 + m)}) AS n_strict, "
    f"count(*) FILTER (WHERE p <= {dbl(0.5 - m)} OR p >= {dbl(0.5 + m)}) AS n_inclusive FROM soft_binary"
    for m in (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)))
def margin_counts(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    ms = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
    a = sb.agg(*[F.count_if(Fi.margin_strict("p", m)).alias(f"s{i}") for i, m in enumerate(ms)],
               *[F.count_if(Fi.margin_inclusive("p", m)).alias(f"i{i}") for i, m in enumerate(ms)])
    return a.select(F.inline(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"s{i}").alias("n_strict"),
                                                F.col(f"i{i}").alias("n_inclusive")) for i, m in enumerate(ms)])))


@query("margin_multiclass", ops="F3", sql=f"""
SELECT id, y FROM soft_vector WHERE list_max(label) < {dbl(1.0 / K - 0.05)} OR list_max(label) > {dbl(1.0 / K + 0.05)}""")
def margin_multiclass(spark, sf_dir):
    return X.soft_vector(spark, sf_dir).filter(Fi.margin_multiclass("label", 0.05, K)).select("id", "y")


@query("top_gap", ops="F4 P18", sql=f"SELECT id, y FROM soft_vector WHERE {_TOPGAP} >= 0.1")
def top_gap(spark, sf_dir):
    return X.soft_vector(spark, sf_dir).filter(Fi.top_gap_at_least("label", 0.1)).select("id", "y")


@query("max_prob", ops="F5 P19", sql="SELECT id, y FROM soft_vector WHERE list_max(label) >= 0.3")
def max_prob(spark, sf_dir):
    return X.soft_vector(spark, sf_dir).filter(Fi.max_prob_at_least("label", 0.3)).select("id", "y")


@query("entropy", ops="F6 P17", sql=f"SELECT id, y FROM soft_vector WHERE {_ENTROPY} <= 0.97")
def entropy(spark, sf_dir):
    return X.soft_vector(spark, sf_dir).filter(Fi.entropy_at_most("label", 0.97)).select("id", "y")


@query("threshold_sweep", ops="F16", sql="\nUNION ALL\n".join(
    f"SELECT 'top_gap' AS method, count(*) AS n_total, {i} AS step, CAST({t} AS DOUBLE) AS threshold, "
    f"count(*) FILTER (WHERE {_TOPGAP} >= {t}) AS n_kept FROM soft_vector" for i, t in enumerate(SWEEP)))
def threshold_sweep(spark, sf_dir):
    return Fi.threshold_sweep(X.soft_vector(spark, sf_dir), "label", "top_gap", SWEEP)


@query("threshold_sweep_entropy", ops="F16 (entropy, <=)", sql="\nUNION ALL\n".join(
    f"SELECT 'entropy' AS method, count(*) AS n_total, {i} AS step, CAST({t} AS DOUBLE) AS threshold, "
    f"count(*) FILTER (WHERE {_ENTROPY} <= {t}) AS n_kept FROM soft_vector"
    for i, t in enumerate([0.9 + 0.01 * j for j in range(11)])))
def threshold_sweep_entropy(spark, sf_dir):
    return Fi.threshold_sweep(X.soft_vector(spark, sf_dir), "label", "entropy", [0.9 + 0.01 * j for j in range(11)])


# Vectors of the wrong length: the id hash drops the last class for 1/16 rows.
_SHORT_SQL = "CASE WHEN substr(md5(CAST(id AS VARCHAR)), 2, 1) = '0' THEN label[1:5] ELSE label END"


def _short(sv):
    h = F.substring(F.md5(F.col("id").cast("string")), 2, 1)
    return sv.withColumn("v", F.when(h == "0", F.slice("label", 1, K - 1)).otherwise(F.col("label")))


@query("valid_vector", ops="F7", sql=f"SELECT id FROM soft_vector WHERE len({_SHORT_SQL}) = {K}")
def valid_vector(spark, sf_dir):
    return _short(X.soft_vector(spark, sf_dir)).filter(Fi.valid_vector("v", K)).select("id")


@query("valid_vector_text", ops="F8", sql=f"""
SELECT v.id FROM soft_vector v JOIN texts t ON t.id = v.id
WHERE len({_SHORT_SQL.replace('label', 'v.label').replace('CAST(id', 'CAST(v.id')}) = {K}
  AND regexp_matches(coalesce(t.text, ''), '[^\\t\\n\\x{{0B}}\\f\\r\\x{{1C}}-\\x{{1F}} \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')""")
def valid_vector_text(spark, sf_dir):
    sv = _short(X.soft_vector(spark, sf_dir))
    t = X.texts(spark, sf_dir).select("id", "text")
    return sv.join(t, "id").filter(Fi.valid_vector_and_text("v", "text", K)).select("id")


@query("drop_unlabelled", ops="F9", sql="""
SELECT id, CAST(p > 0.5 AS INTEGER) AS label
FROM (SELECT id, CASE WHEN p = 0 THEN -1.0 ELSE p END AS p FROM soft_binary) WHERE p <> -1""")
def drop_unlabelled(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir).select("id", F.when(F.col("p") == 0, F.lit(-1.0)).otherwise(F.col("p")).alias("label"))
    return Fi.drop_unlabelled(sb, "label")


@query("judgement_range_check", ops="F10 F11", sql="""
SELECT CASE WHEN q IS NULL OR q < 0 OR q > 1 THEN 'score_out_of_range'
            WHEN p IS NULL OR p < 0 OR p > 1 THEN 'confidence_out_of_range' ELSE 'ok' END AS status,
       count(*) AS n
FROM (SELECT q * 1.5 - 0.25 AS q, p FROM judged_binary) GROUP BY 1""")
def judgement_range_check(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir).select((F.col("q") * 1.5 - 0.25).alias("q"), "p")
    jb = Fi.numeric_judgement(jb, "q")                       # F10: judged numbers only
    return jb.groupBy(Fi.check_range("q", "p").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_training_rows", ops="F13", sql="""
SELECT id, CAST(y AS INTEGER) AS y FROM gold_text
WHERE regexp_matches(coalesce(text, ''), '[^\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')""")
def clean_training_rows(spark, sf_dir):
    g = X.gold_text(spark, sf_dir).withColumnRenamed("y", "label")
    return Fi.clean_training_rows(g, 2, "text", "label").select("id", F.col("label").alias("y"))


@query("response_quarantine", ops="F14 F10", sql="""
SELECT CASE WHEN response IS NOT NULL AND regexp_matches(response, '[^\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')
            THEN 'valid' ELSE 'rejected' END AS status, count(*) AS n
FROM responses GROUP BY 1""")
def response_quarantine(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    valid, rejected = Fi.quarantine(r, Fi.non_blank("response"))
    return valid.select(F.lit("valid").alias("status")).unionByName(
        rejected.select(F.lit("rejected").alias("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("label_stats_pushdown", ops="F3-F6 materialised stats", sql=f"""
SELECT id, round(list_max(label), 9) AS max_prob, round({_TOPGAP}, 9) AS top_gap, round({_ENTROPY}, 9) AS entropy
FROM soft_vector""")
def label_stats_pushdown(spark, sf_dir):
    return rounded(Fi.with_label_stats(X.soft_vector(spark, sf_dir)).select("id", "max_prob", "top_gap", "entropy"))
