"""Classification metric queries: A7–A14, A21, A22, A38."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import calibration as C
from ..operators import metrics as M
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import bin_rc

K = X.K_VECTOR


def _auc_sql(src: str, y: str, s: str, group: str = "") -> str:
    """Mann-Whitney AUC from tie-averaged ranks (definition, not our plan)."""
    g = f"PARTITION BY {group}" if group else ""
    g2 = f"PARTITION BY {group}, {s}" if group else f"PARTITION BY {s}"
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {sel}CAST(sum({y}) AS BIGINT) AS n_pos, CAST(count(*) - sum({y}) AS BIGINT) AS n_neg,
       CASE WHEN sum({y}) > 0 AND count(*) - sum({y}) > 0 THEN
         (sum(rk) FILTER (WHERE {y} = 1) - CAST(sum({y}) AS DOUBLE) * (sum({y}) + 1) / 2)
         / (CAST(sum({y}) AS DOUBLE) * (count(*) - sum({y}))) END AS roc_auc
FROM (SELECT {sel}{y}, rank() OVER ({g} ORDER BY {s}) + (count(*) OVER ({g2}) - 1) / 2.0 AS rk
      FROM {src}) r
{gb}"""


def _ap_sql(src: str, y: str, s: str, group: str = "") -> str:
    """Step-wise average precision: sum over thresholds of dRecall * precision."""
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    pb = f"PARTITION BY {group}" if group else ""
    return f"""
SELECT {sel}CASE WHEN sum(tp) > 0 THEN sum(tp * tpt / nt) / sum(tp) END AS average_precision
FROM (SELECT {sel}tp, sum(tp) OVER ({pb} ORDER BY s DESC) AS tpt, sum(n) OVER ({pb} ORDER BY s DESC) AS nt
      FROM (SELECT {sel}{s} AS s, CAST(sum({y}) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS n
            FROM {src} GROUP BY {sel}{s}) g) c
{gb}"""


def _r(sql: str, cols: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in cols)}) FROM ({sql})"


def _auc_ap(df, y, s, group_cols=()):
    return rounded(M.auc_ap_table(df, y, s, group_cols=group_cols))


@query("roc_auc", ops="A11 W1", sql=_r(_auc_sql("soft_binary", "y", "p"), ["roc_auc"]))
def roc_auc(spark, sf_dir):
    return _auc_ap(X.soft_binary(spark, sf_dir), "y", "p").select("n_pos", "n_neg", "roc_auc")


@query("roc_auc_big", ops="A11 W1 (600k rows at sf0.1, 11 tied levels)",
       sql=_r(_auc_sql("soft_binary_big", "y", "p"), ["roc_auc"]))
def roc_auc_big(spark, sf_dir):
    return _auc_ap(X.soft_binary_big(spark, sf_dir), "y", "p").select("n_pos", "n_neg", "roc_auc")


@query("average_precision", ops="A14 W1", sql=_r(_ap_sql("soft_binary", "y", "p"), ["average_precision"]))
def average_precision(spark, sf_dir):
    return _auc_ap(X.soft_binary(spark, sf_dir), "y", "p").select("average_precision")


@query("average_precision_big", ops="A14 W1", sql=_r(_ap_sql("soft_binary_big", "y", "p"), ["average_precision"]))
def average_precision_big(spark, sf_dir):
    return _auc_ap(X.soft_binary_big(spark, sf_dir), "y", "p").select("average_precision")


# scores that equal-width chunks would put into one: squeezed near 0, far outside [0, 1], one dominant tie
_ODD_SCORES = {
    "squeezed": "(p + id * 1e-7) * 1e-9",
    "wide": "(p - 0.5) * 1e6 + id",
    "one_tie": "CASE WHEN id % 10 < 8 THEN 1.0 ELSE p END",
}


def _odd_rank_query(kind: str, score: str) -> None:
    src = f"(SELECT y, CAST({score} AS DOUBLE) AS s FROM soft_binary)"

    @query(f"rank_metrics_{kind}", ops="A11 A14 W1 on skewed scores", sql=f"""
SELECT n_pos, n_neg, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision
FROM ({_auc_sql(src, "y", "s")}) a, ({_ap_sql(src, "y", "s")}) b""")
    def run(spark, sf_dir):
        return _auc_ap(X.soft_binary(spark, sf_dir).withColumn("s", F.expr(score).cast("double")), "y", "s")


for _kind, _score in _ODD_SCORES.items():
    _odd_rank_query(_kind, _score)


_OVR_SRC = f"(SELECT CAST(k - 1 AS INTEGER) AS cls, label[k] AS p, CAST(y = k - 1 AS INTEGER) AS yy FROM soft_vector, range(1, {K + 1}) r(k))"


@query("roc_auc_ovr", ops="A12", sql=f"""
WITH per AS ({_auc_sql(_OVR_SRC, 'yy', 'p', 'cls')})
SELECT round(avg(roc_auc), 9) AS roc_auc_macro,
       round(sum(roc_auc * n_pos) / sum(n_pos), 9) AS roc_auc_weighted FROM per""")
def roc_auc_ovr(spark, sf_dir):
    per = M.ovr_auc_ap(X.soft_vector(spark, sf_dir), "y", "label")
    return rounded(per.agg(F.avg("roc_auc").alias("roc_auc_macro"),
                           (F.sum(F.col("roc_auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc_weighted")))


@query("ap_ovr", ops="A14 OvR", sql=f"""
WITH per AS ({_ap_sql(_OVR_SRC, 'yy', 'p', 'cls')}),
np AS (SELECT cls, sum(yy) AS n_pos FROM {_OVR_SRC} GROUP BY cls)
SELECT round(avg(average_precision), 9) AS ap_macro,
       round(sum(average_precision * n_pos) / sum(n_pos), 9) AS ap_weighted
FROM per JOIN np USING (cls)""")
def ap_ovr(spark, sf_dir):
    per = M.ovr_auc_ap(X.soft_vector(spark, sf_dir), "y", "label")
    return rounded(per.agg(F.avg("average_precision").alias("ap_macro"),
                           (F.sum(F.col("average_precision") * F.col("n_pos")) / F.sum("n_pos")).alias("ap_weighted")))


@query("roc_auc_ovo", ops="A13", sql=f"""
WITH dirs AS (SELECT a.k AS c, b.k AS d FROM range(0, {K}) a(k), range(0, {K}) b(k) WHERE a.k <> b.k),
src AS (SELECT dirs.c, dirs.d, v.label[dirs.c + 1] AS s, CAST(v.y = dirs.c AS INTEGER) AS pos
        FROM soft_vector v JOIN dirs ON v.y = dirs.c OR v.y = dirs.d),
per AS ({_auc_sql('(SELECT c * 100 + d AS cd, s, pos FROM src)', 'pos', 's', 'cd')})
SELECT round(avg(pair_auc), 9) AS roc_auc_ovo FROM (
  SELECT least(cd // 100, cd % 100) AS a, greatest(cd // 100, cd % 100) AS b, avg(roc_auc) AS pair_auc
  FROM per GROUP BY 1, 2)""")
def roc_auc_ovo(spark, sf_dir):
    return rounded(M.roc_auc_ovo(X.soft_vector(spark, sf_dir), "y", "label", K))


_ARGMAX = "CAST(list_position(label, list_max(label)) - 1 AS INTEGER)"


@query("confusion", ops="A7", sql=f"""
SELECT y, {_ARGMAX} AS yhat, count(*) AS n FROM soft_vector GROUP BY 1, 2""")
def confusion(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    return M.confusion(sv, "y", L.argmax("label"))


_PER_CLASS = f"""
WITH s AS (SELECT y, {_ARGMAX} AS yhat FROM soft_vector),
labs AS (SELECT y AS cls FROM s UNION SELECT yhat FROM s),
pc AS (SELECT l.cls,
              (SELECT count(*) FROM s WHERE s.y = l.cls AND s.yhat = l.cls) AS tp,
              (SELECT count(*) FROM s WHERE s.yhat = l.cls) AS pred,
              (SELECT count(*) FROM s WHERE s.y = l.cls) AS support FROM labs l),
prf AS (SELECT cls, tp, pred, support,
               CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
prf2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM prf)
"""


@query("classification_report", ops="A10 A9", sql=_PER_CLASS + """
SELECT CAST(cls AS VARCHAR) AS label, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM prf2
UNION ALL
SELECT 'accuracy', round(sum(tp) / sum(support), 9), round(sum(tp) / sum(support), 9),
       round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM prf2
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
       CAST(sum(support) AS BIGINT) FROM prf2
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       CAST(sum(support) AS BIGINT) FROM prf2""")
def classification_report(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    return rounded(M.classification_report(sv.withColumn("yhat", L.argmax("label")), "y", "yhat"))


@query("f1_macro", ops="A9", sql=_PER_CLASS + """
SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM prf2""")
def f1_macro(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    return rounded(M.prf(sv.withColumn("yhat", L.argmax("label")), "y", "yhat", "macro"))


@query("f1_micro_weighted", ops="A9", sql=_PER_CLASS + """
SELECT round(sum(tp) / sum(pred), 9) AS micro_f1,
       round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM prf2""")
def f1_micro_weighted(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir).withColumn("yhat", L.argmax("label"))
    mi = M.prf(sv, "y", "yhat", "micro").select(F.col("f1").alias("micro_f1"))
    we = M.prf(sv, "y", "yhat", "weighted").select(F.col("f1").alias("weighted_f1"))
    return rounded(M._one_row(mi, we))


@query("prf_binary", ops="A9 P8", sql="""
WITH s AS (SELECT y, CAST(p >= 0.5 AS INTEGER) AS yhat FROM soft_binary),
c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS tp,
             count(*) FILTER (WHERE yhat = 1) AS pred, count(*) FILTER (WHERE y = 1) AS pos FROM s)
SELECT round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 9) AS precision,
       round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 9) AS recall,
       round(CASE WHEN pred + pos > 0 THEN 2 * tp / (pred + pos) ELSE 0 END, 9) AS f1 FROM c""")
def prf_binary(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir).withColumn("yhat", L.predict_at("p"))
    return rounded(M.prf(sb, "y", "yhat", "binary"))


@query("brier", ops="A21", sql=f"""
SELECT round(avg(list_sum(list_transform(range(1, {K + 1}), lambda k: pow(label[k] - CAST(y = k - 1 AS DOUBLE), 2)))), 9) AS brier,
       (SELECT round(avg(pow(p - y, 2)), 9) FROM soft_binary) AS brier_binary
FROM soft_vector""")
def brier(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir).agg(C.brier_multiclass("y", "label").alias("brier"))
    sb = X.soft_binary(spark, sf_dir)
    bb = sb.agg(C.brier_binary(sb, "y", "p").alias("brier_binary"))
    return rounded(M._one_row(sv, bb))


@query("nll", ops="A22", sql=f"""
SELECT round(avg(-ln(least(greatest(label[y + 1], {C.LOG_EPS!r}), 1 - {C.LOG_EPS!r}))), 9) AS nll,
       (SELECT round(avg(-(y * ln(least(greatest(p, {C.LOG_EPS!r}), 1 - {C.LOG_EPS!r}))
                     + (1 - y) * ln(1 - least(greatest(p, {C.LOG_EPS!r}), 1 - {C.LOG_EPS!r})))), 9)
        FROM soft_binary) AS log_loss_binary
FROM soft_vector""")
def nll(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir).agg(C.nll_multiclass("y", "label").alias("nll"))
    sb = X.soft_binary(spark, sf_dir).agg(C.log_loss_binary("y", "p").alias("log_loss_binary"))
    return rounded(M._one_row(sv, sb))


@query("kl_divergence", ops="A22", sql="""
SELECT round(avg(list_sum(list_transform(range(1, len(label) + 1),
         lambda k: CASE WHEN label[k] > 0 THEN label[k] * (ln(label[k]) - ln(judged[k])) ELSE 0 END))), 9) AS kl
FROM judged_vector""")
def kl_divergence(spark, sf_dir):
    jv = X.judged_vector(spark, sf_dir)
    return rounded(jv.agg(C.kl_divergence("label", "judged").alias("kl")))


def _eval_binary_sql() -> str:
    return f"""
WITH s AS (SELECT y, p, CAST(p >= 0.5 AS INTEGER) AS yhat FROM soft_binary),
c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS tp,
             count(*) FILTER (WHERE yhat = 1) AS pred, count(*) FILTER (WHERE y = 1) AS pos,
             avg(CAST(y = yhat AS DOUBLE)) AS acc FROM s),
auc AS ({_auc_sql('soft_binary', 'y', 'p')}),
ap AS ({_ap_sql('soft_binary', 'y', 'p')}),
b AS (SELECT {bin_rc('p', 10)} AS bin, p, CAST(y AS DOUBLE) AS y FROM soft_binary),
g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY bin),
ece AS (SELECT coalesce(sum(CAST(n AS DOUBLE) / (SELECT count(*) FROM b) * abs(acc - conf)), 0.0) AS ece FROM g)
SELECT round(c.acc, 9) AS accuracy,
       round(CASE WHEN pred > 0 THEN tp / pred ELSE 0 END, 9) AS precision,
       round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, 9) AS recall,
       round(CASE WHEN pred + pos > 0 THEN 2 * tp / (pred + pos) ELSE 0 END, 9) AS f1_score,
       round(auc.roc_auc, 9) AS roc_auc, round(ap.average_precision, 9) AS auprc, round(ece.ece, 9) AS ece
FROM c, auc, ap, ece"""


@query("evaluate_binary", ops="A38 A8 A9 A11 A14 A15", sql=_eval_binary_sql())
def evaluate_binary(spark, sf_dir):
    return rounded(M.evaluate_binary(X.soft_binary(spark, sf_dir), "y", "p"))


@query("evaluate_multiclass", ops="A38 A8 A9 A12 A14 A17", sql=_PER_CLASS + f""",
auc AS ({_auc_sql(_OVR_SRC, 'yy', 'p', 'cls')}),
ap AS ({_ap_sql(_OVR_SRC, 'yy', 'p', 'cls')}),
b AS (SELECT cls, {bin_rc('p', 10)} AS bin, p, CAST(yy AS DOUBLE) AS yy FROM {_OVR_SRC}),
tot AS (SELECT cls, count(*) AS n_all FROM b GROUP BY cls),
g AS (SELECT cls, bin, count(*) AS n, avg(p) AS conf, avg(yy) AS acc FROM b WHERE bin BETWEEN 0 AND 9 GROUP BY cls, bin),
ece AS (SELECT t.cls, coalesce((SELECT sum(CAST(g.n AS DOUBLE) / t.n_all * abs(g.acc - g.conf)) FROM g WHERE g.cls = t.cls), 0.0) AS ece FROM tot t)
SELECT round((SELECT avg(CAST(y = yhat AS DOUBLE)) FROM s), 9) AS accuracy,
       round((SELECT avg(precision) FROM prf2), 9) AS precision,
       round((SELECT avg(recall) FROM prf2), 9) AS recall,
       round((SELECT avg(f1) FROM prf2), 9) AS f1_score,
       round((SELECT avg(roc_auc) FROM auc), 9) AS roc_auc,
       round((SELECT avg(average_precision) FROM ap), 9) AS auprc,
       round((SELECT avg(ece) FROM ece), 9) AS ece""")
def evaluate_multiclass(spark, sf_dir):
    return rounded(M.evaluate_multiclass(X.soft_vector(spark, sf_dir), "y", "label", "macro"))
