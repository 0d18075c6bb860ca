"""Calibration queries: A15–A20, A29, F1 + J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import filters as Fi
from ..operators.binning import histogram, linspace_edges
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import bin_cut, bin_lc, bin_rc, dbl, edge_values, edge_values_of

MARGIN = 0.2
N_BINS = 10
# fixed bin edges used by the reference's bin-wise MAE and cut tables
FIXED_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def calibration_table_margin(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    kept = sb.filter(Fi.margin_strict("p", MARGIN))
    return rounded(C.calibration_table(kept, "y", "p", N_BINS))


query("calibration_table_margin", ops="P30 P6 F1 A19 J7", sql=f"""
WITH d AS (SELECT p, y FROM soft_binary WHERE p < {dbl(0.5 - MARGIN)} OR p > {dbl(0.5 + MARGIN)}),
b AS (SELECT {bin_rc('p', N_BINS)} AS bin, p, y FROM d),
g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(CAST(y AS DOUBLE)) AS acc FROM b GROUP BY bin),
spine(bin, lo, hi) AS (VALUES {edge_values(N_BINS)}),
tab AS (SELECT s.bin, s.lo, s.hi, coalesce(g.n, 0) AS n,
               coalesce(g.conf, 0.0) AS conf, coalesce(g.acc, 0.0) AS acc
        FROM spine s LEFT JOIN g ON g.bin = s.bin),
tot AS (SELECT count(*) AS n_total, avg(p) AS avg_conf,
               avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS DOUBLE)) AS ov_acc FROM d)
SELECT CAST(tab.bin AS INTEGER) AS bin, round(tab.lo, 9) AS bin_lo, round(tab.hi, 9) AS bin_hi,
       CAST(tab.n AS BIGINT) AS n, round(tab.conf, 9) AS confidence, round(tab.acc, 9) AS accuracy,
       round(coalesce((SELECT sum(n * abs(conf - acc)) FROM tab) / nullif(tot.n_total, 0), 0.0), 9) AS ece,
       round(coalesce(tot.avg_conf, 0.0), 9) AS avg_confidence,
       round(coalesce(tot.ov_acc, 0.0), 9) AS overall_accuracy,
       CAST(tot.n_total AS BIGINT) AS n_total
FROM tab, tot
""")(calibration_table_margin)


def _ece_sql(src: str, p: str, y: str, n: int = N_BINS) -> str:
    return f"""
WITH b AS (SELECT {bin_rc(p, n)} AS bin, {p} AS p, CAST({y} AS DOUBLE) AS y FROM {src}),
g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM b
      WHERE bin BETWEEN 0 AND {n - 1} GROUP BY bin)
SELECT CAST((SELECT count(*) FROM b) AS BIGINT) AS n_total,
       round(coalesce((SELECT sum(CAST(n AS DOUBLE) / (SELECT count(*) FROM b) * abs(acc - conf)) FROM g), 0.0), 9) AS ece
"""


@query("ece_binary", ops="A15", sql=_ece_sql("soft_binary", "p", "y"))
def ece_binary(spark, sf_dir):
    return rounded(C.ece_binary(X.soft_binary(spark, sf_dir), "y", "p", N_BINS))


@query("ece_binary_big", ops="A15 (no key, heavy ties)", sql=_ece_sql("soft_binary_big", "p", "y"))
def ece_binary_big(spark, sf_dir):
    return rounded(C.ece_binary(X.soft_binary_big(spark, sf_dir), "y", "p", N_BINS))


@query("ece_top_label", ops="A16 P9 P19", sql=_ece_sql(
    "(SELECT list_max(label) AS conf, CAST(list_position(label, list_max(label)) - 1 = y AS INTEGER) AS hit FROM soft_vector)",
    "conf", "hit"))
def ece_top_label(spark, sf_dir):
    return rounded(C.ece_top_label(X.soft_vector(spark, sf_dir), "y", "label", N_BINS))


_PER_CLASS = f"""
WITH ex AS (SELECT CAST(k - 1 AS INTEGER) AS cls, label[k] AS p, CAST(y = k - 1 AS DOUBLE) AS yy
            FROM soft_vector, range(1, 7) r(k)),
b AS (SELECT cls, {bin_rc('p', N_BINS)} AS bin, p, yy FROM ex),
tot AS (SELECT cls, count(*) AS n_all, sum(yy) AS n_pos FROM b GROUP BY cls),
g AS (SELECT cls, bin, count(*) AS n, avg(p) AS conf, avg(yy) AS acc FROM b
      WHERE bin BETWEEN 0 AND {N_BINS - 1} GROUP BY cls, bin),
per AS (SELECT t.cls, t.n_pos,
               coalesce((SELECT sum(CAST(g.n AS DOUBLE) / t.n_all * abs(g.acc - g.conf)) FROM g WHERE g.cls = t.cls), 0.0) AS ece
        FROM tot t)
"""


@query("ece_per_class_macro", ops="A17 A18", sql=_PER_CLASS + "SELECT round(avg(ece), 9) AS ece FROM per")
def ece_per_class_macro(spark, sf_dir):
    return rounded(C.ece_per_class_avg(X.soft_vector(spark, sf_dir), "y", "label", N_BINS, "macro"))


@query("ece_per_class_weighted", ops="A17", sql=_PER_CLASS + "SELECT round(sum(ece * n_pos) / sum(n_pos), 9) AS ece FROM per")
def ece_per_class_weighted(spark, sf_dir):
    return rounded(C.ece_per_class_avg(X.soft_vector(spark, sf_dir), "y", "label", N_BINS, "weighted"))


@query("ece_per_class", ops="A17", sql=_PER_CLASS + "SELECT cls, CAST(n_pos AS BIGINT) AS n_pos, round(ece, 9) AS ece FROM per")
def ece_per_class(spark, sf_dir):
    return rounded(C.ece_per_class(X.soft_vector(spark, sf_dir), "y", "label", N_BINS))


@query("reliability_curve", ops="A20", sql=f"""
SELECT CAST({' + '.join(f'CAST({dbl(e)} < p AS INTEGER)' for e in linspace_edges(5)[1:-1])} AS INTEGER) AS bin,
       round(avg(p), 9) AS prob_pred, round(avg(CAST(y AS DOUBLE)), 9) AS prob_true, count(*) AS n
FROM judged_binary GROUP BY 1
""")
def reliability_curve(spark, sf_dir):
    return rounded(C.reliability_curve(X.judged_binary(spark, sf_dir), "y", "p", 5))


@query("histogram_closed_last", ops="A5 J7", sql=f"""
WITH b AS (SELECT y, {bin_lc('q', linspace_edges(20))} AS bin FROM judged_binary),
spine(bin, lo, hi) AS (VALUES {edge_values(20)}),
hues AS (SELECT DISTINCT y FROM judged_binary),
g AS (SELECT y, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY y, bin),
t AS (SELECT h.y, s.bin, s.lo, s.hi, coalesce(g.n, 0) AS n
      FROM hues h, spine s LEFT JOIN g ON g.y = h.y AND g.bin = s.bin)
SELECT y, CAST(bin AS INTEGER) AS bin, round(lo, 9) AS bin_lo, round(hi, 9) AS bin_hi, CAST(n AS BIGINT) AS n,
       round(CASE WHEN sum(n) OVER (PARTITION BY y) > 0
                  THEN n / (sum(n) OVER (PARTITION BY y) * (hi - lo)) END, 9) AS density
FROM t
""")
def histogram_closed_last(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir)
    return rounded(histogram(jb, "q", linspace_edges(20), hue=["y"], density=True))


@query("cut_bin_mean", ops="A29 J7", sql=f"""
WITH b AS (SELECT {bin_cut('p', FIXED_EDGES)} AS bin, abs(p - q) AS v FROM judged_binary),
spine(bin, lo, hi) AS (VALUES {edge_values_of(FIXED_EDGES)}),
g AS (SELECT bin, count(*) AS n, avg(v) AS m FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT CAST(s.bin AS INTEGER) AS bin, CAST(coalesce(g.n, 0) AS BIGINT) AS n, round(g.m, 9) AS mean
FROM spine s LEFT JOIN g ON g.bin = s.bin
""")
def cut_bin_mean(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir).withColumn("err", F.abs(F.col("p") - F.col("q")))
    return rounded(C.cut_bin_mean(jb, "p", "err", FIXED_EDGES))
