"""Model, experiment, refinement and influence queries.

Floating-point optima: these are rows-only checks (no SQL oracle) and
publish bounded-precision summaries (4 decimals).  Their correctness tests
are optimality conditions in ``tests/test_models.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import agreement as A
from ..operators import calibration as C
from ..operators import experiments as E
from ..operators import influence as I
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import refine as RF
from ..operators.filters import margin_inclusive
from ..sources import fixtures as X
from .registry import query, rounded

K = 10


def soft_embeddings(spark, sf_dir):
    """emb_labeled + a 10-class soft label P_k ~ exp(-|k - label|), a binary
    soft label p = (label + .5) / 10, its vector [1-p, p], the hard binary
    truth and a 75/25 train/test split by id hash."""
    e = X.emb_labeled(spark, sf_dir)
    w = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.exp(-F.abs(k - F.col("label")).cast("double")))
    p = (F.col("label") + 0.5) / 10.0
    return e.select("id", "embedding", "label", L.normalize(w).alias("soft"), p.alias("p"),
                    L.to_binary_vector(p).alias("pvec"), (F.col("label") >= 5).cast("int").alias("yb"),
                    (F.substring(F.md5(F.col("id").cast("string")), 1, 1) < "c").alias("is_train"))


def _split(spark, sf_dir):
    d = soft_embeddings(spark, sf_dir)
    return d.filter("is_train"), d.filter(~F.col("is_train"))


@query("soft_lr_summary", ops="M1 M2 A38")
def soft_lr_summary(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = MD.fit_soft_lr(train, "embedding", "soft", C=1.0)
    scored = m.predict_proba(test, "proba")
    return rounded(M.evaluate_multiclass(scored, "label", "proba"), 4)


@query("soft_lr_cv_best", ops="M3 M4 W5 N13 J6")
def soft_lr_cv_best(spark, sf_dir):
    train = soft_embeddings(spark, sf_dir)      # CV needs no hold-out: all rows
    _m, means, c_best = MD.fit_soft_lr_cv(train, "embedding", "soft", cs=[0.01, 1.0, 100.0], folds=3,
                                          scoring="accuracy", seed=3)
    return rounded(means.withColumn("is_best", F.col("C") == F.lit(c_best)), 4)


@query("standard_lr_cv", ops="M9 M4")
def standard_lr_cv(spark, sf_dir):
    train = soft_embeddings(spark, sf_dir)
    _m, means, c_best = MD.fit_standard_lr_cv(train, "embedding", "label", cs=3, folds=3,
                                              scoring="neg_log_loss", seed=3)
    return rounded(means.withColumn("is_best", F.col("C") == F.lit(c_best)), 4)


@query("gce_lr_summary", ops="M5 M6 M7")
def gce_lr_summary(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = MD.fit_gce_lr(train, "embedding", "soft", C=1.0, q=0.7, seed=1)
    scored = m.predict_proba(test, "proba").withColumn("pred", L.argmax("proba"))
    acc = scored.agg(M.accuracy("label", "pred").alias("accuracy"),
                     F.avg(MD.gce_loss("soft", "proba", 0.7)).alias("test_gce"))
    return rounded(acc, 4)


@query("gold_judge_alignment", ops="M16 A30 A32 A34")
def gold_judge_alignment(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    scored, means, c_best = MD.gold_judge(train, test, "embedding", "yb", cs=[0.1, 1.0, 10.0], folds=3, seed=5)
    al = A.alignment(scored, "p", "judge_score", "binary")
    return rounded(al, 4)


@query("platt", ops="M17 A15")
def platt(spark, sf_dir):
    """The calibrator is fitted on margins of the training rows; both errors are measured on the test rows."""
    train, test = _split(spark, sf_dir)
    m = MD.fit_standard_lr(train, "embedding", "yb", C=0.01, binary=True)
    cal = MD.platt_calibrate(m.margin(train), "margin", "yb")
    sc = m.margin(m.predict_proba(test, "proba")).withColumn("p1", F.col("proba")[1])
    sc = cal.predict_proba(sc.withColumn("_m", F.array("margin")), "cal").withColumn("pc", F.col("cal")[1])
    before = C.ece_binary(sc, "yb", "p1").select(F.col("ece").alias("ece_before"))
    after = C.ece_binary(sc, "yb", "pc").select(F.col("ece").alias("ece_after"))
    from ..operators.common import one_row
    return rounded(one_row(before, after), 4)


@query("unregularized_lr", ops="M10 A8")
def unregularized_lr(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    m = MD.fit_standard_lr(train, "embedding", "label", C=None)
    return rounded(m.predict(test, "pred").agg(M.accuracy("label", "pred").alias("accuracy")), 4)


_SMALL_CV = {"cs": [0.1, 10.0], "folds": 3}


@query("margin_sweep", ops="M14 M12 F2 A36 N3")
def margin_sweep(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    res = E.margin_sweep(train, test, [0.0, 0.2], E.pool_sizes(train, [0.1]), 2, p_col="p", features="embedding",
                         probs="pvec", y="yb", seed=11, **_SMALL_CV)
    return rounded(E.trial_summary(res, ["margin", "size", "split"], ["accuracy", "ece"]), 4)


_DRAWS = [0.0, 0.2]


def _draws_sql(m: float) -> str:
    return f"""
SELECT CAST({m} AS DOUBLE) AS margin, size, trial, id, count(*) AS weight FROM (
  SELECT z.size, CAST(t.trial AS BIGINT) AS trial,
         CAST(('0x' || substr(md5(CAST(11 + t.trial AS VARCHAR) || ':' || CAST(j.j AS VARCHAR)), 1, 15)) AS BIGINT) AS h
  FROM (VALUES (CAST(500 AS BIGINT)), (20000)) z(size), range(0, 3) t(trial), range(0, 20000) j(j) WHERE j.j < z.size) d
JOIN (SELECT id, row_number() OVER (ORDER BY md5('11:' || CAST(id AS VARCHAR)), id) - 1 AS pos, count(*) OVER () AS n
      FROM soft_binary WHERE p <= 0.5 - {m} OR p >= 0.5 + {m}) pool ON pool.pos = d.h % {{n}}
GROUP BY ALL""".replace("{n}", f"(SELECT count(*) FROM soft_binary WHERE p <= 0.5 - {m} OR p >= 0.5 + {m})")


@query("margin_draws", ops="M12 M14 N3 (the sampling half)", sql="\nUNION ALL\n".join(_draws_sql(m) for m in _DRAWS))
def margin_draws(spark, sf_dir):
    """Sizes below and above the pool's: the weights of a trial add up to the size in both."""
    out = None
    for m in _DRAWS:
        pool = X.soft_binary(spark, sf_dir).filter(margin_inclusive("p", m))
        d = E.training_draws(pool, [500, 20000], 3, 11).withColumn("margin", F.lit(m))
        out = d if out is None else out.unionByName(d)
    return out.select("margin", "size", "trial", "id", "weight")


@query("subset_curve", ops="M13 M12 A36")
def subset_curve(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return rounded(E.gold_subset_curve(train, test, E.pool_sizes(train, [0.05, 0.25]), 2, "embedding", "yb", C=1.0, seed=2), 4)


@query("entropy_sweep", ops="M15 F6")
def entropy_sweep(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    res = E.entropy_sweep(train, test, [1.0, 0.8], E.pool_sizes(train, [0.1]), 2, probs="soft", features="embedding",
                          y="label", C=1.0, seed=4)
    return rounded(E.trial_summary(res, ["threshold", "size", "split"], ["accuracy", "f1_score"]), 4)


@query("top_gap_sweep", ops="M15 F4")
def top_gap_sweep(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    res = E.top_gap_sweep(train, test, [0.0, 0.3], E.pool_sizes(train, [0.1]), 2, probs="soft", features="embedding",
                          y="label", C=1.0, seed=4)
    return rounded(E.trial_summary(res, ["gap", "size", "split"], ["accuracy", "f1_score"]), 4)


@query("oracle_relabel", ops="M18")
def oracle_relabel(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    half = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":gold"))), 1, 1) < "8"
    gold, synth = train.filter(half), train.filter(~half)
    _rel, m = RF.relabel_with_oracle(gold, synth, "embedding", "yb", **_SMALL_CV)
    sc = m.predict_proba(test, "proba").withColumn("p1", F.col("proba")[1])
    return rounded(M.evaluate_binary(sc, "yb", "p1").select("accuracy", "roc_auc"), 4)


@query("refine_labels", ops="M19 A37")
def refine_labels(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    _lab, hist = RF.refine_labels(train.select("id", "embedding", "p"), [0.3, 0.2, 0.1], test=test, y="yb", **_SMALL_CV)
    return rounded(hist, 4)


@query("refine_converge", ops="M20 M21")
def refine_converge(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    _lab, hist = RF.refine_labels_converge(train.select("id", "embedding", "p"), [0.3, 0.1], alpha=0.5, max_inner=12, tol=1e-3,
                                           ambiguous_tol=1e-3, test=test, y="yb", **_SMALL_CV)
    return rounded(hist, 4)


@query("influence_topk", ops="M22 M23 W4")
def influence_topk(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    sc = I.influence_scores(train, test, "embedding", "soft", C=1.0, damping=0.01, sample_frac=1.0,
                            cg_tol=1e-8)
    return rounded(I.top_influential(sc, 10), 4)
