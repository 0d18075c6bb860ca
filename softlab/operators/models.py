"""Soft-label linear models.

M1  Soft-label logistic regression is *exactly* weighted multinomial MLlib
    LR on rows exploded by class: row i becomes K rows (x_i, k) with weight
    w_i * P_ik.  The reference objective  sum_i w_i CE(P_i, softmax) +
    ||W||^2 / (2C)  divided by sum_i w_i is MLlib's objective with
    regParam = 1 / (C * sum w), elasticNet 0, no standardisation.
M9  Standard (hard-label) L2 LR, M10, M17: Newton's method on summed normal
    equations (``cells``).
M7  Generalised cross-entropy has no MLlib counterpart: ``cells`` with L-BFGS.
M3, M8, M9 with CV: all (C, fold) cells of the grid, and the refits on all rows,
    are fitted together by ``cells``; all are scored in one pass.

Every fit is a distributed Spark job; the driver only ever holds model-sized
vectors (d * K numbers), never data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import calibration as C
from . import metrics as M
from .cells import Blocks, Cell, LinearSoftmax, evaluate_cells, fit_cells, scored_cells
from .sampling import kfold

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector_length(df: DataFrame, col: str) -> int:
    """The one length of ``col``'s arrays; mixed lengths and empty tables raise."""
    r = df.agg(F.min(F.size(col)).alias("a"), F.max(F.size(col)).alias("b")).first()
    if r["a"] is None or r["a"] != r["b"] or r["a"] < 1:
        raise ValueError(f"{col}: vectors of one length are needed, found {r['a']} to {r['b']}")
    return int(r["a"])


def _check_params(C_: float, k: int | None = None):
    if not (C_ > 0 and np.isfinite(C_)):
        raise ValueError("C must be a positive finite number")
    if k is not None and k < 2:
        raise ValueError("need at least 2 classes")


# ------------------------------------------------------------------ M1, M2
@dataclass
class SoftLRModel:
    """Fitted soft-label LR (M2): ``predict_proba`` / ``predict``."""
    model: LogisticRegressionModel
    features: str
    constant_feature: bool = False

    def _vec(self, df: DataFrame) -> Column:
        f = _c(self.features)
        if self.constant_feature:
            f = F.concat(f, F.array(F.lit(1.0)))
        return array_to_vector(f)

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        scored = self.model.transform(df.withColumn("_features", self._vec(df)))
        return scored.withColumn(out, vector_to_array("probability")).drop(
            "_features", "rawPrediction", "probability", "prediction")

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """Log odds of class 1 (binary models): the raw prediction, not clipped."""
        scored = self.model.transform(df.withColumn("_features", self._vec(df)))
        raw = vector_to_array("rawPrediction")
        odds = raw[1] if self.model.coefficientMatrix.numRows == 1 else raw[1] - raw[0]
        return scored.withColumn(out, odds).drop("_features", "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return self.predict_proba(df, "_p").withColumn(out, L.argmax("_p")).drop("_p")

    @property
    def coefficients(self) -> np.ndarray:
        return self.model.coefficientMatrix.toArray()

    @property
    def intercepts(self) -> np.ndarray:
        return self.model.interceptVector.toArray()


def explode_soft(df: DataFrame, features: str, probs: str, weight: str | None = None,
                 constant_feature: bool = False) -> DataFrame:
    """(features vector, label k, weight w * P_k) for every row and class."""
    f = _c(features).cast("array<double>")
    if constant_feature:
        f = F.concat(f, F.array(F.lit(1.0)))
    w = _c(weight).cast("double") if weight else F.lit(1.0)
    return df.select(array_to_vector(f).alias("_features"), w.alias("_w"),
                     F.posexplode(_c(probs)).alias("_k", "_p")) \
        .select("_features", F.col("_k").cast("double").alias("_label"),
                (F.col("_w") * F.col("_p")).alias("_weight"))


def fit_soft_lr(df: DataFrame, features: str = "embedding", probs: str = "label", C: float = 1.0,
                weight: str | None = None, fit_intercept: bool = True,
                penalize_intercept: bool = False, max_iter: int = 200, tol: float = 1e-6) -> SoftLRModel:
    """M1: minimise sum_i w_i CE(P_i, softmax(W x_i + b)) + ||W||^2 / (2C).

    The intercept is unpenalised by default; ``penalize_intercept`` adds a
    constant feature instead of a free intercept.  Weights must be >= 0."""
    _check_params(C)
    w = _c(weight).cast("double") if weight else F.lit(1.0)
    total_w = df.agg(F.sum(w).alias("w"), F.min(w).alias("mn"), F.count(F.lit(1)).alias("n")).first()
    if total_w["w"] is None or total_w["w"] <= 0:
        raise ValueError("sum of weights must be positive")
    if total_w["mn"] < 0:
        raise ValueError("weights must be >= 0")
    ex = explode_soft(df, features, probs, weight, constant_feature=penalize_intercept)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight",
                            family="multinomial", regParam=1.0 / (C * total_w["w"]),
                            elasticNetParam=0.0, standardization=False,
                            fitIntercept=fit_intercept and not penalize_intercept,
                            maxIter=max_iter, tol=tol)
    return SoftLRModel(lr.fit(ex), features, penalize_intercept)


def _classes(df: DataFrame, label: str) -> int:
    top = df.agg(F.max(label)).first()[0]
    if top is None:
        raise ValueError("no rows to fit on")
    return max(2, int(top) + 1)


def fit_standard_lr(df: DataFrame, features: str, label: str, C: float | None = 1.0,
                    binary: bool | None = None, max_iter: int = 200, tol: float | None = None,
                    weight: str | None = None) -> LinearSoftmax:
    """Hard-label L2 LR (``C=None`` -> unregularised).  Binary data uses
    one coefficient vector, as the reference's solver does, and Newton's method.
    A row counts ``weight`` times (bootstrap draws).  Without a penalty, rows
    that a plane separates have no optimum: see ``cells``."""
    if C is not None:
        _check_params(C)
    k = 2 if binary else _classes(df, label)
    w = F.array(_c(weight).cast("double") if weight else F.lit(1.0))
    blocks = Blocks(df, features, _target(F.col(label), k), w)
    try:
        return fit_cells(blocks, [Cell(C=C)], "odds" if k == 2 else "softmax", max_iter=max_iter, tol=tol, features=features)[0]
    finally:
        blocks.close()


def _target(label: Column, k: int) -> Column:
    """Hard labels as targets: of class 1, or one-hot."""
    return F.array(label.cast("double")) if k == 2 else L.one_hot(label, k)


def fit_linear_probe(df: DataFrame, features: str, probs: str | None = None, label: str | None = None,
                     target: str = "soft", weight_decay: float = 0.0) -> SoftLRModel:
    """Linear log-softmax head.  KL to soft targets differs from CE by a
    constant, so its optimum is M1; hard targets give M10.  ``weight_decay``
    maps to C = 1 / weight_decay (none -> effectively unregularised)."""
    C_ = 1.0 / weight_decay if weight_decay > 0 else 1e12
    if target == "soft":
        return fit_soft_lr(df, features, probs, C=C_)
    return fit_standard_lr(df, features, label, C=None if weight_decay == 0 else C_)


# ---------------------------------------------------------------- M4 score
SCORERS = ("neg_log_loss", "accuracy", "roc_auc", "roc_auc_ovr", "roc_auc_ovo",
           "f1_macro", "f1_weighted", "f1_micro", "precision_macro", "precision_weighted",
           "precision_micro", "recall_macro", "recall_weighted", "recall_micro")


def score(scored: DataFrame, y: str, proba: str, metric: str, k: int) -> DataFrame:
    """M4: one-row score of a scored DataFrame (y = hard truth index)."""
    s = scored.withColumn("_yhat", L.argmax(proba))
    if metric == "neg_log_loss":
        return s.agg((-C.nll_multiclass(y, proba)).alias("score"))
    if metric == "accuracy":
        return s.agg(M.accuracy(y, "_yhat").alias("score"))
    if metric in ("roc_auc", "roc_auc_ovr"):
        if k == 2:
            return M.auc_ap_table(s.withColumn("_p1", F.col(proba)[1]), y, "_p1").select(F.col("roc_auc").alias("score"))
        return M.ovr_average(M.ovr_auc_ap(s, y, proba), "roc_auc").select(F.col("roc_auc").alias("score"))
    if metric == "roc_auc_ovo":
        return M.roc_auc_ovo(s, y, proba, k).select(F.col("roc_auc_ovo").alias("score"))
    for base in ("f1", "precision", "recall"):
        for avg in ("macro", "weighted", "micro"):
            if metric == f"{base}_{avg}":
                return M.prf(s, y, "_yhat", avg).select(F.col(base).alias("score"))
    raise ValueError(f"unknown scoring {metric!r}")


# ----------------------------------------------------------- M3, M8 (CV)
def logspace_cs(cs: int | Sequence[float]) -> list[float]:
    """Cs as an int -> logspace(-4, 4, Cs), as the reference."""
    if isinstance(cs, int):
        return [float(x) for x in np.logspace(-4, 4, cs)]
    return [float(x) for x in cs]


def best_c(scores: dict[float, float], cs: Sequence[float]) -> float:
    """Max mean score, first C wins ties; non-finite scores ignored;
    none valid -> first C."""
    best, best_s = cs[0], -np.inf
    for c in cs:
        s = scores.get(c)
        if s is not None and np.isfinite(s) and s > best_s:
            best, best_s = c, s
    return best


def score_cells(scored: DataFrame, metric: str, k: int) -> DataFrame:
    """M4 for many cells at once: (cell, score) of scored rows (cell, y, proba)."""
    s = scored.withColumn("_yhat", L.argmax("proba"))
    if metric == "neg_log_loss":
        return s.groupBy("cell").agg((-C.nll_multiclass("y", "proba")).alias("score"))
    if metric == "accuracy":
        return s.groupBy("cell").agg(M.accuracy("y", "_yhat").alias("score"))
    if metric in ("roc_auc", "roc_auc_ovr", "roc_auc_ovo"):
        if k == 2 and metric != "roc_auc_ovo":
            per = M.auc_ap_table(s.withColumn("_p1", F.col("proba")[1]), "y", "_p1", group_cols=["cell"])
            return per.select("cell", F.col("roc_auc").alias("score"))
        if metric == "roc_auc_ovo":
            return M.roc_auc_ovo(s, "y", "proba", k, group_cols=["cell"]).withColumnRenamed("roc_auc_ovo", "score")
        return M.ovr_auc_ap(s, "y", "proba", group_cols=["cell"]).groupBy("cell").agg(F.avg("roc_auc").alias("score"))
    base, _, average = metric.partition("_")
    if metric not in SCORERS:
        raise ValueError(f"unknown scoring {metric!r}")
    return M.prf(s, "y", "_yhat", average, group_cols=["cell"]).select("cell", F.col(base).alias("score"))


@dataclass
class CrossValidated:
    """Scores of every (trial, C, fold), and for every trial the model of its best C."""
    scores: DataFrame
    best: list[float]
    models: list[LinearSoftmax]


def cross_validate(df: DataFrame, features: str, target: Column, truth: Column, weights: Column, folds: Column, n_folds: int,
                   cs: Sequence[float], scoring: str, k: int, trials: int = 1, loss: str = "odds", soft: bool = False,
                   q: float = 0.7, start: np.ndarray | None = None, max_iter: int = 200) -> CrossValidated:
    """Every (trial, fold, C) and, for the refits, every (trial, C) in one fit;
    one job scores all folds.  ``weights`` and ``folds`` are arrays by trial (weight
    0: the row isn't in the trial)."""
    spark = df.sparkSession
    blocks = Blocks(df, features, target, weights, folds, truth)
    try:
        held = [Cell(t, f, c) for t in range(trials) for f in range(n_folds) for c in cs]
        whole = [Cell(t, None, c) for t in range(trials) for c in cs]
        models = fit_cells(blocks, held + whole, loss, q, soft, start, max_iter, features=features)
        got = score_cells(scored_cells(blocks, held, models[:len(held)]), scoring, k).collect()    # a row for each cell
    finally:
        blocks.close()
    value = {r["cell"]: float("nan") if r["score"] is None else float(r["score"]) for r in got}
    rows = [(c.trial, float(c.C), c.fold, value.get(i, float("nan"))) for i, c in enumerate(held)]
    best, chosen = [], []
    for t in range(trials):
        mean = {c: [s for u, d, _, s in rows if u == t and d == float(c) and not np.isnan(s)] for c in cs}
        best.append(best_c({c: float(np.mean(v)) if v else None for c, v in mean.items()}, cs))
        chosen.append(models[len(held) + t * len(cs) + list(cs).index(best[-1])])
    return CrossValidated(spark.createDataFrame(rows, "trial int, C double, fold int, score double"), best, chosen)


def _cv(df, features, target, truth, cs, folds, scoring, seed, k, id_col, weight, **how):
    """(model, mean scores of each C, best C) over ``folds`` hash folds of the rows."""
    w = F.array(_c(weight).cast("double") if weight else F.lit(1.0))
    done = cross_validate(kfold(df, folds, seed, id_col), features, target, truth, w, F.array("fold"), folds, cs, scoring, k, **how)
    return done.models[0], cv_means(done.scores.drop("trial")), done.best[0]


def cv_means(grid: DataFrame) -> DataFrame:
    """Mean and population std of each C's fold scores; NaN folds are left out."""
    s = F.when(~F.isnan("score"), F.col("score"))
    return grid.groupBy("C").agg(F.avg(s).alias("mean_score"), F.stddev_pop(s).alias("std_score"))


def fit_soft_lr_cv(df: DataFrame, features: str = "embedding", probs: str = "label",
                   cs: int | Sequence[float] = 10, folds: int = 5, scoring: str = "neg_log_loss",
                   seed: int = 0, k: int | None = None, id_col: str = "id",
                   borderline: tuple[float, float] | None = None, weight: str | None = None):
    """M3: CV over Cs, pick the best mean score (first C on ties), refit on
    all rows.  ``borderline=(exponent, min_weight)`` weights binary rows by
    P27.  Fold scores use the argmax of the *soft* labels as truth (as the
    reference).  Returns (model, per-C mean scores DataFrame, best C)."""
    k = k or vector_length(df, probs)
    if borderline is not None:
        if k != 2:
            raise ValueError("borderline weights need binary labels")
        own = F.col(weight).cast("double") if weight else F.lit(1.0)
        df = df.withColumn("_bw", own * L.borderline_weight(F.col(probs)[1], *borderline))
        weight = "_bw"
    target, loss = _soft_target(probs, k)
    return _cv(df, features, target, L.argmax(probs), logspace_cs(cs), folds, scoring, seed, k, id_col, weight, loss=loss, soft=True)


def _soft_target(probs: str, k: int) -> tuple[Column, str]:
    """Targets and loss of soft labels.  Two classes whose labels sum to one have one vector."""
    return (F.array(F.col(probs)[1]), "odds") if k == 2 else (F.col(probs), "softmax")


def fit_standard_lr_cv(df: DataFrame, features: str, label: str, cs: int | Sequence[float] = 10,
                       folds: int = 5, scoring: str = "neg_log_loss", seed: int = 0,
                       id_col: str = "id", k: int | None = None, weight: str | None = None):
    """M9 with CV (hard labels); ``weight`` as in ``fit_standard_lr``."""
    k = k or _classes(df, label)
    return _cv(df, features, _target(F.col(label), k), F.col(label), logspace_cs(cs), folds, scoring, seed, k, id_col, weight,
               loss="odds" if k == 2 else "softmax")


# --------------------------------------------------------------- M5 / M6
def gce_loss(probs: ColumnOrName, q_probs: ColumnOrName, q: float, eps: float = 1e-12) -> Column:
    """M5: per-row sum_k P_k (1 - Q_k^q) / q with Q clipped, 0 < q <= 1."""
    if not 0 < q <= 1:
        raise ValueError("q must be in (0, 1]")
    return F.aggregate(F.zip_with(_c(probs), _c(q_probs), lambda p, qq: p * (F.lit(1.0) - F.pow(
        F.least(F.greatest(qq, F.lit(eps)), F.lit(1.0)), F.lit(q))) / F.lit(q)),
        F.lit(0.0).cast("double"), lambda a, b: a + b)


def gce_grad_logits(P: np.ndarray, Q: np.ndarray, q: float) -> np.ndarray:
    """M6: dL/dz = Q * sum_k P_k Q_k^q - P * Q^q (row-wise, numpy block)."""
    Qq = np.power(np.clip(Q, 1e-12, 1.0), q)
    s = (P * Qq).sum(axis=1, keepdims=True)
    return Q * s - P * Qq


# ---------------------------------------------------------------------- M7
def _gce_start(d: int, k: int, seed: int) -> np.ndarray:
    """(d + 1) x k: weights N(0, .01) from the seed, intercepts 0."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0.0, 0.01, size=(d, k)), np.zeros((1, k))])


def fit_gce_lr(df: DataFrame, features: str = "embedding", probs: str = "label", C: float = 1.0,
               q: float = 0.7, weight: str | None = None, seed: int = 0, max_iter: int = 500,
               tol: float = 1e-8) -> LinearSoftmax:
    """M7: sum_i w_i GCE_q(P_i, softmax(W x_i + b)) + ||W||^2 / (2C); the
    intercept is unpenalised.  Non-convex: the start point N(0, .01) comes
    from the seed; test by gradient norm, not by coefficients."""
    _check_params(C)
    if not 0 < q <= 1:
        raise ValueError("q must be in (0, 1]")
    blocks = Blocks(df, features, F.col(probs), F.array(_c(weight).cast("double") if weight else F.lit(1.0)))
    try:
        return fit_cells(blocks, [Cell(C=C)], "gce", q, start=_gce_start(blocks.d, blocks.k, seed), max_iter=max_iter, tol=tol,
                         features=features)[0]
    finally:
        blocks.close()


def gce_gradient_norm(df: DataFrame, model: LinearSoftmax, probs: str, C: float, q: float,
                      weight: str | None = None) -> float:
    """Optimality check for M7: norm of the full objective's gradient."""
    blocks = Blocks(df, model.features, F.col(probs), F.array(_c(weight).cast("double") if weight else F.lit(1.0)))
    try:
        theta = np.concatenate([model.W, model.b[None]])
        _f, g, _h = evaluate_cells(blocks, [Cell(C=C)], {0: theta.ravel()}, "gce", q, False)[0]
    finally:
        blocks.close()
    return float(np.linalg.norm(g + np.concatenate([model.W / C, np.zeros((1, len(model.b)))]).ravel()))


# --------------------------------------------------------------- M16, M17
def gold_judge(gold: DataFrame, synthetic: DataFrame, features: str, label: str,
               cs: int | Sequence[float] = 10, folds: int = 5, seed: int = 0):
    """Fit a standard LR on gold, then score the synthetic rows: p(class 1)
    for binary, the vector else.  Returns (scored, CV accuracy table with the
    mean and population std of each C, best C)."""
    model, means, c_best = fit_standard_lr_cv(gold, features, label, cs, folds, "accuracy", seed)
    scored = model.predict_proba(synthetic, "judge_proba")
    own = F.col("judge_proba")
    return scored.withColumn("judge_score", own[1] if len(model.b) == 2 else own), means, c_best


def platt_calibrate(scored: DataFrame, margin: str, y: str, C: float | None = None) -> LinearSoftmax:
    """Sigmoid calibration of a frozen model's margin with Platt's
    targets t+ = (N+ + 1)/(N+ + 2), t- = 1/(N- + 2): two parameters, by Newton's
    method, not penalised unless ``C`` is given (the targets lie inside (0, 1),
    so there is always an optimum)."""
    cnt = scored.agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    npos, nneg = cnt["pos"] or 0.0, cnt["n"] - (cnt["pos"] or 0.0)
    tp, tn = (npos + 1.0) / (npos + 2.0), 1.0 / (nneg + 2.0)
    t = F.when(F.col(y) == 1, F.lit(tp)).otherwise(F.lit(tn))
    d = scored.select(F.array(F.col(margin).cast("double")).alias("_m"), t.alias("_t"))
    blocks = Blocks(d, "_m", F.array("_t"), F.array(F.lit(1.0)))
    try:
        return fit_cells(blocks, [Cell(C=C)], features="_m")[0]
    finally:
        blocks.close()


def fit_gce_lr_cv(df: DataFrame, features: str = "embedding", probs: str = "label",
                  cs: int | Sequence[float] = 10, folds: int = 5, scoring: str = "neg_log_loss",
                  q: float = 0.9, seed: int = 0, id_col: str = "id", max_iter: int = 500,
                  weight: str | None = None):
    """M8: as M3 over M7.  Scored like M3 (argmax of the soft fold labels);
    the reference's log-loss on soft targets is not reproduced."""
    k, d = vector_length(df, probs), vector_length(df, features)
    return _cv(df, features, F.col(probs), L.argmax(probs), logspace_cs(cs), folds, scoring, seed, k, id_col, weight, loss="gce", q=q,
               start=_gce_start(d, k, seed), max_iter=max_iter)


class SoftLogisticRegression:
    """Estimator-style wrapper: ``fit(df) -> model`` with
    ``predict_proba`` / ``predict``; ``q_gce`` switches to M7, ``cv`` to the
    cross-validated variants (M3 / M8)."""

    def __init__(self, C: float = 1.0, q_gce: float | None = None, cv: int | None = None,
                 Cs: int | Sequence[float] = 10, scoring: str = "neg_log_loss",
                 features: str = "embedding", probs: str = "label", weight: str | None = None,
                 seed: int = 0, id_col: str = "id", fit_intercept: bool = True,
                 penalize_intercept: bool = False, borderline: tuple[float, float] | None = None):
        self.fit_intercept, self.penalize_intercept, self.borderline = fit_intercept, penalize_intercept, borderline
        if q_gce is not None and (penalize_intercept or not fit_intercept or borderline):
            raise ValueError("the GCE variant has a free intercept and no borderline weights")
        if cv and (penalize_intercept or not fit_intercept):
            raise ValueError("cross-validation fits a free intercept")
        self.C, self.q_gce, self.cv, self.Cs, self.scoring = C, q_gce, cv, Cs, scoring
        self.features, self.probs, self.weight, self.seed, self.id_col = features, probs, weight, seed, id_col
        self.cv_scores_ = None
        self.C_ = C

    def fit(self, df: DataFrame):
        if self.cv:
            if self.q_gce is not None:
                m, self.cv_scores_, self.C_ = fit_gce_lr_cv(df, self.features, self.probs, self.Cs, self.cv,
                                                            self.scoring, self.q_gce, self.seed, self.id_col)
            else:
                m, self.cv_scores_, self.C_ = fit_soft_lr_cv(df, self.features, self.probs, self.Cs, self.cv,
                                                             self.scoring, self.seed, id_col=self.id_col,
                                                             borderline=self.borderline, weight=self.weight)
            return m
        if self.q_gce is not None:
            return fit_gce_lr(df, self.features, self.probs, C=self.C, q=self.q_gce, weight=self.weight,
                              seed=self.seed)
        weight = self.weight
        if self.borderline:
            own = F.col(weight).cast("double") if weight else F.lit(1.0)
            df, weight = df.withColumn("_bw", own * L.borderline_weight(F.col(self.probs)[1], *self.borderline)), "_bw"
        return fit_soft_lr(df, self.features, self.probs, C=self.C, weight=weight, fit_intercept=self.fit_intercept,
                           penalize_intercept=self.penalize_intercept)
