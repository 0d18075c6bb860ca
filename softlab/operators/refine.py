"""Label refinement loops.

Each step trains a cross-validated classifier on the confident rows
(inclusive margin, hard label p > .5), predicts the ambiguous rows (strictly
inside the margin) and blends  p <- alpha * p + (1 - alpha) * model_p
(clipped to [0, 1]).  Only (id, p) is written after a step, to the shared
folder: embeddings are read from the input and joined by id, the plan doesn't
grow, and a lost executor recomputes one step at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from . import calibration as C_
from . import metrics as M
from . import models as MD
from .agreement import label_change
from .cells import scored_rows

TEST_METRICS = ("accuracy", "log_loss", "roc_auc", "brier")


def relabel_with_oracle(gold: DataFrame, synthetic: DataFrame, features: str, gold_label: str,
                        cs: int | Sequence[float] = 10, folds: int = 5, seed: int = 0, out: str = "oracle_label"):
    """Fit a cross-validated LR on gold, replace the synthetic labels by its
    hard predictions, refit on them.  Returns (relabelled rows, refitted model)."""
    oracle, _, _ = MD.fit_standard_lr_cv(gold, features, gold_label, cs, folds, seed=seed)
    labelled = oracle.predict(synthetic, out)
    model, _, _ = MD.fit_standard_lr_cv(labelled, features, out, cs, folds, seed=seed, k=2)
    return labelled, model


def test_metrics(model, test: DataFrame, y: str) -> dict[str, float]:
    """Accuracy, log loss, ROC AUC and Brier score of a binary model on ``test``."""
    return tests_metrics([model], test, y)[0]


test_metrics.__test__ = False


def tests_metrics(models: Sequence, test: DataFrame, y: str) -> list[dict[str, float]]:
    """``test_metrics`` of several models of the same features, from one pass over ``test``."""
    scored = scored_rows(test, models[0].features, F.col(y), models).withColumn("_p1", F.col("proba")[1])
    binary = M.evaluate_binary(scored, "y", "_p1", group_cols=["cell"]).select("cell", "accuracy", "roc_auc")
    rest = scored.groupBy("cell").agg(C_.nll_multiclass("y", "proba").alias("log_loss"),
                                      F.avg((F.col("_p1") - F.col("y")) * (F.col("_p1") - F.col("y"))).alias("brier"))
    got = {r["cell"]: r for r in binary.join(rest, "cell").collect()}     # a row for each model
    return [{m: float("nan") if i not in got or got[i][m] is None else float(got[i][m]) for m in TEST_METRICS} for i in range(len(models))]


tests_metrics.__test__ = False


def _step(df: DataFrame, labels: DataFrame, features: str, p: str, m: float, alpha: float, cs, folds: int, seed: int):
    """(new labels, model), or (labels, None) where a class has fewer rows than folds."""
    rows = df.drop(p).join(labels, "id")
    conf = rows.filter((F.col(p) <= 0.5 - m) | (F.col(p) >= 0.5 + m)).withColumn("_hard", (F.col(p) > 0.5).cast("int"))
    counts = {r["_hard"]: r["n"] for r in conf.groupBy("_hard").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < folds:
        return labels, None
    model, _, _ = MD.fit_standard_lr_cv(conf, features, "_hard", cs, folds, seed=seed, k=2)
    amb = (F.col(p) > 0.5 - m) & (F.col(p) < 0.5 + m)
    scored = model.predict_proba(rows, "_mp").select("id", F.when(amb, blend(F.col(p), F.col("_mp")[1], alpha))
                                                     .otherwise(F.col(p)).alias(p))
    return shared_table(scored, "refined-labels"), model


def blend(old, new, alpha: float):
    """alpha * old + (1 - alpha) * new, within [0, 1]."""
    return F.least(F.greatest(F.lit(float(alpha)) * old + F.lit(1.0 - alpha) * new, F.lit(0.0)), F.lit(1.0))


def _change(old: DataFrame, new: DataFrame, p: str, m: float):
    pairs = old.select("id", F.col(p).alias("_b")).join(new.select("id", F.col(p).alias("_a")), "id")
    return label_change(pairs, "_b", "_a", m).first()


def _history(spark, rows: list, with_test: bool) -> DataFrame:
    extra = "".join(f", test_{m} double" for m in TEST_METRICS) if with_test else ""
    return spark.createDataFrame(rows, "step int, inner int, margin double, mean_change double, "
                                       f"mean_change_ambiguous double, status string{extra}")


def refine_labels(df: DataFrame, m_schedule: Sequence[float], alpha: float = 0.9, features: str = "embedding",
                  p: str = "p", cs: int | Sequence[float] = 10, folds: int = 5, seed: int = 0,
                  test: DataFrame | None = None, y: str = "y") -> tuple[DataFrame, DataFrame]:
    """One step per margin; returns (refined rows, history)."""
    return refine_labels_converge(df, m_schedule, alpha, 1, 0.0, features, p, cs, folds, seed, test=test, y=y)


def refine_labels_converge(df: DataFrame, m_schedule: Sequence[float], alpha: float = 0.9, max_inner: int = 10,
                           tol: float = 1e-3, features: str = "embedding", p: str = "p",
                           cs: int | Sequence[float] = 10, folds: int = 5, seed: int = 0,
                           ambiguous_tol: float | None = None, test: DataFrame | None = None,
                           y: str = "y") -> tuple[DataFrame, DataFrame]:
    """M20 (and M21 with ``ambiguous_tol``): per margin, repeat the step until the
    mean change < tol (or the ambiguous-region change < ambiguous_tol, or
    nothing is ambiguous), ``max_inner`` times at most (status ``stopped``).
    With ``test``, every step's model is scored on it (label ``y``), all after the
    last step and together."""
    labels = shared_table(df.select("id", p), "refined-labels")
    hist, models = [], {}
    none = (float("nan"),) * len(TEST_METRICS) if test is not None else ()
    for i, m in enumerate(m_schedule):
        for j in range(max_inner):
            if labels.filter((F.col(p) > 0.5 - m) & (F.col(p) < 0.5 + m)).isEmpty():
                hist.append((i, j, float(m), 0.0, 0.0, "nothing_ambiguous", *none))
                break
            new, model = _step(df, labels, features, p, m, alpha, cs, folds, seed)
            if model is None:
                hist.append((i, j, float(m), 0.0, 0.0, "skipped", *none))
                break
            ch = _change(labels, new, p, m)
            mc, ma = float(ch["mean_change"] or 0.0), float(ch["mean_change_ambiguous"] or 0.0)
            labels = new
            status = ("converged" if mc < tol else "ambiguous_converged" if ambiguous_tol is not None and ma < ambiguous_tol
                      else "stopped" if j == max_inner - 1 else "continue")
            hist.append((i, j, float(m), mc, ma, status, *none))
            models[len(hist) - 1] = model
            if status != "continue":
                break
    if test is not None and models:
        of = dict(zip(models, tests_metrics(list(models.values()), test, y), strict=True))
        hist = [(*h[:6], *of[i].values()) if i in of else h for i, h in enumerate(hist)]
    return df.drop(p).join(labels, "id"), _history(df.sparkSession, hist, test is not None)
