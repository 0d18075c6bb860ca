"""Influence of training rows on a validation loss.

Re-aimed to a linear softmax head on embeddings (the reference's network
version never uses its train gradient): for row i

    score_i = - g_i^T H^{-1} v

with g_i the cross-entropy gradient of row i, v the gradient of the reverse
cross-entropy on the validation set, and H the damped mean Hessian of the
training cross-entropy.  H is never materialised: conjugate gradients on
Hessian-vector products, each one Spark pass (per-partition numpy block
sums, added JVM-side).  The driver holds only (d+1) x K vectors.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from . import models as MD
from .cells import HESSIANS, LinearSoftmax, softmax
from .sampling import hash_key, hash_uniform

ColumnOrName = Column | str


def reverse_cross_entropy(q_probs: ColumnOrName, target: ColumnOrName, eps: float = 1e-7) -> Column:
    """-sum_k Q_k log(clip(target_k, eps, 1))."""
    qc = F.col(q_probs) if isinstance(q_probs, str) else q_probs
    tc = F.col(target) if isinstance(target, str) else target
    return -F.aggregate(F.zip_with(qc, tc, lambda q, t: q * F.log(F.least(F.greatest(t, F.lit(eps)), F.lit(1.0)))),
                        F.lit(0.0).cast("double"), lambda a, b: a + b)


def _block_sum(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sum a per-partition numpy vector of ``size`` over the DataFrame."""
    def part(it):
        acc = np.zeros(size)
        for pdf in it:
            if len(pdf):
                acc += fn(pdf)
        yield pd.DataFrame({"g": [acc.tolist()]})
    out = df.mapInPandas(part, "g array<double>").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()
    return np.array(out["g"], dtype=float)


def _block_inverse(rows: DataFrame, xq, n: int, d1: int, k: int, damping: float):
    """Product with the inverse of the damped Hessian's diagonal blocks (one a class;
    one Gram matrix of all classes' mean where blocks would be too large).  The
    right side and the Hessian's range have no sum over classes (a softmax doesn't
    see a common shift), so the product is taken and left without one."""
    one = k * d1 * d1 > HESSIANS

    def grams(pdf):
        Xt, Q = xq(pdf)
        curve = Q * (1 - Q)
        if one:
            curve = curve.mean(axis=1, keepdims=True)
        return np.stack([(Xt * curve[:, [c]]).T @ Xt for c in range(curve.shape[1])]).ravel()

    blocks = _block_sum(rows, grams, (1 if one else k) * d1 * d1).reshape(-1, d1, d1) / n
    inverse = np.linalg.inv(blocks + damping * np.eye(d1))
    inverse = np.broadcast_to(inverse, (k, d1, d1))

    def product(v: np.ndarray) -> np.ndarray:
        v = v.reshape(d1, k)
        z = np.einsum("kij,jk->ik", inverse, v - v.mean(axis=1, keepdims=True))
        return (z - z.mean(axis=1, keepdims=True)).ravel()
    return product


def influence_scores(train: DataFrame, val: DataFrame, features: str = "embedding", probs: str = "label",
                     C: float = 1.0, damping: float = 0.01, sample_frac: float = 1.0, seed: int = 0,
                     id_col: str = "id", cg_tol: float = 1e-10, cg_max_iter: int | None = None,
                     model: LinearSoftmax | None = None) -> DataFrame:
    """(id, influence) for every training row; rows outside the
    sample get -inf (as the reference).  ``model``: a fitted one instead of M1's.

    Conjugate gradients on the damped Hessian, preconditioned by its diagonal
    blocks: one pass sums a Gram matrix for each class, then each step is a pass."""
    if model is None:
        fitted = MD.fit_soft_lr(train, features, probs, C=C)
        W, b = fitted.coefficients.T, fitted.intercepts      # d x K, K
    else:
        W, b = model.W, model.b
    d, k = W.shape
    n = train.count()
    size = (d + 1) * k
    tr = train.select(id_col, F.col(features).cast("array<double>").alias("x"), F.col(probs).alias("p")) \
        .persist(StorageLevel.MEMORY_AND_DISK)

    def xq(pdf):
        X = np.stack(pdf["x"].to_numpy())
        Xt = np.hstack([X, np.ones((len(X), 1))])
        return Xt, softmax(X @ W + b)

    def val_grad(pdf):
        Xt, Q = xq(pdf)
        T = np.clip(np.stack(pdf["p"].to_numpy()), 1e-7, 1.0)
        lt = np.log(T)
        R = -Q * (lt - (Q * lt).sum(axis=1, keepdims=True))
        return (Xt.T @ R).ravel()

    vset = val.select(F.col(features).cast("array<double>").alias("x"), F.col(probs).alias("p"))
    v = _block_sum(vset, val_grad, size)

    def hvp(vec: np.ndarray) -> np.ndarray:
        V = vec.reshape(d + 1, k)

        def f(pdf):
            Xt, Q = xq(pdf)
            A = Xt @ V
            U = Q * A - Q * (Q * A).sum(axis=1, keepdims=True)
            return (Xt.T @ U).ravel()
        return _block_sum(tr, f, size) / n + damping * vec

    scaled = _block_inverse(tr, xq, n, d + 1, k, damping)
    s = np.zeros(size)
    r = v.copy()
    z = scaled(r)
    step = z.copy()
    rz = r @ z
    limit = cg_max_iter or size
    for _ in range(limit):
        if np.linalg.norm(r) <= cg_tol * max(1.0, np.linalg.norm(v)):
            break
        Hp = hvp(step)
        a = rz / (step @ Hp)
        s += a * step
        r -= a * Hp
        z = scaled(r)
        rz_new = r @ z
        step = z + (rz_new / rz) * step
        rz = rz_new
    else:
        if np.linalg.norm(r) > cg_tol * max(1.0, np.linalg.norm(v)):
            warnings.warn(f"conjugate gradients stopped at {limit} steps, residual {np.linalg.norm(r):.3g}", stacklevel=2)
    tr.unpersist()
    S = s.reshape(d + 1, k)

    # per-row score: -(x~^T S) . (Q_i - P_i); one numpy block per Arrow batch
    @F.pandas_udf("double")
    def score(x: pd.Series, p: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype="float64")
        Xt, Q = xq(pd.DataFrame({"x": x}))
        P = np.stack(p.to_numpy())
        return pd.Series(-((Xt @ S) * (Q - P)).sum(axis=1))

    keep = hash_uniform(hash_key(seed, id_col, F.lit("infl"))) < F.lit(sample_frac)
    infl = score(F.col(features).cast("array<double>"), F.col(probs))
    return train.select(id_col, F.when(keep, infl).otherwise(F.lit(float("-inf"))).alias("influence"))


def top_influential(scores: DataFrame, k: int, col: str = "influence") -> DataFrame:
    """The k highest scores (nulls last); a top-k, not a sort."""
    return scores.orderBy(F.col(col).desc_nulls_last()).limit(k)
