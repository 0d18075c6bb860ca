"""Fits of many cells: against scipy-free plain Newton on numpy, and against each other."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from softlab.operators import models as MD
from softlab.operators.cells import Blocks, Cell, fit_cells


def rows(n=400, d=4, k=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1.0, 2.0, 0.3, 5.0][:d]
    z = x @ rng.normal(size=(d, k)) + rng.normal(size=(n, k))
    t = np.exp(z - z.max(1, keepdims=True))
    return x, t / t.sum(1, keepdims=True), z.argmax(1), rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n)


def table(spark, x, t, y, w, fold):
    data = [(i, x[i].tolist(), t[i].tolist(), int(y[i]), float(w[i]), int(fold[i])) for i in range(len(x))]
    return spark.createDataFrame(data, "id long, x array<double>, t array<double>, y int, w double, fold int").repartition(3)


def plain_gradient(x, t, w, model, C):
    """Gradient of sum w CE + |W|^2 / 2C at the model."""
    z = x @ model.W + model.b
    q = np.exp(z - z.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    g = (q - t) * w[:, None]
    return np.concatenate([(x.T @ g + (0 if C is None else model.W / C)).ravel(), g.sum(0)])


def test_softmax_cells_are_optimal(spark):
    x, t, y, w, fold = rows()
    b = Blocks(table(spark, x, t, y, w, fold), "x", F.col("t"), F.array("w", F.lit(1.0)), F.array("fold", "fold"), F.col("y"))
    cells = [Cell(0, None, 0.01), Cell(0, 1, 1.0), Cell(1, 2, 100.0), Cell(1, None, None)]
    for c, m in zip(cells, fit_cells(b, cells, "softmax"), strict=True):
        own = (w if c.trial == 0 else np.ones(len(w))) * (fold != (-1 if c.fold is None else c.fold))
        g0 = np.linalg.norm(plain_gradient(x, t, own, type(m)(m.W * 0, m.b * 0, "x"), c.C))
        assert m.converged and np.linalg.norm(plain_gradient(x, t, own, m, c.C)) < 1e-4 * g0
    b.close()


@pytest.mark.parametrize("soft", [False, True])
def test_newton_cells_are_optimal(spark, soft):
    x, t, y, w, fold = rows(k=2)
    p = t[:, 1] if soft else (y == 1).astype(float)
    df = table(spark, x, np.stack([1 - p, p], 1), y, w, fold)
    b = Blocks(df, "x", F.array(F.col("t")[1]), F.array("w"), F.array("fold"), F.col("y"))
    cells = [Cell(0, f, c) for f in (None, 0, 2) for c in (1e-4, 1.0, 1e4)]
    for c, m in zip(cells, fit_cells(b, cells, "odds", soft=soft), strict=True):
        own = w * (fold != (-1 if c.fold is None else c.fold))
        beta, b0 = m.coefficients[0], m.intercepts[0]
        r = own * (1 / (1 + np.exp(-(x @ beta + b0))) - p)
        g = np.concatenate([x.T @ r + beta / (2 * c.C if soft else c.C), [r.sum()]])
        assert m.converged and m.iterations < 30 and np.abs(g).max() < 1e-7
    b.close()


def test_newton_and_gram_bound_agree(spark, monkeypatch):
    from softlab.operators import cells as CE
    x, t, y, w, fold = rows(k=2)
    b = Blocks(table(spark, x, t, y, w, fold), "x", F.array((F.col("y") == 1).cast("double")), F.array("w"))
    one = fit_cells(b, [Cell(C=1.0)])[0]
    monkeypatch.setattr(CE, "HESSIANS", 0)
    two = fit_cells(b, [Cell(C=1.0)])[0]
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-4) and one.iterations < two.iterations
    b.close()


def test_jobs_do_not_grow_with_the_grid(spark):
    x, t, y, w, fold = rows(200)
    df = table(spark, x, t, y, w, fold)
    tracker = spark.sparkContext.statusTracker()

    def jobs(cs):
        group = f"cells-{len(cs)}"
        spark.sparkContext.setJobGroup(group, group)
        MD.fit_standard_lr_cv(df.withColumn("h", (F.col("y") == 1).cast("int")), "x", "h", cs, 3, seed=1)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs([0.1, 0.2, 0.5, 1.0, 1.5, 2.0]) <= jobs([0.1, 1.0]) + 4


def test_rows_that_a_plane_separates(spark):
    x = np.array([[v, v * v] for v in np.linspace(-1, 1, 40) if abs(v) > 0.1])
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(x))], "id int, x array<double>, y int")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = MD.fit_standard_lr(df, "x", "y", C=None)
    assert m.predict(df).filter("pred <> y").count() == 0 and np.isfinite(m.W).all()


def test_parameter_and_row_checks(spark):
    x, t, y, w, fold = rows(30)
    df = table(spark, x, t, y, w, fold)
    for bad, columns in (("weights", {"w": F.lit(-1.0)}), ("one length", {"x": F.when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("x"))})):
        with pytest.raises(ValueError, match=bad):
            Blocks(df.withColumns(columns), "x", F.col("t"), F.array("w"))
    with pytest.raises(ValueError, match="no rows"):
        MD.fit_standard_lr(df.filter("false"), "x", "y")
    with pytest.raises(ValueError):
        MD.fit_standard_lr(df, "x", "y", C=0.0)


def test_every_scorer_of_the_grid(spark):
    x, t, y, w, fold = rows(240)
    df = table(spark, x, t, y, w, fold)
    k3 = {s: MD.fit_soft_lr_cv(df, "x", "t", [0.1, 10.0], 3, s, seed=2) for s in MD.SCORERS}
    for s, (m, means, best) in k3.items():
        got = means.collect()
        assert best in (0.1, 10.0) and len(got) == 2 and all(r["mean_score"] is not None for r in got), s
    # one cell's score is that of its rows alone
    from softlab.operators.sampling import kfold
    folded = kfold(df, 3, 2)
    for s in MD.SCORERS:
        want = []
        for f in range(3):
            m = MD.fit_soft_lr(folded.filter(F.col("fold") != f), "x", "t", C=10.0, tol=1e-10, max_iter=500)
            test = m.predict_proba(folded.filter(F.col("fold") == f).withColumn("_y", F.expr("array_position(t, array_max(t)) - 1").cast("int")), "_p")
            want.append(MD.score(test, "_y", "_p", s, 3).first()["score"])
        got = {r["C"]: r["mean_score"] for r in k3[s][1].collect()}[10.0]
        assert abs(got - np.mean(want)) < 5e-3, s
        if s == "neg_log_loss":
            assert abs(got - np.mean(want)) < 1e-4


def test_borderline_weights_and_vector_judge(spark):
    x, t, y, w, fold = rows(200, k=2)
    df = table(spark, x, t, y, w, fold)
    m, means, best = MD.fit_soft_lr_cv(df, "x", "t", [1.0], 3, seed=1, borderline=(2.0, 0.1))
    own = (np.abs(2 * t[:, 1] - 1)) ** 2
    from softlab.functions import labels as L
    own = np.array([r["v"] for r in df.orderBy("id").select(L.borderline_weight(F.col("t")[1], 2.0, 0.1).alias("v")).collect()])
    r = own * (1 / (1 + np.exp(-(x @ m.coefficients[0] + m.intercepts[0]))) - t[:, 1])
    assert np.abs(np.concatenate([x.T @ r + m.coefficients[0] / 2, [r.sum()]])).max() < 1e-6
    x, t, y, w, fold = rows(200)
    df = table(spark, x, t, y, w, fold)
    scored, _, _ = MD.gold_judge(df, df, "x", "y", cs=[1.0], folds=3)
    r = scored.select("judge_score").first()[0]
    assert len(r) == 3 and abs(sum(r) - 1) < 1e-9
