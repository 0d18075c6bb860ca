"""Models of a refinement are scored on the test rows together."""

import numpy as np

from softlab.operators import metrics as M
from softlab.operators import refine as R
from softlab.operators.cells import LinearSoftmax


def test_models_are_scored_together(spark, monkeypatch):
    test = spark.createDataFrame([([1.0], 1), ([-1.0], 0), ([2.0], 0), ([-2.0], 1)], "x array<double>, y int")
    models = [LinearSoftmax(np.array([[-a, a]]), np.zeros(2), "x") for a in (0.5, -0.5, 0.0)]
    alone = [R.test_metrics(m, test, "y") for m in models]
    calls = []
    whole = M.evaluate_binary
    monkeypatch.setattr(M, "evaluate_binary", lambda *a, **k: calls.append(1) or whole(*a, **k))
    together = R.tests_metrics(models, test, "y")
    assert len(calls) == 1
    for a, b in zip(alone, together, strict=True):
        assert all(abs(a[m] - b[m]) < 1e-12 for m in R.TEST_METRICS)
    assert alone[0]["accuracy"] == 0.5 and alone[0]["roc_auc"] == 0.25 and abs(alone[2]["brier"] - 0.25) < 1e-12


def test_no_test_rows(spark):
    test = spark.createDataFrame([], "x array<double>, y int")
    got = R.tests_metrics([LinearSoftmax(np.array([[-1.0, 1.0]]), np.zeros(2), "x")], test, "y")
    assert all(np.isnan(v) for v in got[0].values())
