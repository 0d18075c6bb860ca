"""Hand-computed boundary cases for the label algebra and filters."""

import math

import pytest
from pyspark.sql import functions as F

from softlab.functions import labels as L
from softlab.operators import filters as Fi
from softlab.operators.binning import bin_right_closed, bin_left_closed, bin_cut, linspace_edges


def test_three_hard_label_rules_disagree_at_half(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (0.51,), (1.5,)], "p double")
    r = df.select(L.binarize_strict("p").alias("gt"), L.round_half_even("p").alias("he"),
                  L.predict_at("p").alias("ge")).collect()
    assert (r[0].gt, r[0].he, r[0].ge) == (0, 0, 1)
    assert (r[1].gt, r[1].he, r[1].ge) == (0, 0, 0)
    assert (r[2].gt, r[2].he, r[2].ge) == (1, 1, 1)
    assert r[3].he == 2          # half-even, not half-up


def test_ece_bins_edges(spark):
    ps = [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.b for r in df.select(bin_right_closed("p", linspace_edges(10)).alias("b")).collect()]
    assert got == [-1, 0, 1, 2, 4, 6, 9]
    lc = [r.b for r in df.select(bin_left_closed("p", linspace_edges(10)).alias("b")).collect()]
    assert lc == [0, 1, 2, 2, 5, 6, 9]   # 0.3 < 0.30000000000000004, 0.7 < 0.7000000000000001
    cut = [r.b for r in df.select(bin_cut("p", linspace_edges(10)).alias("b")).collect()]
    assert cut[0] == 0 and cut[-1] == 9


def test_margins(spark):
    ps = [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    strict = sorted(r.p for r in df.filter(Fi.margin_strict("p", 0.2)).collect())
    incl = sorted(r.p for r in df.filter(Fi.margin_inclusive("p", 0.2)).collect())
    assert strict == [0.0, 0.1, 0.2, 1.0]
    assert incl == [0.0, 0.1, 0.2, 0.3, 0.7, 1.0]
    assert df.filter(Fi.margin_strict("p", 0.0)).count() == 6     # m=0 drops p=.5
    assert df.filter(Fi.margin_inclusive("p", 0.0)).count() == 7  # m=0 keeps all


@pytest.mark.parametrize("vec,status", [
    ([0.2, 0.3, 0.5], "valid"),
    ([0.5, 0.5 + 0.001, 0.0], "renormalised"),
    ([0.0, 0.0, 0.0], "zero_sum"),
    ([1.0 - 1e-6 + 1e-6, -1e-6, 0.0], "clipped"),
    ([0.6, -0.1, 0.5], "out_of_range"),
    ([0.5, 0.5], "bad_length"),
    ([0.2 * 1.000015, 0.3 * 1.000015, 0.5 * 1.000015], "renormalised"),   # reference would raise
])
def test_validate_soft_label(spark, vec, status):
    df = spark.createDataFrame([(vec,)], "v array<double>")
    r = df.select(L.validate_soft_label_status("v", k=3).alias("s"),
                  L.validate_soft_label("v").alias("f")).first()
    assert r.s == status
    if status in ("valid", "renormalised", "clipped"):
        assert abs(sum(r.f) - 1.0) < 2e-5
        assert min(r.f) >= 0.0
    if status in ("zero_sum", "out_of_range"):
        assert r.f is None


def test_vector_helpers(spark):
    df = spark.createDataFrame([([0.1, 0.6, 0.3],), ([0.4, 0.4, 0.2],)], "v array<double>")
    r = df.select(L.argmax("v").alias("a"), L.top_gap("v").alias("g"), L.max_prob("v").alias("m"),
                  L.entropy_norm("v").alias("h"), L.softmax("v").alias("s"),
                  L.probs_to_one_hot("v").alias("o")).collect()
    assert [x.a for x in r] == [1, 0]             # first max wins
    assert math.isclose(r[0].g, 0.3) and math.isclose(r[1].g, 0.0, abs_tol=1e-12)
    assert math.isclose(sum(r[0].s), 1.0, rel_tol=1e-9)
    assert r[1].o == [1.0, 0.0, 0.0]
    h = -sum(p * math.log(p + 1e-10) for p in [0.1, 0.6, 0.3]) / math.log(3)
    assert math.isclose(r[0].h, h, rel_tol=1e-12)


def test_borderline_weight_checks(spark):
    with pytest.raises(ValueError):
        L.borderline_weight("p", exponent=-1)
    with pytest.raises(ValueError):
        L.borderline_weight("p", min_weight=2)
    df = spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "p double")
    w = [r.w for r in df.select(L.borderline_weight("p", 2.0, 0.1).alias("w")).collect()]
    assert w == [0.1, 1.0, 1.0]


def test_clean_training_rows_fails_on_bad_label(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3)], "text string, label int")
    with pytest.raises(Exception):
        Fi.clean_training_rows(df, 2).collect()
    ok = spark.createDataFrame([("a", 0), ("  ", 1), (None, 1)], "text string, label int")
    assert Fi.clean_training_rows(ok, 2).count() == 1


def test_threshold_sweep_matches_filters(spark):
    df = spark.createDataFrame([([0.1, 0.6, 0.3],), ([0.4, 0.4, 0.2],), ([0.9, 0.05, 0.05],)],
                               "v array<double>")
    sw = {r.threshold: r.n_kept for r in Fi.threshold_sweep(df, "v", "top_gap", [0.0, 0.3, 0.5]).collect()}
    for t, n in sw.items():
        assert n == df.filter(Fi.top_gap_at_least("v", t)).count()
