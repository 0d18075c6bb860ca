"""Special functions and order statistics against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from softlab.functions import special as S
from softlab.operators import diversity as D
from softlab.operators import metrics as M
from softlab.operators.ranking import exact_quantiles, hash_rank, take_smallest


def test_log_gamma(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 5000.5, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-12)


def test_p_values(spark):
    """Against the density of t, summed by Simpson's rule."""
    cases = [(0.1, 50), (-0.3, 20), (0.9, 5), (0.02, 5000), (0.5, 3), (0.0, 10), (-0.99, 4)]
    got = [r[0] for r in spark.createDataFrame(cases, "r double, n long").select(S.correlation_p(F.col("r"), F.col("n"))).collect()]
    for (r, n), p in zip(cases, got, strict=True):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        x = np.linspace(0, t, 200_001)
        f = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        w = np.ones(len(x))
        w[1:-1:2], w[2:-1:2] = 4, 2
        assert p == pytest.approx(1 - 2 * float((w * f).sum() * (x[1] - x[0]) / 3), abs=1e-10)
    odd = spark.createDataFrame([(None, 9), (1.0, 9), (0.5, 2), (float("nan"), 9)], "r double, n long")
    a, b, c, d = [r[0] for r in odd.select(S.correlation_p(F.col("r"), F.col("n"))).collect()]
    assert math.isnan(a) and b == 0.0 and math.isnan(c) and math.isnan(d)


def test_quantiles_of_all_distinct_values(spark):
    df = spark.range(20_011).select((F.xxhash64("id") / 1e9).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"))
    qs = [0.0, 0.01, 0.25, 0.5, 0.731, 0.999, 1.0]
    pdf = df.toPandas()
    assert exact_quantiles(df, "v", qs).first()["q"] == pytest.approx(np.quantile(pdf["v"], qs).tolist(), rel=1e-12)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", qs, group_cols=["g"]).collect()}
    assert len(got) == 5 and None in got
    for g, own in pdf.groupby("g", dropna=False)["v"]:
        assert got[None if np.isnan(g) else g] == pytest.approx(np.quantile(own, qs).tolist(), rel=1e-12)


def test_quantiles_without_numbers_and_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "k string, v double")
    got = {r["k"]: (r["count"], r["q25"], r["q50"], r["max"]) for r in D.describe_by(df, "k", "v").collect()}
    assert got == {"a": (3, 1.0, 1.0, 2.0), "b": (0, None, None, None), None: (1, 4.0, 4.0, 4.0)}
    assert "percentile" not in D.quantile_range(df, "v", [(0.1, 0.9)])._jdf.queryExecution().executedPlan().toString().lower()


def test_rows_of_a_null_group_stay(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    assert take_smallest(df, "h", 10, ["g"]).groupBy("g").count().collect() and \
        {r["g"]: r["count"] for r in take_smallest(df, "h", 10, ["g"]).groupBy("g").count().collect()} == {None: 10, 1: 10, 2: 10}
    assert {r["g"]: r["m"] for r in hash_rank(df, "h", "r", ["g"]).groupBy("g").agg(F.max("r").alias("m")).collect()} == {None: 19, 1: 19, 2: 19}
    from softlab.operators.sampling import undersample
    assert {r["g"]: r["count"] for r in undersample(df, "g", 3).groupBy("g").count().collect()} == {None: 20, 1: 20, 2: 20}


def test_scores_that_are_no_numbers_raise(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 0.5), (0, bad)], "y int, p double")
        with pytest.raises(Exception, match="must be numbers"):
            M.evaluate_binary(df, "y", "p").collect()


def test_one_vs_one_and_one_vs_rest_from_one_table(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), [float(v) for v in np.round(rng.dirichlet(np.ones(4) + 3 * (np.arange(4) == y)), 2)]) for y in rng.integers(0, 4, 500)]
    df = spark.createDataFrame(rows, "y int, v array<double>")

    def auc(c, d):
        """Positives of class c and negatives of the classes d, by all pairs."""
        a = np.array([v[c] for y, v in rows if y == c])[:, None]
        b = np.array([v[c] for y, v in rows if y in d])[None, :]
        return ((a > b) + 0.5 * (a == b)).mean()

    pairs = np.mean([(auc(c, {d}) + auc(d, {c})) / 2 for c in range(4) for d in range(c)])
    assert M.roc_auc_ovo(df, "y", "v", 4).first()[0] == pytest.approx(pairs)
    got = {r["cls"]: r["roc_auc"] for r in M.roc_auc_ovr_from_pairs(df, "y", "v", 4).collect()}
    assert got == pytest.approx({c: auc(c, set(range(4)) - {c}) for c in range(4)})
    assert {r["cls"]: r["roc_auc"] for r in M.ovr_auc_ap(df, "y", "v").collect()} == pytest.approx(got)


def test_the_input_of_an_evaluation_is_read_once(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 2).cast("int").alias("y"), (F.xxhash64("id") % 1000 / 1000.0).alias("p")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    done = M.evaluate_binary(df, "y", F.abs("p"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/t" not in plan and plan.count("FileScan") <= 2
