"""Ranks, AUC / AP and sampling against brute force; partition invariance."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from softlab.operators import metrics as M
from softlab.operators import ranking as R
from softlab.operators import sampling as S


def auc_bf(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def ap_bf(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    if P == 0:
        return None
    ap, prev_r = 0.0, 0.0
    for v in order:
        tp = sum(1 for a, b in zip(y, s) if b >= v and a == 1)
        n = sum(1 for b in s if b >= v)
        r = tp / P
        ap += (r - prev_r) * tp / n
        prev_r = r
    return ap


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_auc_ap_vs_bruteforce(spark, rows):
    y = [a for a, _ in rows]
    s = [b / 6 for _, b in rows]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    r = M.auc_ap_table(df, "y", "s").first()
    a, p = auc_bf(y, s), ap_bf(y, s)
    if a is None:
        assert r.roc_auc is None
    else:
        assert abs(r.roc_auc - a) < 1e-12
    if p is None:
        assert r.average_precision is None
    else:
        assert abs(r.average_precision - p) < 1e-12


def test_all_tied_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5)], "y int, s double")
    r = M.auc_ap_table(df, "y", "s").first()
    assert r.roc_auc == 0.5
    one = spark.createDataFrame([(1, 0.2), (1, 0.5)], "y int, s double")
    assert M.auc_ap_table(one, "y", "s").first().roc_auc is None


def test_tie_average_rank(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.3), (4, 0.9)], "id int, x double")
    r = {row.id: row.r for row in R.tie_average_rank(df, "x", "r").collect()}
    assert r == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_hash_rank_exact_and_partition_invariant(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(3000).repartition(parts)
        r = R.hash_rank(df, S.hash_key(7, "id"), "rk", tie="id").collect()
        got = sorted((x.rk, x.id) for x in r)
        import hashlib
        exp = sorted(range(3000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
        assert [i for _, i in got] == exp
        assert [k for k, _ in got] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_take_smallest_and_sample_n(spark):
    import hashlib
    df = spark.range(5000)
    got = sorted(r.id for r in S.sample_n(df, 137, 42).collect())
    exp = sorted(sorted(range(5000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:137])
    assert got == exp
    with pytest.raises(Exception):
        S.sample_n(spark.range(10), 11, 1).collect()


def test_undersample_equal_counts_with_hot_class(spark):
    # one class holds most rows (skew): every class is cut to the minority
    df = spark.range(6000).withColumn("y", F.when(F.col("id") < 4000, 0)
                                      .when(F.col("id") < 5800, 1).otherwise(2))
    u = S.undersample(df, "y", 3)
    counts = {r.y: r["count"] for r in u.groupBy("y").count().collect()}
    assert counts == {0: 200, 1: 200, 2: 200}


def test_kfold_sizes(spark):
    f = S.kfold(spark.range(1003), 5, 1)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003


def test_bootstrap_weight_totals(spark):
    w = S.bootstrap_weights(spark.range(500), 200, 3, 9, replace=True)
    tot = {r.trial: r.t for r in w.groupBy("trial").agg(F.sum("weight").alias("t")).collect()}
    assert tot == {0: 200, 1: 200, 2: 200}
    nr = S.bootstrap_weights(spark.range(500), 200, 3, 9, replace=False)
    assert nr.groupBy("trial").count().agg(F.min("count")).first()[0] == 200


def test_few_shot_distinct(spark):
    prompts = spark.range(50).withColumnRenamed("id", "prompt_id")
    pos = S.few_shot_positions(prompts, F.lit(7), 5, 3, "prompt_id").collect()
    by = {}
    for r in pos:
        by.setdefault(r.prompt_id, []).append(r.pos)
    assert all(len(v) == 5 and len(set(v)) == 5 and all(0 <= x < 7 for x in v) for v in by.values())
    none = S.few_shot_positions(prompts, F.lit(3), 5, 3, "prompt_id")
    assert none.count() == 0             # fewer pool rows than k: no examples


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, yhat int")
    rep = {r.label: r for r in M.classification_report(df, "y", "yhat").collect()}
    assert rep["2"].precision == 0.0 and rep["2"].recall == 0.0 and rep["2"].f1 == 0.0
    assert abs(rep["accuracy"].precision - 0.5) < 1e-12


def test_hot_key_third_of_rows(spark):
    """One score / index value holds a third of all rows: ranks, AUC and the
    index join stay exact (ties collapse map-side; AQE splits the join)."""
    n = 9000
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") % 97) / 97.0).alias("s"),
        (F.col("id") % 5 == 0).cast("int").alias("y"))
    rows = df.collect()
    y = [r.y for r in rows]
    s = [r.s for r in rows]
    # AUC via tie-averaged ranks in numpy
    order = np.argsort(s, kind="mergesort")
    sv = np.array(s)[order]
    ranks = np.empty(n)
    i = 0
    while i < n:
        j = i
        while j + 1 < n and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    P = sum(y)
    auc = (ranks[np.array(y) == 1].sum() - P * (P + 1) / 2) / (P * (n - P))
    got = M.auc_ap_table(df, "y", "s").first().roc_auc
    assert abs(got - auc) < 1e-12
    r = {row.id: row.r for row in R.tie_average_rank(df.select("id", "s"), "s", "r").collect()}
    assert all(abs(r[k] - ranks[k]) < 1e-9 for k in range(0, n, 37))
    from softlab.operators import reshape as RS
    idx = spark.range(n).select(F.col("id").alias("pos"),
                                F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("idx"))
    sel = RS.select_by_index(spark.range(100), idx, "id")
    assert sel.count() == n and sel.filter("id = 7").count() >= n // 3


def test_poisson_bootstrap_moments(spark):
    w = S.bootstrap_poisson(spark.range(20000), 10000, 2, 5, 20000)        # lambda = 0.5
    tot = w.groupBy("trial").agg(F.sum("weight").alias("t")).collect()
    for r in tot:
        assert abs(r.t - 10000) < 400                                      # ~4 sd
    zero = 2 * 20000 - w.count()
    assert abs(zero / 40000 - np.exp(-0.5)) < 0.01                         # P(0) = e^-lambda
    u = spark.createDataFrame([(0.0,), (0.9999999,)], "u double")
    ks = [r.k for r in u.select(S.poisson_from_uniform(F.col("u"), 2.0).alias("k")).collect()]
    assert ks[0] == 0 and 8 <= ks[1] <= 40
