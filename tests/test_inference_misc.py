"""Model-call operators with an in-process stub client, and small helpers."""

import json

import pytest
from pyspark.sql import functions as F

from softlab.operators import filters as Fi
from softlab.operators import inference as INF
from softlab.operators import metrics as M
from softlab.operators import reshape as RS
from softlab.operators import sampling as S
from softlab.operators.experiments import trial_summary
from softlab.session import scratch_path


def _stub():
    """Deterministic stand-in for a model: label from the prompt length;
    prompts containing 'fail' raise, 'null' returns None.  Built in a
    factory so it is pickled by value for the Python workers."""
    def client(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("boom")
        return [None if "null" in p else {"label": (len(p) % 10) / 10.0, "text": p.upper()} for p in prompts]
    return client


stub_client = _stub()


def test_infer_one_row_per_row(spark):
    df = spark.createDataFrame([(i, f"prompt {i}" + (" null" if i == 3 else "")) for i in range(10)],
                               "id long, prompt string")
    out = INF.infer(df, "prompt", stub_client, batch=4, retries=0)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 10
    assert rows[3].response is None
    assert json.loads(rows[0].response)["text"] == "PROMPT 0"
    parsed = INF.parse_responses(out, "label double, text string")
    assert parsed.filter(F.col("label").isNotNull()).count() == 9


def test_infer_failure_is_per_batch_error(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "fail")], "id long, prompt string").coalesce(1)
    rows = INF.infer(df, "prompt", stub_client, batch=2, retries=1, backoff=0.0).collect()
    assert all(r.response is None and r.error.startswith("RuntimeError") for r in rows)


def test_embed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, text string")
    def make():
        return lambda xs: [[float(len(x)), 1.0] for x in xs]
    out = INF.embed(df, "text", make()).collect()
    assert sorted((r.id, list(r.embedding)) for r in out) == [(1, [1.0, 1.0]), (2, [2.0, 1.0])]


def test_generate_until(spark):
    out = scratch_path(spark, "t-gen")

    def make_requests(i):
        return spark.range(5).select((F.col("id") + 5 * i).alias("id"),
                                     F.concat(F.lit("p"), F.col("id").cast("string"),
                                              F.when(F.col("id") == 0, F.lit(" null")).otherwise(F.lit(""))).alias("prompt"))

    n = INF.generate_until(make_requests, 9, stub_client, out, "label double, text string",
                           lambda d: F.col("label").isNotNull())
    assert n == 12                       # 4 valid per batch; the overshoot is kept
    assert spark.read.json(out).count() == 12


def test_feedback_loop(spark):
    def make_requests(i, pool):
        k = 0 if pool is None else pool.count()
        return spark.range(4).select((F.col("id") + 4 * i).alias("id"),
                                     F.lit(f"iter {i} shots {k}").alias("prompt"))

    train = INF.feedback_loop(make_requests, 3, stub_client, "label double, text string",
                              lambda d: F.col("label").isNotNull(), interval=1,
                              refresh_pool=lambda t: t.orderBy("id").limit(2))
    assert train.count() == 12


def test_dataset_config_and_lookup(spark):
    cfg = RS.dataset_config(spark)
    df = spark.createDataFrame([("emotion",), ("imdb",), ("nope",)], "dataset string")
    got = {r.dataset: r.k for r in RS.lookup_config(df, cfg, "dataset").collect()}
    assert got == {"emotion": 6, "imdb": 2, "nope": None}


def test_feedback_gate_and_finite(spark):
    it = spark.range(2000).select(S.feedback_gate("id", 0.3, 1).alias("g"))
    share = it.agg(F.avg(F.col("g").cast("double"))).first()[0]
    assert 0.25 < share < 0.35
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert df.filter(Fi.is_finite("x")).count() == 1


def test_trial_summary_nan_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (1, float("nan")), (2, 0.7), (3, float("nan"))], "size int, acc double")
    r = {x.size: x for x in trial_summary(df, ["size"], ["acc"]).collect()}
    assert r[1].acc_mean == 0.5 and r[1].acc_std is None     # one finite trial: std is null
    assert r[3].acc_mean is None                               # all-NaN


def test_metric_registry_rejects_unknown(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1])], "y int, p array<double>")
    with pytest.raises(ValueError):
        M.evaluate(df, "y", "p", ["nope"])


def test_judge_defaults_vector(spark):
    from softlab.operators import prompts as G
    req = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    judged = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4], 0.8, None), (2, None, None, "parse error")],
                                   "id long, judge_score array<double>, judge_confidence double, error string")
    out = {r.id: r for r in G.judge_with_defaults(req, judged, ["id"], k=4).collect()}
    assert out[1].judge_score == [0.1, 0.2, 0.3, 0.4] and out[1].error is None
    assert out[2].judge_score == [0.25] * 4 and out[2].judge_confidence == 0.0 and out[2].error == "parse error"
    assert out[3].judge_score == [0.25] * 4 and out[3].error == "no judgement"
