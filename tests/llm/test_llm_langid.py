import random

import numpy as np
from llm_cases import EDGE, docs
from pyspark.sql import functions as F

from softlab.llm import langid


def test_marginals_against_plain_forward_backward():
    rng = np.random.default_rng(2)
    k = 3
    step, begin = rng.random((k, k)) + .1, rng.random(k) + .1
    sizes = [0, 1, 5, 0, 400, 2, 90, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.random((first[-1], k)) + .01
    got = langid.marginals(e, first, step, begin)[2]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        alpha, beta = [begin * e[a]], [np.ones(k)]
        for t in range(a + 1, b):
            x = alpha[-1] @ step * e[t]
            alpha.append(x / x.sum())
        for t in range(b - 1, a, -1):
            x = step @ (e[t] * beta[-1])
            beta.append(x / x.sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def language(rng, parts):
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60)))


def test_learns_languages_switches_and_edges(spark):
    rng = random.Random(1)
    parts = {"aa": ["th", "ing", "er", "on"], "bb": ["sch", "ung", "ich", "ö"], "cc": ["eau", "que", "é", "les"]}
    rows = [(i, language(rng, parts[x]), x) for i, x in enumerate(rng.choices(list(parts), k=300))]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(df.filter(~held))
    got = langid.identify(df, model).join(df.withColumnRenamed("text", "t"), "doc_id").filter(held & F.col("lang").isNotNull()).collect()
    assert len(got) > 40 and sum(r["lang_pred"] == r["lang"] for r in got if r["t"]) >= 0.98 * len([r for r in got if r["t"]])
    assert all(0 <= r["score"] <= 1 for r in got)
    mixed = language(rng, parts["aa"]) + " " + language(rng, parts["bb"])
    n = len(mixed.split())
    one = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert sum(s["n"] for s in one["segments"]) == n and {s["lang"] for s in one["segments"]} >= {"aa", "bb"}
    assert np.diag(model.step).mean() > model.step.mean()      # staying is learned
    edge = {r["doc_id"]: r for r in langid.identify(docs(spark, EDGE + [(9, "12 34 !?")]), model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (0, 1, 2, 9))
    assert edge[4]["lang_pred"] in parts
    assert langid.identify(docs(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, EDGE), model).collect()} == {"und"}


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the house and the garden of number {i} was very old", "en") for i in range(3000)]
    rows += [(5000 + i, f"talo ja puutarha numero {i} oli hyvin vanha", "fi") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, max_docs=100)
    assert set(model.labels) == {"en", "fi"}
    ask = spark.createDataFrame([(1, "puutarha oli vanha")], "doc_id long, text string")
    assert langid.identify(ask, model).first()["lang_pred"] == "fi"
