"""Samplers, experiments, refinement, similarity and readers as they are now."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from softlab.operators import experiments as E
from softlab.operators import inference as INF
from softlab.operators import models as MD
from softlab.operators import refine as RF
from softlab.operators import sampling as S
from softlab.operators import similarity as SIM
from softlab.sources import readers as RD

IDS = np.arange(40_000)


@pytest.mark.parametrize("shape", [0.1, 0.5, 1.0, 5.0])
def test_gamma_draws_have_the_right_moments(shape):
    x = S.hash_gammas(IDS, np.full(len(IDS), shape), 7, 3)
    assert x.mean() == pytest.approx(shape, rel=0.05) and x.var() == pytest.approx(shape, rel=0.1)
    assert (x == S.hash_gammas(IDS[::-1], np.full(len(IDS), shape), 7, 3)[::-1]).all()     # by id, not by place
    assert not (x == S.hash_gammas(IDS, np.full(len(IDS), shape), 8, 3)).any()


def test_named_strategies_and_beta(spark):
    d = S.sample_dirichlet(spark.range(4000), 4, "very flat", 1).select(F.col("label")[0].alias("a"), F.aggregate(
        "label", F.lit(0.0), lambda x, y: x + y).alias("s")).toPandas()
    assert d["s"].sub(1).abs().max() < 1e-9 and d["a"].mean() == pytest.approx(0.25, abs=0.01)
    assert d["a"].var() == pytest.approx(0.25 * 0.75 / 21, rel=0.15)
    for name in ("very spiky", "spikier", "slightly spiky", "flat", "very flat", "mixed"):
        S.sample_dirichlet(spark.range(3), 4, name, 1).collect()
    with pytest.raises(ValueError):
        S.sample_dirichlet(spark.range(3), 4, "spiky", 1)
    b = S.sample_margin_beta(spark.range(4000).withColumn("y", F.col("id") % 2 == 0), "y", 0.1, 3, shape=(2.0, 2.0)).toPandas()
    assert b[b.y]["p"].min() >= 0.6 and b[~b.y]["p"].max() <= 0.4 and b[b.y]["p"].mean() == pytest.approx(0.8, abs=0.01)


def _embedded(spark, n=240):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 4))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    rows = [(i, x[i].tolist(), float(p[i]), [1 - float(p[i]), float(p[i])], int(p[i] > .5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, p double, pvec array<double>, y int")


def test_trained_size_is_the_reported_size(spark):
    df = _embedded(spark).filter("id < 50")
    draws = E.training_draws(df, [20, 500], 3, 5)
    got = {(r["size"], r["trial"]): r["w"] for r in draws.groupBy("size", "trial").agg(F.sum("weight").alias("w")).collect()}
    assert got == {(s, t): s for s in (20, 500) for t in range(3)}
    res = E.downstream_experiment(df, _embedded(spark), [30], 1, "standard", probs="pvec", C=1.0).collect()
    assert {r["split"] for r in res} == {"train", "test"} and all(r["accuracy"] > 0.8 for r in res)
    assert E.downstream_experiment(df.filter("id < 0"), df, [5], 1, probs="pvec", C=1.0).count() == 0


def test_weighted_fit_equals_repeated_rows(spark):
    df = _embedded(spark, 60)
    weighted = df.withColumn("w", (F.col("id") % 3).cast("double"))
    repeated = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter("k <= id % 3")
    a = MD.fit_standard_lr(weighted, "embedding", "y", C=0.5, binary=True, weight="w", tol=1e-10, max_iter=500)
    b = MD.fit_standard_lr(repeated, "embedding", "y", C=0.5, binary=True, tol=1e-10, max_iter=500)
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-4)


def test_vectors_of_mixed_length_are_refused(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>")
    with pytest.raises(ValueError):
        MD.vector_length(df, "v")


def test_refinement_blends_ambiguous_rows_and_scores_the_test_set(spark):
    df = _embedded(spark)
    out, hist = RF.refine_labels(df.select("id", "embedding", "p"), [0.3], cs=[1.0], folds=3, test=df, y="y")
    h = hist.first()
    assert h["status"] == "stopped" and 0.8 < h["test_accuracy"] <= 1 and h["test_roc_auc"] > 0.9 and h["test_brier"] < 0.2
    pairs = out.select("id", F.col("p").alias("q")).join(df, "id").collect()
    for r in pairs:
        if 0.2 < r["p"] < 0.8:
            assert abs(r["q"] - r["p"]) <= 0.1 + 1e-9
        else:
            assert r["q"] == r["p"]
    _, none = RF.refine_labels(df.filter("p > 0.6").select("id", "embedding", "p"), [0.3], cs=[1.0], folds=3)
    assert none.first()["status"] == "skipped"


def test_oracle_relabel_uses_hard_predictions(spark):
    df = _embedded(spark)
    rel, model = RF.relabel_with_oracle(df.filter("id % 2 = 0"), df.filter("id % 2 = 1").drop("p"), "embedding", "y", cs=[1.0], folds=3)
    assert {r[0] for r in rel.select("oracle_label").distinct().collect()} == {0, 1}
    assert RF.test_metrics(model, df, "y")["accuracy"] > 0.9


def test_multilabel_similarity_takes_many_classes(spark):
    rng = np.random.default_rng(3)
    n, c = 40, 20
    e = rng.normal(size=(n, 3))
    m = (rng.random((n, c)) < 0.08).astype(int)
    names = [f"c{i}" for i in range(c)]
    rows = [(e[i].tolist(), *m[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "e array<double>, " + ", ".join(f"{x} int" for x in names))
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    cos, share = u @ u.T, (m @ m.T) > 0
    up = np.triu(np.ones((n, n), bool), 1)
    r = SIM.cosine_multilabel(df, "e", names).first()
    assert r["intra"] == pytest.approx(cos[up & share].mean()) and r["inter"] == pytest.approx(cos[up & ~share].mean())


def test_row_ids_do_not_depend_on_the_split_size(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(5000).orderBy("id").select((F.col("id").cast("double")).alias("label"), F.lit("x" * 50).alias("text")) \
        .coalesce(3).write.json(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "100k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = RD.read_generated(spark, path, "binary", with_row_id=True).select("row_id", "label").collect()
            assert sorted(r["row_id"] for r in got) == list(range(5000))
            assert all(r["row_id"] == r["label"] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_generation_that_falls_short_is_an_error(spark, tmp_path):
    def client(prompts):
        return ['{"label": null, "text": "x"}' for _ in prompts]

    def requests(i):
        return spark.range(4).select(F.col("id").alias("prompt_id"), F.lit("p").alias("prompt"))
    with pytest.raises(RuntimeError):
        INF.generate_until(requests, 3, client, str(tmp_path / "out"), "label double, text string",
                           lambda df: F.col("label").isNotNull(), max_rounds=2)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from softlab import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
