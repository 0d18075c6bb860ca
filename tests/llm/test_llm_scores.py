"""LM scoring and the quality classifier."""
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from llm_cases import EDGE, docs
from pyspark.sql import functions as F

from softlab.llm import lmscore, quality


def test_losses_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "D"] if i % 3 else ["x", "y", "b"], k=rng.randrange(30)))) for i in range(60)]
    df = docs(spark, rows)
    half = {r["doc_id"]: r["h"] for r in df.select("doc_id", lmscore._half(F.col("doc_id")).alias("h")).collect()}
    target = {i for i, _ in rows if i % 3 == 0}
    ids = spark.createDataFrame([(i,) for i in [*target, 0, 999, None]], "doc_id long")
    got = {r["doc_id"]: r for r in lmscore.score(df, lmscore.fit(df, ids)).collect()}
    for h in (0, 1):
        models = []
        for mine in (target, {i for i, _ in rows}):
            one, two = Counter(), Counter()
            for i, t in rows:
                if i in mine and half[i] == h:
                    w = t.lower().split()
                    one.update(w + [""] * bool(w))
                    two.update(zip(["", *w[:-1]], w))
            models.append((one, two, sum(one.values()) - one[""]))
        n = models[0][2]
        for i, t in rows:
            if half[i] == 1 - h:
                w = t.lower().split()
                means = []
                for one, two, size in models:
                    f = n / size
                    loss = 0
                    for a, b in zip(["", *w[:-1]], w):
                        p = (one[b] * f + 1) / (n + lmscore.UNIGRAMS)
                        loss -= math.log((two[a, b] * f + lmscore.K * p) / (one[a] * f + lmscore.K))
                    means.append(loss / max(len(w), 1))
                assert got[i]["n_tokens"] == len(w)
                assert got[i]["target_loss"] == pytest.approx(means[0], abs=1e-4)
                assert got[i]["score"] == pytest.approx(means[0] - means[1], abs=1e-4)


def test_every_word_and_pair_has_its_own_count(spark):
    """More distinct words and pairs than any fixed table of the size once used could hold apart."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400_000)}" for _ in range(15_000)) for _ in range(40)]
    df = docs(spark, [*enumerate(texts), (None, texts[0])])
    half = {r["doc_id"]: r["h"] for r in df.select("doc_id", lmscore._half(F.col("doc_id")).alias("h")).collect()}
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    probe = docs(spark, [(i, " ".join(texts[i].split()[:200] + texts[(i + 7) % 40].split()[:200])) for i in range(6)])
    got = {r["doc_id"]: r for r in lmscore.score(probe, lmscore.fit(df, ids)).collect()}
    assert len(got) == 6
    for i, r in ((r["doc_id"], r) for r in probe.collect()):
        losses, size = [], []
        for mine in (lambda d: d is not None and d % 3 == 0, lambda d: True):
            one, two = Counter(), Counter()
            for d, t in [*enumerate(texts), (None, texts[0])]:
                if mine(d) and half[d] == 1 - half[i]:
                    w = ["", *t.split()]
                    one.update(w)
                    two.update(zip(w, w[1:]))
            size.append(sum(one.values()) - one[""])
            f, w = size[0] / size[-1], ["", *r["text"].split()]
            losses.append(sum(math.log(one[a] * f + lmscore.K) - math.log(two[a, b] * f + lmscore.K * (one[b] * f + 1) / (size[0] + lmscore.UNIGRAMS))
                              for a, b in zip(w, w[1:])) / (len(w) - 1))
        assert got[i]["target_loss"] == pytest.approx(losses[0], abs=1e-9)
        assert got[i]["background_loss"] == pytest.approx(losses[1], abs=1e-9)


def test_lm_edge_rows(spark):
    ids = spark.createDataFrame([], "doc_id long")
    got = lmscore.score(docs(spark, EDGE), lmscore.fit(docs(spark, EDGE), ids)).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r["score"]) for r in got)
    assert lmscore.score(docs(spark, []), lmscore.fit(docs(spark, []), ids)).count() == 0


def test_documents_are_shuffled_once(spark):
    """Counting and scoring read one shuffle of the texts, and no copy of what chunks get is written."""
    df = docs(spark, [(i, f"word{i % 7} of a text {i}") for i in range(50)])
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    got = lmscore.score(df, lmscore.fit(df, ids))
    assert len(got.collect()) == 50
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and "FileScan" not in final


def test_chunks_without_scored_documents(spark):
    """Chunks that are only counted, or hold target ids alone, return no rows."""
    df = docs(spark, [(i, f"a b c{i % 5}") for i in range(300)])
    probe = docs(spark, [(5, "a b"), (None, None), (7, "")])
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 3)], "doc_id long")
    got = lmscore.score(probe, lmscore.fit(df, ids)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (5, 2), (7, 0)]
    text = F.col("doc_id").cast("string")
    got = lmscore.score(probe.withColumn("doc_id", text), lmscore.fit(df.withColumn("doc_id", text), ids)).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in got) == [("", 0), ("5", 2), ("7", 0)]


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices(["ab", "cd", "ef", "gh"], k=3)) for _ in range(rng.randrange(20, 80))]
        good, toxic = int(rng.random() < .8), int(rng.random() < .15)
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), "vile" + rng.choice(["ab", "cd", "ef"]))
        rows.append((i, " ".join(w), rng.choice("xyz"), f"host{min(rng.randrange(9), 4)}"))
        labels.append((i, good, toxic))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


def test_classifier_on_held_out_labels(spark):
    df, labels, known = labelled(spark, 1500, 3)
    got = {r["doc_id"]: r for r in quality.classify(df, labels.filter("doc_id < 1000")).collect()}
    hold = [(i, bool(g and not t)) for i, g, t in known if i >= 1000]
    assert sum(got[i]["kept"] == want for i, want in hold) >= 0.97 * len(hold)


def test_unseen_words_are_unknown_whatever_the_vocabulary(spark):
    """Texts of one shape, of words whose beginnings no labelled document has, are alike."""
    rng = random.Random(8)
    word = lambda letters, k: "".join(rng.choices(letters, k=k))
    texts = [(i, " ".join(word("abcdefghijklm", rng.randrange(6, 11)) for _ in range(rng.randrange(20, 1200))) + " vile" * (i % 5 == 0))
             for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0)) for i, _ in texts], "doc_id long, quality int, toxic int")
    evidence = quality.fit(docs(spark, texts), labels, "doc_id", "text")
    probes = [" ".join(word("nopqrstuwxyz", 8) for _ in range(300)) for _ in range(40)]
    for p in evidence(pa.array(probes)):
        assert max(p) - min(p) < 1e-9
    toxic = evidence(pa.array([t for _, t in texts]))[1]
    assert min(toxic[::5]) > max(toxic[i] for i in range(300) if i % 5)


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(f"h{h}", f"p{p}", 0.9 if h < 5 else 0.2) for h in range(10) for p in range(3) for _ in range(40)]
    rows += [("h0", "rare", 0.5), ("new", "one", 0.5), (None, None, 0.5), (None, "p", 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, host string, path string, evidence double")
    got = quality.posteriors(df).collect()
    assert len(got) == len(rows)
    by = {(r["host"], r["path"]): r["prior"] for r in got}
    assert by["h0", "p0"] > 0.8 > by["h0", "rare"] - 0.2 and by["h0", "rare"] > 0.75 and by["h9", "p0"] < 0.3
    assert abs(by[None, None] - 0.55) < 0.05 and 0.4 < by["new", "one"] < 0.7


def test_quality_edge_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (3, 1, 0), (3, 1, 0), (None, 0, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        got = quality.classify(docs(spark, EDGE), labels).collect()
        assert len(got) == len(EDGE) and all(0 <= r["posterior"] <= 1 for r in got)
    assert quality.classify(docs(spark, []), one).count() == 0
