"""Pair-free similarity vs the naive N^2 definition; text edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from softlab.functions import text as T
from softlab.operators import diversity as D
from softlab.operators import similarity as S


def naive(X, labels=None, multi=None):
    X = np.asarray(X, float)
    n = np.linalg.norm(X, axis=1, keepdims=True)
    U = np.divide(X, n, out=np.zeros_like(X), where=n > 0)
    sims, intra, inter = [], [], []
    for i in range(len(X)):
        for j in range(i + 1, len(X)):
            s = float(U[i] @ U[j])
            sims.append(s)
            if labels is not None:
                (intra if labels[i] == labels[j] else inter).append(s)
            if multi is not None:
                (intra if (np.asarray(multi[i]) @ np.asarray(multi[j])) > 0 else inter).append(s)
    m = lambda a: float(np.mean(a)) if a else 0.0
    return m(sims), m(inter), m(intra)


def test_cosine_by_class_vs_naive(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(40, 5))
    X[3] = 0.0                              # a zero vector counts as similarity 0
    lab = rng.integers(0, 4, size=40)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(40)],
                               "id int, e array<double>, label int")
    r = S.cosine_by_class(df, "e", "label").first()
    avg, inter, intra = naive(X, lab)
    assert abs(r.average - avg) < 1e-12 and abs(r.inter - inter) < 1e-12 and abs(r.intra - intra) < 1e-12
    assert abs(S.mean_pairwise_cosine(df, "e").first().mean_cosine - avg) < 1e-12


def test_multilabel_vs_naive(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(30, 4))
    ML = rng.integers(0, 2, size=(30, 3))
    df = spark.createDataFrame([(i, X[i].tolist(), *[int(v) for v in ML[i]]) for i in range(30)],
                               "id int, e array<double>, a int, b int, c int")
    r = S.cosine_multilabel(df, "e", ["a", "b", "c"]).first()
    _avg, inter, intra = naive(X, multi=ML)
    assert abs(r.inter - inter) < 1e-12 and abs(r.intra - intra) < 1e-12


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_inputs(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(n)], "id int, e array<double>, label int")
    r = S.cosine_by_class(df, "e", "label").first()
    if n < 2:
        assert r.intra == 0.0 and r.inter == 0.0
    else:
        assert r.inter == 0.0 and r.intra > 0


def test_tokenizer_edge_cases(spark):
    rows = [("",), ("\t\n",), ("a b",), ("word",), (None,), ("Hi, there!",)]
    df = spark.createDataFrame(rows, "text string")
    toks = [r.t for r in df.select(T.tokenize("text").alias("t")).collect()]
    assert toks == [[], [], ["a", "b"], ["word"], [], ["Hi", ",", "there", "!"]]
    grams = [r.g for r in df.select(T.ngrams(T.tokenize("text"), 2).alias("g")).collect()]
    assert grams[3] == [] and grams[5] == ["Hi ,", ", there", "there !"]


def test_clean_and_strip(spark):
    df = spark.createDataFrame([("  Hello, WORLD!!  \n x ",)], "text string")
    r = df.select(T.clean_text("text").alias("c"), T.strip_text("text").alias("s"),
                  T.null_safe_concat(F.lit(None), "text").alias("j")).first()
    assert r.c == "hello world x"
    assert r.s == "Hello, WORLD!!  \n x"
    assert r.j.startswith(" ")


def test_single_spaces_are_left_alone():
    """Most whitespace of a text needs no replacing, so the pattern must not match there."""
    assert re.findall(T.WS_RUN, "a b c 1 2") == []
    assert re.findall(T.WS_RUN, "a  b\nc \n\t d\u3000e f\n g") == ["  ", "\n", " \n\t ", "\u3000", "\n "]


def test_clean_text_of_every_character(spark):
    """Against the definition in plain Python, where whitespace is ``str.isspace``."""
    kept = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def plain(t):
        t = "".join(c for c in t.lower() if c in kept or c.isspace())
        return " ".join(t.split())

    points = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F300, 0x1F700), 0x10FFFF]]
    rng = random.Random(3)
    texts = [f"{c}a{c}B {c} 1{c}{c}2 {c}{c}\n{c}" for c in points]
    texts += ["".join(rng.choices(["a", "Q", "7", " ", "  ", "\n", "\u00a0", "\u2003", "!", "é", "日", "🙂", "\x1c", "\x85"], k=rng.randrange(40)))
              for _ in range(3000)]
    texts += ["日" * 200_000, " " * 200_000, "a " * 100_000, "", "\u0130x", "!"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, text string")
    got = [r.c for r in df.select("id", T.clean_text("text").alias("c")).orderBy("id").collect()]
    assert got == [*map(plain, texts), None]


def test_distinct_n_demo(spark):
    texts = ["the cat sat on the mat", "the cat sat on the hat", "a dog"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    r = D.distinct_n(df, 2).first()
    grams = [tuple(t.split()[i:i + 2]) for t in texts for i in range(len(t.split()) - 1)]
    assert r.n_total == len(grams) and r.n_unique == len(set(grams))
    f = {x.gram: (x.total_count, x.doc_count) for x in D.ngram_freq(df, 2, "id", min_docs=2).collect()}
    assert f["the cat"] == (2, 2) and "a dog" not in f
    empty = spark.createDataFrame([(0, "one")], "id int, text string")
    assert D.distinct_n(empty, 2).collect() == [] or D.distinct_n(empty, 2).first()["distinct_2"] == 0.0


def test_replication_closed_form(spark):
    """r copies of each vector: pair sums scale exactly, so the replicated
    intra mean equals (r^2 * S_intra + pairs of identical copies) / pairs."""
    rng = np.random.default_rng(7)
    X = rng.normal(size=(12, 3))
    lab = rng.integers(0, 3, size=12)
    r = 5
    rows = [(i * r + c, X[i].tolist(), int(lab[i])) for i in range(12) for c in range(r)]
    df = spark.createDataFrame(rows, "id long, e array<double>, label int")
    got = S.cosine_by_class(df, "e", "label").first()
    Xr = np.repeat(X, r, axis=0)
    avg, inter, intra = naive(Xr, np.repeat(lab, r))
    assert abs(got.intra - intra) < 1e-12 and abs(got.inter - inter) < 1e-12
