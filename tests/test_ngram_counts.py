"""N-grams: counted where the text is, before anything is shuffled."""

import contextlib
import io
from collections import Counter

from pyspark.sql import functions as F

from softlab.operators import diversity as D


def test_repeated_grams_are_few_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "GRAM_TOKENS", 7)
    texts = ["a b a b a b", None, "", "a", "b a", "x y z \u00e9 \U0001F600 1", "a b " * 50]
    df = spark.createDataFrame([(i, t, "r" if i % 2 else None) for i, t in enumerate(texts)], "id long, text string, run string").coalesce(1)
    for n in (1, 2, 3):
        grams = [(run, " ".join(w[i:i + n])) for _, t, run in df.collect() for w in [(t or "").split()] for i in range(len(w) - n + 1)]
        rows = D.ngram_counts(df, n, keep=["run"]).collect()
        got = Counter()
        for r in rows:
            got[r["run"], r["gram"]] += r["n"]
        assert got == Counter(grams) and len(rows) < len(grams) / 2
        one = D.distinct_n(df, n).first()
        assert (one["n_unique"], one["n_total"]) == (len({g for _, g in grams}), len(grams))
        by = {r["run"]: (r["n_unique"], r["n_total"]) for r in D.distinct_n(df, n, by=["run"]).collect()}
        assert by == {k: (len({g for q, g in grams if q == k}), sum(q == k for q, _ in grams)) for k in {q for q, _ in grams}}


def test_no_grams(spark):
    r = D.distinct_n(spark.createDataFrame([(1, "a")], "id long, text string"), 2).first()
    assert (r["n_unique"], r["n_total"], r["distinct_2"]) == (0, 0, 0.0)


def test_documents_are_dealt_not_grams(spark):
    df = spark.createDataFrame([(1, "a b a b"), (1, "a b"), (2, "a b c"), (None, "b c")], "id long, text string")
    out = D.ngram_freq(df, 2, "id")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain()
    assert "hashpartitioning(gram" in shown.getvalue() and "hashpartitioning(gram#" in shown.getvalue()
    assert not [x for x in shown.getvalue().split("\n") if "hashpartitioning(gram" in x and "id#" in x.split("hashpartitioning(")[1].split(")")[0]]
    assert {r["gram"]: (r["total_count"], r["doc_count"]) for r in out.collect()} == {"a b": (4, 2), "b a": (1, 1), "b c": (2, 2)}
    assert out.filter(F.col("doc_count") > 1).count() == 2
