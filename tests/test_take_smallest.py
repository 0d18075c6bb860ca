"""The smallest hashes of a few groups: rows past a group's boundary aren't shuffled."""

import contextlib
import hashlib
import io

from softlab.operators import sampling as S


def test_subsample_without_join_by_shuffle(spark):
    df = spark.range(3000).selectExpr("id")
    out = S.bootstrap_weights(df, 100, 3, 42, replace=False)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        out.explain()
    assert "BroadcastHashJoin" in shown.getvalue() and "SortMergeJoin" not in shown.getvalue()
    got = {}
    for r in out.collect():
        got.setdefault(r["trial"], set()).add(r["id"])
    for t in range(3):
        order = sorted(range(3000), key=lambda i, t=t: (hashlib.md5(f"{42 + t}:{i}".encode()).hexdigest(), i))
        assert got[t] == set(order[:100])


def test_fewer_rows_than_asked(spark):
    out = S.bootstrap_weights(spark.range(5).selectExpr("id"), 100, 2, 1, replace=False)
    assert sorted((r["trial"], r["id"]) for r in out.collect()) == [(t, i) for t in range(2) for i in range(5)]
