import hashlib
import re

import duckdb
import numpy as np
import pytest
from llm_cases import EDGE, LONG, docs
from pyspark.sql import functions as F

from softlab.llm import exactdedup as X
from softlab.llm.queries import OP12_SQL, REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 40_000])
def test_filter_holds_all_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = X.fuse_filter(np.concatenate([keys, keys[:5]]))
    assert X.may_hold(keys, *made).all()
    others = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    if n >= 1000:
        assert X.may_hold(others, *made).mean() < 0.006
        assert len(made[3]) < 1.6 * n


def plain(rows):
    """(id, text) -> sorted (id, keep_id, group_size, kept, digest)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def seen(df):
    return sorted(((r[0], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in df.collect()), key=str)


ROWS = [*EDGE, (20, "one"), (21, "a  b\t\n c"), (22, "a b c"), (23, "a b c "), (24, " a b c"), (25, "a b"), (26, "a\u0085b"),
        (None, "one"), (None, "none"), (None, "none"), (30, "none"), (31, LONG + "\n"), (32, LONG + " "), (33, "")]


def test_as_by_brute_force(spark, tmp_path):
    assert seen(X.exact_duplicates(docs(spark, ROWS), f"{tmp_path}/store")) == plain(ROWS)


def test_one_text_of_one_digest_in_many_snapshots(spark, tmp_path):
    store = X.ExactStore(spark, f"{tmp_path}/store")
    for part in (ROWS[::3], ROWS[1::3], [], ROWS[2::3]):
        store.add(docs(spark, part))
    assert seen(store.rows()) == plain(ROWS)
    # what an earlier snapshot holds is found there, and not held again
    found = store._found(3).count()
    assert found and store._classes(3).count() - found == store._classes(3).join(store._found(3), ["digest", "ord"], "left_anti").count()


def test_a_store_is_opened_again(spark, tmp_path):
    path = f"{tmp_path}/store"
    X.ExactStore(spark, path).add(docs(spark, ROWS[:12]))
    again = X.ExactStore(spark, path)
    assert len(again.made) == 1
    again.add(docs(spark, ROWS[12:]))
    assert seen(X.ExactStore(spark, path).rows()) == plain(ROWS)


def test_different_texts_of_one_digest_stay_apart(spark, tmp_path):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    rows = [(i, f"text {i % 700}") for i in range(2000)] + ROWS
    got = seen(X.exact_duplicates(docs(spark, rows), f"{tmp_path}/store", digest=weak))
    assert sorted((r[:4] for r in got), key=str) == sorted((r[:4] for r in plain(rows)), key=str)


def test_one_text_holds_a_third_of_all_rows(spark, tmp_path):
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i % 1000}") for i in range(3000)]
    assert seen(X.exact_duplicates(docs(spark, rows), f"{tmp_path}/store")) == plain(rows)


def test_string_ids_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "x "), ("c", "x ")], "doc_id string, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_duplicates(df, f"{tmp_path}/a").collect()}
    assert got == {"a": ("a", 2, True), "c": ("a", 2, False), "b": ("b", 1, True)}
    assert X.exact_duplicates(docs(spark, []), f"{tmp_path}/b").count() == 0


def test_no_text_is_shuffled_to_join_the_buckets(spark, tmp_path):
    store = X.ExactStore(spark, f"{tmp_path}/store")
    store.add(docs(spark, ROWS[:12]))
    store.add(docs(spark, ROWS[12:]))
    mine, there = store._classes(1), store._classes(0)
    positive = spark.createDataFrame([(b"x",)], "digest binary")
    plan = mine.join(positive.hint("merge"), "digest", "left_semi").join(
        there.withColumnRenamed("text", "t").hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*\n?[^\n]*FileScan", plan)


def test_equal_to_the_sql(spark):
    got = REGISTRY["op12_exact_dedup"].fn(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(OP12_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got[want.columns].astype(str).equals(want.astype(str))
