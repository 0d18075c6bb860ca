"""Tables that appear whole, and loops that go on where they stopped."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from softlab.operators import inference as INF
from softlab.sources import published as P
from softlab.sources import readers as RD
from softlab.sources import writers as WR


def test_a_table_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert P.read_published(spark, path, "a") is None and P.published(spark, path) == []
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        P.publish(bad, path, "a")
    assert P.read_published(spark, path, "a") is None
    P.publish(spark.range(3), path, "a")
    first = P.read_published(spark, path, "a")
    with pytest.raises(P.AlreadyPublished):
        P.publish(spark.range(9), path, "a")
    P.publish(spark.range(5), path, "a", overwrite=True)
    assert first.count() == 3 and P.read_published(spark, path, "a").count() == 5
    P.publish(spark.range(2), path, "odd/name %", "json")
    assert P.published(spark, path) == ["a", "odd/name %"] and P.read_published(spark, path, "odd/name %").count() == 2


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    """Both have seen that nothing is published when they begin."""
    path, gate, done = f"{tmp_path}/store", threading.Barrier(2), []
    look = P._versions

    def both(*args):
        found = look(*args)
        gate.wait(60)
        return found
    monkeypatch.setattr(P, "_versions", both)

    def write(n):
        try:
            P.publish(spark.range(n), path, "x")
            done.append(n)
        except P.AlreadyPublished:
            done.append(None)
    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert done.count(None) == 1
    assert P.read_published(spark, path, "x").count() == next(n for n in done if n)


def test_runs_replace_only_themselves(spark, tmp_path):
    path = f"{tmp_path}/runs"
    for run, v in (("a", 1.0), ("b/2", 2.0), ("a", 3.0)):
        WR.write_metrics(spark.createDataFrame([(v,)], "v double"), path, run)
    assert {(r["run_id"], r["v"]) for r in WR.read_metrics(spark, path).collect()} == {("a", 3.0), ("b/2", 2.0)}


def test_embeddings_are_read_from_what_is_published(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "id int, embedding array<float>")
    WR.write_embeddings(df, f"{tmp_path}/e")
    assert sorted((r["id"], r["embedding"]) for r in RD.read_embeddings(spark, f"{tmp_path}/e").collect()) == [(1, [0.5, 1.0]), (2, None)]
    df.write.parquet(f"{tmp_path}/plain")
    assert RD.read_embeddings(spark, f"{tmp_path}/plain").count() == 2


def test_snapshots_keep_texts_with_line_ends_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc, d'), (2, "e\\")], "id int, text string")
    WR.snapshot_training_set(df, f"{tmp_path}/s", 0, 1)
    WR.snapshot_training_set(df.limit(1), f"{tmp_path}/s", 0, 1)
    WR.snapshot_training_set(df, f"{tmp_path}/s", 9, -1, final=True)
    got = WR.read_snapshot(spark, f"{tmp_path}/s", "final", "id int, text string")
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(1, 'a "b"\nc, d'), (2, "e\\")]
    assert WR.read_snapshot(spark, f"{tmp_path}/s", "iter_00000", "id int, text string").count() == 1


def _counting(folder):
    """Leaves a file for every prompt that it is asked."""
    def client(prompts):
        for p in prompts:
            with open(f"{folder}/{p.replace(' ', '-')}.{uuid.uuid4().hex}", "w"):
                pass
        return [{"label": 0.5, "text": p} for p in prompts]
    return client


def _asked(folder):
    names = sorted(p.name.rpartition(".")[0] for p in folder.iterdir())
    assert len(names) == len(set(names)), "a call was repeated"
    return names


def test_a_killed_generation_goes_on_without_repeating_calls(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def requests(stop):
        def make(i):
            if i == stop:
                raise KeyboardInterrupt
            return spark.range(4).select((F.col("id") + 4 * i).alias("id"), F.concat(F.lit(f"r{i} p"), F.col("id").cast("string")).alias("prompt"))
        return make

    how = {"client": _counting(str(calls)), "out_path": f"{tmp_path}/out", "response_schema": "label double, text string",
           "valid": lambda d: F.col("label").isNotNull(), "log": f"{tmp_path}/log"}
    for stop in (1, 3):
        with pytest.raises(KeyboardInterrupt):
            INF.generate_until(requests(stop), 16, **how)
    assert INF.generate_until(requests(None), 16, **how) == 16
    assert len(_asked(calls)) == 16 and spark.read.json(f"{tmp_path}/out").count() == 16
    assert INF.generate_until(requests(None), 16, **how) == 16 and len(_asked(calls)) == 16


def test_a_killed_feedback_loop_goes_on_with_its_pool(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def requests(stop):
        def make(i, pool):
            if i == stop:
                raise KeyboardInterrupt
            shots = 0 if pool is None else pool.count()
            return spark.range(3).select((F.col("id") + 3 * i).alias("id"), F.concat(F.lit(f"i{i} s{shots} p"), F.col("id").cast("string")).alias("prompt"))
        return make

    how = {"iterations": 3, "client": _counting(str(calls)), "response_schema": "label double, text string",
           "valid": lambda d: F.col("label").isNotNull(), "interval": 1, "refresh_pool": lambda t: t.orderBy("id").limit(2), "log": f"{tmp_path}/log"}
    with pytest.raises(KeyboardInterrupt):
        INF.feedback_loop(requests(2), **how)
    done = INF.feedback_loop(requests(None), **how)
    assert done.count() == 9 and [n[:5] for n in _asked(calls)] == ["i0-s0"] * 3 + ["i1-s2"] * 3 + ["i2-s2"] * 3


def test_embed_says_why(spark):
    def make():
        def client(texts):
            raise ValueError("full")
        return client
    r = INF.embed(spark.createDataFrame([(1, "x")], "id int, text string"), "text", make(), retries=0).first()
    assert r["embedding"] is None and r["error"] == "ValueError: full"
