"""Streaming ingest equals the batch computation on the same files; sinks."""

import os

import pytest
from pyspark.sql import functions as F

from softlab.session import scratch_path
from softlab.sources import readers as RD
from softlab.sources import writers as WR
from softlab.streaming import ingest as ST


def _write_lines(spark, lines, parts=3):
    d = scratch_path(spark, "t-stream-in")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts).write.text(d)
    return d


LINES = ['{"id": %d, "label": %s, "text": "t%d"}' % (i, l, i)
         for i, l in enumerate(["0.1", "0.5", "1.0", "1.5", "-0.2", "0.7"])] + \
        ['{"id": 99, "label": 0.3, "text": "   "}', '{"id": 100, "label": ']


def test_stream_equals_batch(spark):
    d = _write_lines(spark, LINES)
    out = scratch_path(spark, "t-stream-out")
    ST.stream_ingest(spark, d, out, scratch_path(spark, "t-ckpt"), "binary")
    streamed = sorted((r.id, r.label) for r in spark.read.parquet(f"{out}/valid").collect())
    batch = ST.validated(RD.read_generated(spark, d, "binary").withColumn("id", F.lit(None)), "binary")
    b2 = spark.read.schema(ST.RECORD_WITH_ID["binary"]).option("columnNameOfCorruptRecord", "_corrupt_record").json(d)
    batch = sorted((r.id, r.label) for r in ST.validated(b2, "binary").filter("status = 'valid'").collect())
    assert streamed == batch == [(0, 0.1), (1, 0.5), (2, 1.0), (5, 0.7)]
    rej = {r.status for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert rej == {"label_out_of_range", "blank_text", "corrupt"}


def test_progress_complete_mode(spark):
    d = _write_lines(spark, LINES)
    out = scratch_path(spark, "t-prog")
    ST.running_progress(spark, d, out, scratch_path(spark, "t-ckpt2"))
    got = {(r.status, r.bin): r.n for r in spark.read.parquet(out).collect()}
    assert got[("valid", 9)] == 1 and got[("valid", 5)] == 1 and got[("corrupt", None)] == 1


def test_write_embeddings_refuses_overwrite(spark):
    p = scratch_path(spark, "t-emb")
    df = spark.createDataFrame([(1, [0.1, 0.2])], "id int, embedding array<float>")
    WR.write_embeddings(df, p)
    with pytest.raises(Exception):
        WR.write_embeddings(df, p)
    WR.write_embeddings(df, p, overwrite=True)


def test_snapshot_schedule(spark):
    p = scratch_path(spark, "t-snap")
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    assert WR.snapshot_training_set(df, p, 0, 2)
    assert not WR.snapshot_training_set(df, p, 1, 2)
    assert not WR.snapshot_training_set(df, p, 4, -1)
    assert WR.snapshot_training_set(df, p, 5, -1, final=True)


def test_loader_registry():
    with pytest.raises(ValueError):
        RD.load_oracle("no-such-dataset")


def test_checkpoint_dir_respects_cluster_setting(spark):
    """A configured spark.checkpoint.dir is used as is (it cannot and must
    not be changed at runtime); scratch folders are created under it."""
    from softlab.session import checkpoint_dir
    conf = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if conf:
        assert d == conf
    assert spark.sparkContext.getCheckpointDir() is not None
    base = d[len("file:"):] if d.startswith("file:") else d
    assert scratch_path(spark, "x").startswith(base)
    assert spark.range(3).checkpoint(eager=True).count() == 3
