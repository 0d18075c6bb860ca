"""Readers: title+content null rule, run sweeps with plain folder names,
row ids, labelled CSV mapping."""

from pyspark.sql import functions as F

from softlab.session import scratch_path
from softlab.sources import readers as RD


def _write(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_title_content_keeps_space(spark):
    p = scratch_path(spark, "t-yahoo")
    _write(spark, p, ['{"title": "A", "content": null, "label": [0.5, 0.5]}',
                      '{"title": null, "content": "B", "label": [1.0, 0.0]}'])
    got = sorted(r.text for r in RD.read_title_content(spark, p).collect())
    assert got == [" B", "A "]


def test_run_sweep_plain_folders(spark):
    root = scratch_path(spark, "t-sweep")
    _write(spark, f"{root}/alpha_0.1", ['{"label": 0.2, "text": "x"}', '{"label": 0.4, "text": "y"}'])
    _write(spark, f"{root}/mixed", ['{"label": 0.9, "text": "z"}'])
    got = {r.setting: r.n for r in RD.read_run_sweep(spark, root).groupBy("setting")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"alpha_0.1": 2, "mixed": 1}


def test_row_ids_unique(spark):
    p = scratch_path(spark, "t-rowid")
    spark.range(500).select(F.to_json(F.struct(F.lit(0.5).alias("label"), F.col("id").cast("string").alias("text")))
                            .alias("value")).repartition(4).write.text(p)
    df = RD.read_generated(spark, p, "binary", with_row_id=True)
    assert df.select("row_id").distinct().count() == 500


def test_labeled_csv_unmapped_is_null(spark):
    p = scratch_path(spark, "t-csv")
    spark.createDataFrame([("good film", "positive"), ("bad", "negative"), ("meh", "neutral")],
                          "review string, sentiment string").coalesce(1).write.option("header", True).csv(p)
    got = {r.text: r.labels for r in RD.read_labeled_csv(spark, {"train": p}, "review", "sentiment",
                                                         {"negative": 0, "positive": 1}).collect()}
    assert got == {"good film": 1, "bad": 0, "meh": None}
