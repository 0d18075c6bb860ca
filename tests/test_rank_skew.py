"""Chunks of ranks follow the data, wherever scores lie."""
import pytest
from pyspark.sql import functions as F

from softlab.operators import agreement as A
from softlab.operators import metrics as M
from softlab.operators.ranking import by_range

N = 20_000


@pytest.mark.parametrize("score", ["id * 1e-12", "id * 50.0 - 3e5", "pow(id, 3.0)", "1 - id * 1e-13", "CASE WHEN id > 500 THEN 1.0 ELSE id / 1e9 END"])
def test_no_chunk_holds_much_more_than_its_share(spark, score):
    g = spark.range(N).select(F.expr(f"CAST({score} AS DOUBLE)").alias("score")).distinct()
    dealt = by_range(g, ["score"], "c")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.groupBy("c").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count("*").alias("n")).orderBy("c").collect()
    total = sum(r["n"] for r in rows)
    assert total == g.count() and max(r["n"] for r in rows) <= 4 * max(1, total / n)
    assert all(p["b"] < q["a"] for p, q in zip(rows, rows[1:]))


def test_auc_of_squeezed_scores_equals_that_of_their_ranks(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2000).alias("k"), (F.xxhash64("id") % 3 == 0).cast("int").alias("y"))
    got = [M.auc_ap_table(df.withColumn("s", F.expr(e)), "y", "s").first() for e in ("k / 2000.0", "k * 1e-15", "k * 1e9 - 7e11")]
    assert got[0]["roc_auc"] == pytest.approx(got[1]["roc_auc"]) == pytest.approx(got[2]["roc_auc"])


def test_spearman_with_heavy_ties_equals_pandas(spark):
    df = spark.range(3000).select(F.expr("CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 17 END AS DOUBLE)").alias("p"),
                                  F.expr("CAST(CASE WHEN id % 5 = 0 THEN NULL ELSE id % 13 * (id % 3) END AS DOUBLE)").alias("q"))
    got = A.spearman(df, "p", "q").first()
    pdf = df.toPandas().dropna()
    assert got["n"] == len(pdf)
    assert got["spearman_r"] == pytest.approx(pdf["p"].rank().corr(pdf["q"].rank()))
