"""Join / alignment / reshape queries: J1–J4, J6, U1–U5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as Fi
from ..operators import reshape as RS
from ..operators.similarity import norm2
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import dbl

MARGINS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


@query("align_embeddings", ops="J1", sql="""
SELECT e.vec_id AS id, CAST(e.label AS INTEGER) AS label, CAST(len(f.embedding) AS INTEGER) AS n_dims,
       round(sqrt(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[]))), 9) AS norm
FROM embeddings e JOIN embeddings f ON e.vec_id = f.vec_id""")
def align_embeddings(spark, sf_dir):
    from ..sources.readers import read_embeddings
    emb = X.spread(read_embeddings(spark, f"{sf_dir}/embeddings.parquet"), ["vec_id"])
    labels = emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))
    feats = emb.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    a = RS.align_embeddings(labels, feats, "id")
    return rounded(a.select("id", "label", F.size("embedding").alias("n_dims"),
                            F.sqrt(norm2("embedding")).alias("norm")))


@query("select_by_index", ops="J4", sql="""
SELECT i.pos, t.id, t.cls FROM idx_list i JOIN texts t ON t.id = i.idx""")
def select_by_index(spark, sf_dir):
    t = X.texts(spark, sf_dir).select("id", "cls")
    return RS.select_by_index(t, X.idx_list(spark, sf_dir), "id").select("pos", "id", "cls")


@query("pair_prompt_response", ops="J2", sql="""
SELECT conv_id, turn, CAST(length(prompt) AS INTEGER) AS prompt_chars, CAST(length(response) AS INTEGER) AS response_chars
FROM responses
WHERE response IS NOT NULL AND regexp_matches(response, '[^\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')""")
def pair_prompt_response(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    prompts = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answers = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    p = RS.pair_prompt_response(prompts, answers, ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.length("prompt").alias("prompt_chars"),
                    F.length("response").alias("response_chars"))


@query("pair_labels", ops="J3", sql="""
SELECT id, round(p, 9) AS p, round(q, 9) AS q FROM judged_binary""")
def pair_labels(spark, sf_dir):
    jb = X.judged_binary(spark, sf_dir)
    return rounded(RS.pair_labels(jb.select("id", "p"), jb.select("id", "q"), "id"))


@query("union_splits", ops="U1 U2", sql="""
SELECT split, count(*) AS n, count(DISTINCT id) AS n_ids FROM (
  SELECT id, CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < '3' THEN 'test'
                  WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < '5' THEN 'validation' ELSE 'train' END AS split
  FROM soft_binary) GROUP BY split""")
def union_splits(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    h = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    parts = {"train": sb.filter(h >= "5"), "validation": sb.filter((h >= "3") & (h < "5")),
             "test": sb.filter(h < "3")}
    u = RS.union_splits(parts)
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"))


def _wide(spark, sf_dir):
    """Per class y: count kept at every inclusive margin, one column each;
    columns come out as MARGIN_mXXX and are renamed by prefix (P28)."""
    sb = X.soft_binary(spark, sf_dir)
    w = sb.groupBy("y").agg(*[F.count_if(Fi.margin_inclusive("p", m)).alias(f"MARGIN_m{round(m * 100):03d}")
                              for m in MARGINS])
    return RS.rename_by_regex(w.withColumnRenamed("y", "Y"), "MARGIN_")


_WIDE_SQL = "SELECT y, " + ", ".join(
    f"count(*) FILTER (WHERE p <= {dbl(0.5 - m)} OR p >= {dbl(0.5 + m)}) AS m{round(m * 100):03d}" for m in MARGINS
) + " FROM soft_binary GROUP BY y"


@query("unpivot_results", ops="U4 P28", sql=f"""
UNPIVOT ({_WIDE_SQL}) ON {', '.join(f'm{round(m * 100):03d}' for m in MARGINS)} INTO NAME margin VALUE n""")
def unpivot_results(spark, sf_dir):
    w = _wide(spark, sf_dir)
    return RS.unpivot(w, ["y"], [f"m{round(m * 100):03d}" for m in MARGINS], "margin", "n")


@query("best_margin", ops="U5", sql=f"""
WITH long AS (UNPIVOT ({_WIDE_SQL}) ON {', '.join(f'm{round(m * 100):03d}' for m in MARGINS)} INTO NAME margin VALUE n),
l2 AS (SELECT y, CAST(substr(margin, 2) AS INTEGER) / 100.0 AS m, n FROM long)
SELECT y, arg_max(m, n * 1000 - m * 100) AS best_m, max(n) AS best_n FROM l2 GROUP BY y""")
def best_margin(spark, sf_dir):
    w = _wide(spark, sf_dir)
    long = RS.unpivot(w, ["y"], [f"m{round(m * 100):03d}" for m in MARGINS], "margin", "n") \
        .withColumn("m", F.substring("margin", 2, 10).cast("int") / 100.0)
    b = RS.pivot_best(long, ["y"], "m", "n", MARGINS)
    return b.select("y", "best_m", "best_n")


@query("experiment_grid", ops="J6", sql="""
SELECT count(*) AS n_cells, count(DISTINCT margin) AS n_margins, count(DISTINCT trial) AS n_trials
FROM (SELECT DISTINCT y FROM soft_binary), (VALUES (0.0), (0.1), (0.2)) a(margin),
     (VALUES (0.1), (1.0)) b(ratio), range(0, 3) c(trial)""")
def experiment_grid(spark, sf_dir):
    base = X.soft_binary(spark, sf_dir).select("y").distinct()
    g = RS.experiment_grid(base, margin=[0.0, 0.1, 0.2], ratio=[0.1, 1.0], trial=[0, 1, 2])
    return g.agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("margin").alias("n_margins"),
                 F.countDistinct("trial").alias("n_trials"))
