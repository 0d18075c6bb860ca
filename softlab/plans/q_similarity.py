"""Embedding similarity queries.

The oracle is the naive i<j self-join the operator avoids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from ..sources import fixtures as X
from .registry import query, rounded

_COS = """CASE WHEN list_dot_product(a.embedding, a.embedding) > 0 AND list_dot_product(b.embedding, b.embedding) > 0
          THEN list_dot_product(a.embedding, b.embedding)
               / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding)))
          ELSE 0.0 END"""

# soft label per embedding: one of 16 float levels derived from the id hash
_SOFT_SQL = "CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 1)) AS INTEGER) / 15.0"


def _soft(spark, sf_dir):
    e = X.emb_labeled(spark, sf_dir)
    return e.withColumn("soft", F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 1), 16, 10)
                        .cast("int") / 15.0)


@query("mean_cosine", ops="A25", sql=f"""
SELECT (SELECT count(*) FROM emb_labeled) AS n, round(avg({_COS}), 9) AS mean_cosine
FROM emb_labeled a JOIN emb_labeled b ON a.id < b.id""")
def mean_cosine(spark, sf_dir):
    return rounded(S.mean_pairwise_cosine(X.emb_labeled(spark, sf_dir)))


def _by_class_sql(src: str, cls: str) -> str:
    return f"""
WITH p AS (SELECT a.{cls} = b.{cls} AS same, {_COS} AS cos FROM {src} a JOIN {src} b ON a.id < b.id)
SELECT (SELECT count(*) FROM {src}) AS n, (SELECT count(DISTINCT {cls}) FROM {src}) AS n_classes,
       round(coalesce(avg(cos) FILTER (WHERE NOT same), 0.0), 9) AS inter,
       round(coalesce(avg(cos) FILTER (WHERE same), 0.0), 9) AS intra,
       round(avg(cos), 9) AS average
FROM p"""


@query("intra_inter_cosine", ops="A26 J8", sql=_by_class_sql("emb_labeled", "label"))
def intra_inter_cosine(spark, sf_dir):
    return rounded(S.cosine_by_class(X.emb_labeled(spark, sf_dir), "embedding", "label"))


@query("soft_label_as_class_cosine", ops="A26 (float label = class)",
       sql=_by_class_sql(f"(SELECT *, {_SOFT_SQL} AS soft FROM emb_labeled)", "soft"))
def soft_label_as_class_cosine(spark, sf_dir):
    return rounded(S.cosine_by_class(_soft(spark, sf_dir), "embedding", "soft"))


@query("multilabel_cosine", ops="A27", sql=f"""
WITH p AS (SELECT (a.quality * b.quality + a.toxic * b.toxic) > 0 AS same, {_COS} AS cos
           FROM emb_multilabel a JOIN emb_multilabel b ON a.id < b.id)
SELECT (SELECT count(*) FROM emb_multilabel) AS n,
       round(coalesce(avg(cos) FILTER (WHERE NOT same), 0.0), 9) AS inter,
       round(coalesce(avg(cos) FILTER (WHERE same), 0.0), 9) AS intra
FROM p""")
def multilabel_cosine(spark, sf_dir):
    return rounded(S.cosine_multilabel(X.emb_multilabel(spark, sf_dir), "embedding", ["quality", "toxic"]))


@query("vector_alignment", ops="A33 P21 P22", sql="""
WITH r AS (SELECT list_dot_product(label, judged) / (sqrt(list_dot_product(label, label)) * sqrt(list_dot_product(judged, judged))) AS cos,
                  sqrt(list_sum(list_transform(list_zip(label, judged), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS l2
           FROM judged_vector)
SELECT count(*) AS n, round(avg(cos), 9) AS mean_cosine, round(stddev_pop(cos), 9) AS std_cosine,
       round(avg(l2), 9) AS mean_l2, round(stddev_pop(l2), 9) AS std_l2 FROM r""")
def vector_alignment(spark, sf_dir):
    from ..operators.agreement import vector_alignment as va
    return rounded(va(X.judged_vector(spark, sf_dir), "label", "judged"))


def _replicated(spark, sf_dir, times: int = 100):
    """emb_labeled replicated ``times`` over (derived from the table, so the
    work grows with it); copies keep their class and get distinct ids."""
    e = X.emb_labeled(spark, sf_dir)
    rep = e.select("id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_c"))
    return rep.select((F.col("id") * times + F.col("_c")).alias("id"), "embedding", "label")
