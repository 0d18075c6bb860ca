"""Exact oracles for operators that were only checked by rows: U2, S5, F10
(vector), F15, F16 (max probability), N3 (Poisson), N12 (soft scores), N15,
A26 at 100x, A36, M5, M19 (blend), M22."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as E
from ..operators import filters as Fi
from ..operators import influence as I
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import refine as RF
from ..operators import reshape as RS
from ..operators import sampling as S
from ..operators import similarity as SIM
from ..session import scratch_path
from ..sources import datasets as DS
from ..sources import fixtures as X
from ..sources import readers as RD
from .q_sampling import SEED, TWO52, _hx
from .q_similarity import _replicated
from .registry import query, rounded
from .sqlhelp import gamma_ctes

TIMES = 100


@query("intra_inter_cosine_x100", ops="A26 at 100x replication (closed form of the un-replicated sums)", sql=f"""
WITH u AS (SELECT id, label, sqrt(list_dot_product(embedding, embedding)) AS len, embedding FROM emb_labeled),
e AS (SELECT label, unnest(embedding) / CASE WHEN len > 0 THEN len ELSE 1 END AS x,
             generate_subscripts(embedding, 1) AS i FROM u),
s AS (SELECT label, i, {TIMES} * sum(x) AS s FROM e GROUP BY 1, 2),
c AS (SELECT label, CAST({TIMES} * count(*) AS DOUBLE) AS n, {TIMES} * count(*) FILTER (len > 0) AS q FROM u GROUP BY 1),
per AS (SELECT label, sum(s * s) AS s2 FROM s GROUP BY 1),
intra AS (SELECT sum((s2 - q) / 2) AS su, sum(n * (n - 1) / 2) AS pa FROM per JOIN c USING (label)),
whole AS (SELECT (SELECT sum(t * t) FROM (SELECT sum(s) AS t FROM s GROUP BY i)) AS s2, sum(q) AS q, sum(n) AS n FROM c),
t AS (SELECT (s2 - q) / 2 AS su, n * (n - 1) / 2 AS pa, n FROM whole)
SELECT CAST(t.n AS BIGINT) AS n, (SELECT count(*) FROM c) AS n_classes,
       round((t.su - intra.su) / (t.pa - intra.pa), 9) AS inter, round(intra.su / intra.pa, 9) AS intra,
       round(t.su / t.pa, 9) AS average FROM t, intra""")
def intra_inter_cosine_x100(spark, sf_dir):
    return rounded(SIM.cosine_by_class(_replicated(spark, sf_dir, TIMES), "embedding", "label"))


@query("bootstrap_poisson", ops="N3 fast mode (approximate size)", sql=f"""
SELECT * FROM (WITH RECURSIVE n AS (SELECT 1000.0::DOUBLE / count(*)::DOUBLE AS lam FROM soft_binary),
cdf AS (SELECT 0 AS k, exp(-lam) AS term, exp(-lam) AS c, lam FROM n
        UNION ALL SELECT k + 1, term * lam / (k + 1)::DOUBLE, c + term * lam / (k + 1)::DOUBLE, lam FROM cdf WHERE k < 40),
u AS (SELECT t.trial, id, CAST({_hx(f"md5(CAST({SEED} + t.trial AS VARCHAR) || ':' || CAST(id AS VARCHAR) || ':poisson')", 13)} AS DOUBLE) / {TWO52} AS u
      FROM soft_binary, range(0, 5) t(trial)),
w AS (SELECT trial, id, count(*) AS w FROM u JOIN cdf ON u > c GROUP BY 1, 2)
SELECT CAST(trial AS BIGINT) AS trial, CAST(sum(w) AS BIGINT) AS total_weight, count(*) AS n_rows, max(w) AS max_weight
FROM w GROUP BY 1)""")
def bootstrap_poisson(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    w = S.bootstrap_poisson(sb.select("id"), 1000, 5, SEED, sb.count())
    return w.groupBy("trial").agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("n_rows"),
                                  F.max("weight").alias("max_weight"))


@query("trial_summary", ops="A36", sql="""
SELECT CAST(CASE WHEN id % 7 = 6 AND id >= 7 THEN 7 ELSE id % 7 END AS BIGINT) AS setting, count(*) AS n_trials, round(avg(m), 9) AS m_mean, round(stddev_samp(m), 9) AS m_std
FROM (SELECT id, CASE WHEN id % 7 = 3 OR id % 5 = 0 THEN NULL ELSE p END AS m FROM soft_binary)
GROUP BY 1""")
def trial_summary(spark, sf_dir):
    """NaN trials are left out; a setting of NaN only and one of a single trial are among the rows."""
    sb = X.soft_binary(spark, sf_dir)
    setting = F.when((F.col("id") % 7 == 6) & (F.col("id") >= 7), F.lit(7)).otherwise(F.col("id") % 7)
    m = F.when((F.col("id") % 7 == 3) | (F.col("id") % 5 == 0), F.lit(float("nan"))).otherwise(F.col("p"))
    return rounded(E.trial_summary(sb.select(setting.cast("long").alias("setting"), m.alias("m")), ["setting"], ["m"]))


@query("gce_loss", ops="M5", sql="""
SELECT id, round(list_sum(list_transform(list_zip(label, judged), lambda z:
         z[1] * (1 - pow(greatest(1e-12, least(1.0, z[2])), 0.7)) / 0.7)), 9) AS loss FROM judged_vector""")
def gce_loss(spark, sf_dir):
    return rounded(X.judged_vector(spark, sf_dir).select("id", MD.gce_loss("label", "judged", 0.7).alias("loss")))


@query("reverse_cross_entropy", ops="M22", sql="""
SELECT id, round(-list_sum(list_transform(list_zip(judged, label), lambda z:
         z[1] * ln(greatest(1e-7, least(1.0, z[2]))))), 9) AS rce FROM judged_vector""")
def reverse_cross_entropy(spark, sf_dir):
    return rounded(X.judged_vector(spark, sf_dir).select("id", I.reverse_cross_entropy("judged", "label").alias("rce")))


@query("refine_blend", ops="M19 (the blend of ambiguous rows)", sql="""
SELECT id, round(CASE WHEN p > 0.3 AND p < 0.7 THEN least(greatest(0.9 * p + (1.0 - 0.9) * q, 0.0), 1.0) ELSE p END, 9) AS p
FROM judged_binary""")
def refine_blend(spark, sf_dir):
    p = F.col("p")
    amb = (p > 0.3) & (p < 0.7)
    jb = X.judged_binary(spark, sf_dir)
    return rounded(jb.select("id", F.when(amb, RF.blend(p, F.col("q"), 0.9)).otherwise(p).alias("p")))


@query("title_content_roundtrip", ops="S5 S8 P3", sql="""
SELECT doc_id AS id, length(coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, '') || ' '
       || coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, '')) AS n_chars,
       md5(coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, '') || ' '
       || coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, '')) AS digest FROM documents""")
def title_content_roundtrip(spark, sf_dir):
    """The id travels in the label vector, as the record has no other field."""
    d = X.table(spark, sf_dir, "documents")
    rec = d.select(F.when(d["doc_id"] % 3 != 0, d["source"]).alias("title"), F.when(d["doc_id"] % 5 != 0, d["text"]).alias("content"),
                   F.array(d["doc_id"].cast("double")).alias("label"))
    path = scratch_path(spark, "title-content")
    rec.write.json(path)
    back = RD.read_title_content(spark, path)
    return back.select(F.col("label")[0].cast("long").alias("id"), F.length("text").cast("long").alias("n_chars"),
                       F.md5("text").alias("digest"))


@query("append_batches", ops="U2", sql="""
SELECT 'a' AS batch, id, p, NULL AS y FROM soft_binary WHERE y = 0
UNION ALL SELECT 'b', id, NULL, y FROM soft_binary WHERE y = 1""")
def append_batches(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    a = sb.filter("y = 0").select(F.lit("a").alias("batch"), "id", "p")
    b = sb.filter("y = 1").select(F.lit("b").alias("batch"), "id", "y")
    return RS.append_batch(a, b)


@query("feedback_gate", ops="N15", sql=f"""
SELECT id, CAST({_hx(f"md5('{SEED}:' || CAST(id AS VARCHAR) || ':gate')", 13)} AS DOUBLE) / {TWO52} < 0.3 AS used FROM soft_binary""")
def feedback_gate(spark, sf_dir):
    return X.soft_binary(spark, sf_dir).select("id", S.feedback_gate("id", 0.3, SEED).alias("used"))


@query("finite_scores", ops="F15", sql="SELECT id, p FROM soft_binary WHERE id % 4 NOT IN (0, 1, 2) ")
def finite_scores(spark, sf_dir):
    """Null, NaN and infinite scores of three rows in four go."""
    sb = X.soft_binary(spark, sf_dir)
    r = F.col("id") % 4
    s = F.when(r == 0, F.lit(None)).when(r == 1, F.lit(float("nan"))).when(r == 2, F.lit(float("-inf"))).otherwise(F.col("p"))
    return sb.withColumn("s", s.cast("double")).filter(Fi.is_finite("s")).select("id", F.col("s").alias("p"))


@query("numeric_vectors", ops="F10 (vector)", sql="""
SELECT id FROM judged_vector WHERE id % 3 <> 0 AND id % 5 <> 0""")
def numeric_vectors(spark, sf_dir):
    """A short vector and one with a null are not judgements."""
    v = F.col("judged")
    odd = (F.when(F.col("id") % 3 == 0, F.slice(v, 1, 5)).when(F.col("id") % 5 == 0, F.array_append(F.slice(v, 1, 5), F.lit(None)))
           .otherwise(v))
    jv = X.judged_vector(spark, sf_dir).withColumn("judge_score", odd)
    return Fi.numeric_judgement(jv, "judge_score", X.K_VECTOR).select("id")


@query("requests_soft_binary", ops="N12 (binary scores) N9", sql=f"""
WITH b AS (SELECT run, count(*) AS b FROM texts GROUP BY run),
s AS (SELECT run, b, slot, CAST({_hx(f"md5('{SEED}:' || run || '|' || CAST(slot AS VARCHAR) || ':margin')", 13)} AS DOUBLE) / {TWO52} AS u
      FROM b, range(0, 100000) r(slot) WHERE slot < b)
SELECT run, CAST(slot AS BIGINT) AS slot, round(CASE WHEN slot < b // 2 THEN 0.7 + u * 0.3 ELSE u * 0.3 END, 9) AS label FROM s""")
def requests_soft_binary(spark, sf_dir):
    batches = X.texts(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("b"))
    return rounded(S.balanced_requests(batches, "b", 2, "soft_binary", SEED, ["run"], margin=0.2)
                   .select("run", F.col("slot").cast("long").alias("slot"), "label"))


@query("dirichlet_requests", ops="N12 (soft) N8", sql=f"""
WITH b AS (SELECT run, count(*) AS b FROM texts GROUP BY run),
slots AS (SELECT run, slot FROM b, range(0, (SELECT max(b) FROM b)) s(slot) WHERE slot < b),
rid AS (SELECT CAST(('0x' || substr(md5('{SEED}:' || run || '|' || CAST(slot AS VARCHAR)), 1, 15)) AS BIGINT) AS id FROM slots),
{gamma_ctes('rid', SEED, dict.fromkeys(range(1, 7), '0.5'))}
SELECT CAST(k AS INTEGER) AS k, round(avg(v), 4) AS mean, count(*) AS n
FROM (SELECT id, stream - 1 AS k, g / sum(g) OVER (PARTITION BY id) AS v FROM gamma) GROUP BY k""")
def dirichlet_requests(spark, sf_dir):
    batches = X.texts(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("b"))
    r = S.balanced_requests(batches, "b", 6, "soft", SEED, ["run"], alpha="slightly spiky")
    return rounded(r.select("run", F.posexplode("label").alias("k", "v")).groupBy("k")
                   .agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")), 4)


def _ids_by_line():
    return "SELECT doc_id AS row_id, CAST(doc_id AS DOUBLE) / 1e6 AS label, length(text) AS n_chars FROM documents"


@query("jsonl_row_ids", ops="S2 S8 J1 (ids by line position)", sql=_ids_by_line())
def jsonl_row_ids(spark, sf_dir):
    """Lines written in id order get the ids 0, 1, ... back, however the scan is split."""
    d = X.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "row-ids")
    (d.orderBy("doc_id").select((F.col("doc_id").cast("double") / F.lit(1e6)).alias("label"), "text",
                                F.lit(None).cast("string").alias("reasoning")).write.json(path))
    back = RD.read_generated(spark, path, "binary", with_row_id=True)
    return back.select("row_id", "label", F.length("text").cast("long").alias("n_chars"))


@query("evaluate_registry_threshold", ops="X4 A38 (binary, threshold)", sql="""
WITH c AS (SELECT sum(CAST(p >= 0.7 AND y = 1 AS INT)) AS tp, sum(CAST(p >= 0.7 AS INT)) AS pp, sum(y) AS pos,
                  avg(CAST((p >= 0.7) = (y = 1) AS DOUBLE)) AS acc FROM soft_binary)
SELECT round(acc, 9) AS accuracy, round(tp / CAST(pp AS DOUBLE), 9) AS precision, round(tp / CAST(pos AS DOUBLE), 9) AS recall,
       round(2 * tp / CAST(pp + pos AS DOUBLE), 9) AS f1_score FROM c""")
def evaluate_registry_threshold(spark, sf_dir):
    return rounded(M.evaluate(X.soft_binary(spark, sf_dir), "y", "p", ["accuracy", "precision", "recall", "f1_score"],
                              kind="binary", threshold=0.7))


@query("load_sst", ops="S4 F9 P1 U1", sql="""
SELECT CASE WHEN id % 10 = 0 THEN 'test' WHEN id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
       CAST(p > 0.5 AS INTEGER) AS labels, count(*) AS n FROM soft_binary WHERE id % 13 <> 0 GROUP BY 1, 2""")
def load_sst(spark, sf_dir):
    """Events as sentences of three split files, some unlabelled (-1)."""
    root = scratch_path(spark, "sst")
    sb = X.soft_binary(spark, sf_dir).select(
        F.concat(F.lit("event "), F.col("id").cast("string")).alias("sentence"),
        F.when(F.col("id") % 13 == 0, F.lit(-1.0)).otherwise(F.col("p")).alias("label"),
        F.lit("t").alias("tokens"), F.lit("t").alias("tree"), "id")
    for split, rule in (("test", "id % 10 = 0"), ("validation", "id % 10 = 1"), ("train", "id % 10 > 1")):
        sb.filter(rule).drop("id").write.parquet(f"{root}/{split}.parquet")
    return DS.load_oracle("sst", spark, root).groupBy("split", "labels").agg(F.count("text").alias("n"))


@query("load_emotion", ops="S4 U1 N4", sql="""
WITH t AS (SELECT id, y % 6 AS labels FROM soft_vector)
SELECT 'test' AS split, CAST(labels AS INTEGER) AS labels, count(*) AS n FROM t WHERE id % 4 = 0 GROUP BY 2
UNION ALL SELECT 'train', CAST(labels AS INTEGER), (SELECT min(n) FROM (SELECT count(*) AS n FROM t WHERE id % 4 <> 0 GROUP BY labels))
FROM t WHERE id % 4 <> 0 GROUP BY 2""")
def load_emotion(spark, sf_dir):
    """Unsplit rows for training, cut to the smallest class; the three split files are the test set."""
    root = scratch_path(spark, "emotion")
    d = X.soft_vector(spark, sf_dir).select(F.concat(F.lit("document "), F.col("id").cast("string")).alias("text"), F.col("y").alias("label"), "id")
    for split, rule in (("train", "id % 12 = 0"), ("validation", "id % 12 = 4"), ("test", "id % 12 = 8"), ("unsplit", "id % 4 <> 0")):
        d.filter(rule).drop("id").write.parquet(f"{root}/{split}.parquet")
    return DS.load_oracle("emotion", spark, root, undersample=True).groupBy("split", "labels").agg(F.count("text").alias("n"))


@query("load_yahoo", ops="S4 S5 J4 P4", sql="""
WITH d AS (SELECT v.id, y, length(coalesce(CASE WHEN v.id % 3 > 0 THEN source END, '') || ' ' || coalesce(CASE WHEN v.id % 4 > 0 THEN text END, '')) AS c
           FROM soft_vector v JOIN documents ON doc_id = v.id)
SELECT 'test' AS split, CAST(y AS INTEGER) AS labels, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM d WHERE id % 5 = 0 GROUP BY 2
UNION ALL SELECT 'train', CAST(y AS INTEGER), count(*), CAST(sum(c) AS BIGINT)
FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM d WHERE id % 5 <> 0) WHERE pos % 3 = 0 GROUP BY 2""")
def load_yahoo(spark, sf_dir):
    """Training rows by listed position; some titles and contents are null."""
    root = scratch_path(spark, "yahoo")
    d = X.soft_vector(spark, sf_dir).join(X.texts(spark, sf_dir).select("id", "run", "text"), "id")
    d = d.select(F.when(F.col("id") % 3 > 0, F.col("run")).alias("question_title"), F.when(F.col("id") % 4 > 0, F.col("text")).alias("question_content"),
                 (F.col("y") + 1).alias("class_index"), "id")
    train = d.filter("id % 5 <> 0")
    train.orderBy("id").drop("id").write.parquet(f"{root}/train.parquet")
    d.filter("id % 5 = 0").drop("id").write.parquet(f"{root}/test.parquet")
    spark.range(0, train.count(), 3).select(F.col("id").cast("string").alias("value")).write.text(f"{root}/subsample_idx.txt")
    return DS.load_oracle("yahoo", spark, root).groupBy("split", "labels").agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("load_generated_agnews", ops="S4 S2 F8 P9 P11", sql="""
SELECT md5(text) AS digest, CAST(list_position(label, list_max(label)) - 1 AS INTEGER) AS labels, round(label[1] / (label[1] + label[2] + label[3] + label[4]), 9) AS first_soft
FROM (SELECT id, label[1:4] AS label, text FROM soft_vector JOIN texts USING (id))
WHERE id % 7 <> 0 AND id % 11 <> 0 AND regexp_matches(coalesce(text, ''), '\\S')""")
def load_generated_agnews(spark, sf_dir):
    """Vectors of four, some short, and some blank texts, as JSON lines."""
    root = scratch_path(spark, "agnews")
    d = X.soft_vector(spark, sf_dir).join(X.texts(spark, sf_dir).select("id", "text"), "id")
    size = F.when(F.col("id") % 7 == 0, F.lit(3)).otherwise(F.lit(4))
    text = F.when(F.col("id") % 11 == 0, F.lit(" \t ")).otherwise(F.col("text"))
    d.select(F.slice("label", F.lit(1), size).alias("label"), text.alias("text"), F.lit("r").alias("reasoning")).write.json(f"{root}/data.jsonl")
    out = DS.load_synthetic("agnews", spark, root)
    return rounded(out.select(F.md5("text").alias("digest"), "labels", F.col("soft_labels")[0].alias("first_soft")))
