"""Sampling queries: N1–N14, N16, A6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import sampling as S
from ..operators.binning import histogram, linspace_edges
from ..operators.common import scalar_of
from ..sources import fixtures as X
from .registry import query, rounded
from .sqlhelp import bin_lc, edge_values, gamma_ctes

SEED = 42
TWO52 = "CAST(4503599627370496 AS DOUBLE)"


def _hx(expr: str, digits: int = 15) -> str:
    return f"CAST(('0x' || substr({expr}, 1, {digits})) AS BIGINT)"


@query("sample_n", ops="N1 N5", sql=f"""
SELECT id, p, y FROM soft_binary ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id
LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM soft_binary)""")
def sample_n(spark, sf_dir):
    """A quarter of the rows (n = int(N * .25), as the ratio sizes do)."""
    sb = X.soft_binary(spark, sf_dir)
    n = scalar_of(sb.agg(F.floor(F.count(F.lit(1)) * 0.25).cast("long").alias("n"))).getField("n")
    return S.sample_n(sb, n, SEED)


@query("auto_limit", ops="N2", sql=f"""
SELECT id FROM soft_vector ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id
LIMIT (SELECT least((SELECT count(*) FROM gold_text), (SELECT count(*) FROM soft_vector)))""")
def auto_limit(spark, sf_dir):
    return S.auto_limit(X.soft_vector(spark, sf_dir), X.gold_text(spark, sf_dir), SEED).select("id")


@query("undersample", ops="N4 W3 A6 U3", sql=f"""
SELECT id, y FROM (
  SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) AS rn
  FROM gold_text)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM gold_text GROUP BY y))""")
def undersample(spark, sf_dir):
    return S.undersample(X.gold_text(spark, sf_dir), "y", SEED).select("id", "y")


@query("undersample_big_class", ops="N4 (10 classes, hash-chunked)", sql=f"""
SELECT id, label FROM (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) AS rn
  FROM emb_labeled)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM emb_labeled GROUP BY label))""")
def undersample_big_class(spark, sf_dir):
    return S.undersample(X.emb_labeled(spark, sf_dir).select("id", "label"), "label", SEED)


@query("minority_count", ops="A6", sql="""
SELECT min(c) AS minority_count FROM (SELECT count(*) AS c FROM emb_labeled GROUP BY label)""")
def minority_count(spark, sf_dir):
    return S.minority_count(X.emb_labeled(spark, sf_dir), "label")


@query("bootstrap_weights", ops="N3 (with replacement)", sql=f"""
WITH idx AS (SELECT id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) - 1 AS pos FROM soft_binary),
draws AS (SELECT t.trial, j.j FROM range(0, 5) t(trial), range(0, 1000) j(j)),
h AS (SELECT trial, {_hx("md5(CAST(" + str(SEED) + " + trial AS VARCHAR) || ':' || CAST(j AS VARCHAR))")}
                    % (SELECT count(*) FROM soft_binary) AS pos FROM draws)
SELECT CAST(trial AS BIGINT) AS trial, id, count(*) AS weight FROM h JOIN idx USING (pos) GROUP BY trial, id""")
def bootstrap_weights(spark, sf_dir):
    return S.bootstrap_weights(X.soft_binary(spark, sf_dir), 1000, 5, SEED, replace=True)


@query("subsample_trials", ops="N3 (without replacement)", sql=f"""
SELECT CAST(trial AS BIGINT) AS trial, id, CAST(1 AS BIGINT) AS weight FROM (
  SELECT t.trial, s.id, row_number() OVER (PARTITION BY t.trial
           ORDER BY md5(CAST({SEED} + t.trial AS VARCHAR) || ':' || CAST(s.id AS VARCHAR)), s.id) AS rn
  FROM soft_binary s, range(0, 5) t(trial))
WHERE rn <= 1000""")
def subsample_trials(spark, sf_dir):
    return S.bootstrap_weights(X.soft_binary(spark, sf_dir), 1000, 5, SEED, replace=False)


@query("kfold_assign", ops="N13", sql=f"""
SELECT id, CAST((row_number() OVER (ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
FROM soft_binary""")
def kfold_assign(spark, sf_dir):
    return S.kfold(X.soft_binary(spark, sf_dir).select("id"), 5, 7)


@query("kfold_sizes", ops="N13", sql=f"""
SELECT fold, count(*) AS n FROM (
  SELECT CAST((row_number() OVER (ORDER BY md5('7:' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold
  FROM emb_labeled) GROUP BY fold""")
def kfold_sizes(spark, sf_dir):
    return S.kfold(X.emb_labeled(spark, sf_dir).select("id"), 5, 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


RATIOS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0]


@query("ratio_sizes", ops="N5", sql="\nUNION ALL\n".join(
    f"SELECT CAST({r} AS DOUBLE) AS ratio, CAST(floor(count(*) * CAST({r} AS DOUBLE)) AS BIGINT) AS size FROM soft_binary"
    for r in RATIOS))
def ratio_sizes(spark, sf_dir):
    return S.ratio_sizes(X.soft_binary(spark, sf_dir), RATIOS)


@query("hard_labels", ops="N6", sql=f"""
SELECT id, CAST({_hx(f"md5('{SEED}:' || CAST(id AS VARCHAR) || ':cls')")} % 6 AS INTEGER) AS cls FROM soft_binary""")
def hard_labels(spark, sf_dir):
    return X.soft_binary(spark, sf_dir).select("id", S.sample_hard_labels("id", 6, SEED).alias("cls"))


@query("soft_labels", ops="N7", sql=f"""
SELECT id, round_even(CAST({_hx(f"md5('{SEED}:' || CAST(id AS VARCHAR) || ':soft')", 13)} AS DOUBLE) / {TWO52}, 3) AS p
FROM soft_binary""")
def soft_labels(spark, sf_dir):
    return X.soft_binary(spark, sf_dir).select("id", S.sample_soft_labels("id", SEED).alias("p"))


@query("margin_uniform", ops="N9", sql=f"""
SELECT id, round(CASE WHEN y = 1 THEN 0.6 + u * 0.4 ELSE u * 0.4 END, 9) AS p FROM (
  SELECT id, y, CAST({_hx(f"md5('{SEED}:' || CAST(id AS VARCHAR) || ':margin')", 13)} AS DOUBLE) / {TWO52} AS u
  FROM soft_binary)""")
def margin_uniform(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    return rounded(sb.select("id", S.sample_margin_uniform("id", F.col("y") == 1, 0.1, SEED).alias("p")))


@query("intensity_uniform", ops="N11 (uniform)", sql=f"""
SELECT id, round(0.8 + CAST({_hx(f"md5('{SEED}:' || CAST(id AS VARCHAR) || ':int')", 13)} AS DOUBLE) / {TWO52} * 0.2, 9) AS intensity
FROM soft_binary""")
def intensity_uniform(spark, sf_dir):
    return rounded(S.sample_intensity(X.soft_binary(spark, sf_dir).select("id"), SEED))


_STREAMS = range(1, 7)
_PARTS = "SELECT id, stream - 1 AS k, g / sum(g) OVER (PARTITION BY id) AS v FROM gamma"
_STRATEGIES = "CASE CAST(floor(c.u * 5) AS INT) WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 5.0 END"


@query("dirichlet_moments", ops="N8", sql=f"""
WITH {gamma_ctes('texts', SEED, dict.fromkeys(_STREAMS, _STRATEGIES), choices=True)}
SELECT CAST(k AS INTEGER) AS k, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(*) AS n FROM ({_PARTS}) GROUP BY k""")
def dirichlet_moments(spark, sf_dir):
    d = S.sample_dirichlet(X.texts(spark, sf_dir).select("id"), 6, "mixed", SEED)
    ex = d.select(F.posexplode("label").alias("k", "v"))
    return rounded(ex.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                       F.count(F.lit(1)).alias("n")), 4)


@query("dirichlet_max_hist", ops="N16 N8 P19 A5", sql=f"""
WITH {gamma_ctes('texts', SEED, dict.fromkeys(_STREAMS, '0.3'))},
m AS (SELECT id, max(v) AS mx FROM ({_PARTS}) GROUP BY id),
b AS (SELECT {bin_lc('mx', linspace_edges(20))} AS bin FROM m),
spine(bin, lo, hi) AS (VALUES {edge_values(20)})
SELECT CAST(s.bin AS INTEGER) AS bin, lo AS bin_lo, hi AS bin_hi, count(b.bin) AS n FROM spine s LEFT JOIN b ON b.bin = s.bin GROUP BY ALL""")
def dirichlet_max_hist(spark, sf_dir):
    d = S.sample_dirichlet(X.texts(spark, sf_dir).select("id"), 6, 0.3, SEED)
    return histogram(d.withColumn("mx", L.max_prob("label")), "mx", linspace_edges(20))


@query("beta_moments", ops="N10 N11", sql=f"""
WITH {gamma_ctes('soft_binary', SEED, {101: "CASE WHEN i.y = 1 THEN 5.0 ELSE 1.5 END", 102: "CASE WHEN i.y = 1 THEN 1.5 ELSE 5.0 END", 103: "5.0", 104: "1.5"})},
w AS (SELECT id, max(g) FILTER (stream = 101) AS a, max(g) FILTER (stream = 102) AS b, max(g) FILTER (stream = 103) AS c,
  max(g) FILTER (stream = 104) AS d FROM gamma GROUP BY id),
s AS (SELECT y, CASE WHEN y = 1 THEN 0.6 + a / (a + b) * 0.4 ELSE a / (a + b) * 0.4 END AS b, c / (c + d) AS intensity FROM w JOIN soft_binary USING (id))
SELECT y, round(avg(b), 4) AS mean, round(min(b), 4) AS min, round(max(b), 4) AS max, round(avg(intensity), 4) AS mean_intensity, count(*) AS n
FROM s GROUP BY y""")
def beta_moments(spark, sf_dir):
    sb = S.sample_margin_beta(X.soft_binary(spark, sf_dir), "y", 0.1, SEED, out="b")
    sb = S.sample_intensity(sb, SEED, beta=True)
    return rounded(sb.groupBy("y").agg(F.avg("b").alias("mean"), F.min("b").alias("min"), F.max("b").alias("max"),
                                       F.avg("intensity").alias("mean_intensity"),
                                       F.count(F.lit(1)).alias("n")), 4)


@query("balanced_requests", ops="N12 (binary)", sql="""
SELECT run, label, CAST(CASE WHEN label = 1 THEN b // 2 ELSE b - b // 2 END AS BIGINT) AS n
FROM (SELECT run, count(*) AS b FROM texts GROUP BY run), (VALUES (0), (1)) l(label)""")
def balanced_requests(spark, sf_dir):
    batches = X.texts(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("b"))
    r = S.balanced_requests(batches, "b", 2, "binary", SEED, group_cols=["run"])
    return r.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))


@query("balanced_requests_hard", ops="N12 (multiclass hard)", sql=f"""
WITH b AS (SELECT run, count(*) AS b FROM texts GROUP BY run),
c AS (SELECT run, b, k.cls, CAST({_hx(f"md5('{SEED}:' || run || ':extra')")} % 3 AS INTEGER) AS extra FROM b, range(0, 3) k(cls))
SELECT run, CAST(cls AS INTEGER) AS label, CAST(b // 3 + CASE WHEN cls = extra THEN b % 3 ELSE 0 END AS BIGINT) AS n
FROM c WHERE b // 3 + CASE WHEN cls = extra THEN b % 3 ELSE 0 END > 0""")
def balanced_requests_hard(spark, sf_dir):
    batches = X.texts(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("b"))
    r = S.balanced_requests(batches, "b", 3, "hard", SEED, group_cols=["run"])
    return r.groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))


@query("few_shot_positions", ops="N14", sql=f"""
WITH pr AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS prompt_id FROM responses),
np AS (SELECT count(*) AS n FROM texts),
ch AS (SELECT prompt_id, list_reduce(range((SELECT n FROM np) - 3, (SELECT n FROM np)),
          lambda acc, j: list_append(acc, CASE WHEN list_contains(acc,
              {_hx("md5('" + str(SEED) + ":' || prompt_id || ':' || CAST(j AS VARCHAR))")} % (j + 1))
              THEN j ELSE {_hx("md5('" + str(SEED) + ":' || prompt_id || ':' || CAST(j AS VARCHAR))")} % (j + 1) END),
          CAST([] AS BIGINT[])) AS pos FROM pr)
SELECT prompt_id, CAST(s - 1 AS INTEGER) AS shot, pos[s] AS pos FROM ch, range(1, 4) r(s)""")
def few_shot_positions(spark, sf_dir):
    r = X.responses(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"),
                                                      F.col("turn").cast("string")).alias("prompt_id"))
    n = X.texts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    from ..operators.common import scalar_of
    return S.few_shot_positions(r, scalar_of(n).getField("n"), 3, SEED, "prompt_id")


@query("bootstrap_50_trials", ops="N3 at the reference's 50 trials (with replacement)", sql=f"""
WITH idx AS (SELECT id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) - 1 AS pos FROM soft_binary),
draws AS (SELECT t.trial, j.j FROM range(0, 50) t(trial), range(0, 2000) j(j)),
h AS (SELECT trial, {_hx("md5(CAST(" + str(SEED) + " + trial AS VARCHAR) || ':' || CAST(j AS VARCHAR))")}
                    % (SELECT count(*) FROM soft_binary) AS pos FROM draws)
SELECT CAST(trial AS BIGINT) AS trial, count(*) AS n_distinct, CAST(sum(w) AS BIGINT) AS total_weight, max(w) AS max_weight
FROM (SELECT trial, id, count(*) AS w FROM h JOIN idx USING (pos) GROUP BY trial, id) GROUP BY trial""")
def bootstrap_50_trials(spark, sf_dir):
    w = S.bootstrap_weights(X.soft_binary(spark, sf_dir), 2000, 50, SEED, replace=True)
    return w.groupBy("trial").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("weight").alias("total_weight"),
                                  F.max("weight").alias("max_weight"))
