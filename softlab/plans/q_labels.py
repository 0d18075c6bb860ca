"""Label-algebra queries: P2, P4, P6–P20, P27."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources import fixtures as X
from .registry import query, rounded

K = X.K_VECTOR
# fixed values: class names of the six-class emotion corpus, in label order
EMOTION_NAMES = ["sadness", "joy", "love", "anger", "fear", "surprise"]
LANG_NAMES = ["en", "fr", "de"]


@query("hard_label_rules", ops="P6 P7 P8", sql="""
SELECT id, p, CAST(p > 0.5 AS INTEGER) AS strict_gt, CAST(round_even(p, 0) AS INTEGER) AS half_even,
       CAST(p >= 0.5 AS INTEGER) AS at_least FROM soft_binary""")
def hard_label_rules(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    return sb.select("id", "p", L.binarize_strict("p").alias("strict_gt"),
                     L.round_half_even("p").alias("half_even"), L.predict_at("p").alias("at_least"))


@query("argmax_label", ops="P9 P17 P18 P19", sql=f"""
SELECT id, CAST(list_position(label, list_max(label)) - 1 AS INTEGER) AS argmax,
       round(list_max(label), 9) AS max_prob,
       round(list_reverse_sort(label)[1] - list_reverse_sort(label)[2], 9) AS top_gap,
       round(-list_sum(list_transform(label, lambda x: x * ln(x + 1e-10))) / ln({K}), 9) AS entropy
FROM soft_vector""")
def argmax_label(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    return rounded(sv.select("id", L.argmax("label").alias("argmax"), L.max_prob("label").alias("max_prob"),
                             L.top_gap("label").alias("top_gap"), L.entropy_norm("label").alias("entropy")))


@query("normalize_vector", ops="P11 P20", sql="""
WITH s AS (SELECT id, list_transform(label, lambda x: x * x) AS sq FROM soft_vector),
n AS (SELECT id, list_transform(sq, lambda x: x / list_sum(sq)) AS nv,
             list_transform(sq, lambda x: exp(x - list_max(sq))) AS e FROM s)
SELECT id, CAST(k - 1 AS INTEGER) AS k, round(nv[k], 9) AS normalized,
       round(e[k] / (list_sum(e) + 1e-12), 9) AS softmax
FROM n, range(1, 7) r(k)""")
def normalize_vector(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir).select("id", F.transform("label", lambda x: x * x).alias("sq"))
    t = sv.select("id", L.normalize("sq").alias("nv"), L.softmax("sq").alias("sm"))
    return rounded(t.select("id", F.posexplode(F.arrays_zip("nv", "sm")).alias("k", "z"))
                   .select("id", F.col("k").cast("int").alias("k"), F.col("z.nv").alias("normalized"),
                           F.col("z.sm").alias("softmax")))


# A perturbed copy of the label exercises every validation rule; the case is
# chosen by the id hash (first hex digit).
def _perturbed_spark(sv):
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 1), 16, 10).cast("int")
    v = F.col("label")
    return sv.withColumn("v", F.when(h == 0, F.transform(v, lambda x, i: F.when(i == 0, x - F.lit(0.1)).otherwise(x)))
                         .when(h == 1, F.transform(v, lambda x, i: F.when(i == 0, F.lit(-1e-6)).otherwise(x)))
                         .when(h == 2, F.transform(v, lambda x: x * F.lit(1.001)))
                         .when(h == 3, F.transform(v, lambda x: x * F.lit(0.0)))
                         .when(h == 4, F.transform(v, lambda x: x * F.lit(1.000015)))
                         .otherwise(v))


_PERTURBED_SQL = """
(SELECT id, CASE h WHEN 0 THEN list_transform(label, lambda x, i: CASE WHEN i = 1 THEN x - 0.1 ELSE x END)
                   WHEN 1 THEN list_transform(label, lambda x, i: CASE WHEN i = 1 THEN -1e-6 ELSE x END)
                   WHEN 2 THEN list_transform(label, lambda x: x * 1.001)
                   WHEN 3 THEN list_transform(label, lambda x: x * 0.0)
                   WHEN 4 THEN list_transform(label, lambda x: x * 1.000015)
                   ELSE label END AS v
 FROM (SELECT *, CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 1)) AS INTEGER) AS h FROM soft_vector))"""


@query("validate_vector", ops="P12", sql=f"""
WITH c AS (SELECT id, v, list_transform(v, lambda x: least(greatest(x, 0.0), 1.0)) AS cl,
                  len(list_filter(v, lambda x: x < -1e-5 OR x > 1 + 1e-5)) > 0 AS bad,
                  len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 AS changed
           FROM {_PERTURBED_SQL}),
s AS (SELECT *, list_reduce(cl, lambda a, b: a + b) AS sm FROM c)
SELECT id,
       CASE WHEN bad THEN 'out_of_range' WHEN sm = 0 THEN 'zero_sum'
            WHEN abs(sm - 1.0) > 1e-5 THEN 'renormalised' WHEN changed THEN 'clipped' ELSE 'valid' END AS status,
       round(CASE WHEN bad OR sm = 0 THEN NULL
                  WHEN abs(sm - 1.0) > 1e-5 THEN list_reduce(list_transform(cl, lambda x: x / sm), lambda a, b: a + b)
                  ELSE sm END, 9) AS fixed_sum
FROM s""")
def validate_vector(spark, sf_dir):
    sv = _perturbed_spark(X.soft_vector(spark, sf_dir))
    fixed = L.validate_soft_label("v")
    return rounded(sv.select("id", L.validate_soft_label_status("v").alias("status"),
                             L.vsum(fixed).alias("fixed_sum")))


@query("one_hot", ops="P13", sql="""
SELECT id, CAST(k - 1 AS INTEGER) AS k,
       CAST(k - 1 = list_position(label, list_max(label)) - 1 AS DOUBLE) AS from_probs,
       CAST(k - 1 = y AS DOUBLE) AS from_index
FROM soft_vector, range(1, 7) r(k)""")
def one_hot(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    t = sv.select("id", L.probs_to_one_hot("label").alias("a"), L.one_hot("y", K).alias("b"))
    return t.select("id", F.posexplode(F.arrays_zip("a", "b")).alias("k", "z")).select(
        "id", F.col("k").cast("int").alias("k"), F.col("z.a").alias("from_probs"), F.col("z.b").alias("from_index"))


@query("round_format_parse", ops="P14", sql="""
SELECT id, array_to_string(list_transform(label, lambda x: printf('%.3f', round_even(x, 3))), ',') AS formatted,
       round(list_sum(list_transform(string_split(array_to_string(list_transform(label, lambda x: printf('%.3f', round_even(x, 3))), ','), ','),
                                     lambda s: CAST(s AS DOUBLE))), 9) AS parsed_sum
FROM soft_vector""")
def round_format_parse(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    s = sv.select("id", L.format_vector(L.round_vector("label", 3), 3).alias("formatted"))
    return rounded(s.select("id", "formatted", L.vsum(L.parse_vector("formatted")).alias("parsed_sum")))


@query("label_map", ops="P15", sql=f"""
SELECT id, n.name, round(label[n.k], 9) AS prob
FROM soft_vector, (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(EMOTION_NAMES))}) n(k, name)""")
def label_map(spark, sf_dir):
    sv = X.soft_vector(spark, sf_dir)
    m = sv.select("id", F.explode(L.label_map(EMOTION_NAMES, "label")).alias("name", "prob"))
    return rounded(m)


@query("label_index", ops="P16 P2 P4", sql=f"""
SELECT id, cls, CAST(CASE cls {' '.join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(LANG_NAMES))} ELSE 1 END AS INTEGER) AS idx,
       CAST(CASE cls {' '.join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(LANG_NAMES))} END AS INTEGER) AS mapped,
       CAST(CASE cls {' '.join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(LANG_NAMES))} END - 1 AS INTEGER) AS shifted
FROM texts""")
def label_index(spark, sf_dir):
    t = X.texts(spark, sf_dir)
    mapped = L.map_label("cls", {n: i + 1 for i, n in enumerate(LANG_NAMES)}).cast("int")
    return t.select("id", "cls", L.label_index(LANG_NAMES, "cls", default=1).alias("idx"),
                    mapped.alias("mapped"), L.shift_label(mapped).alias("shifted"))


@query("borderline_weight", ops="P27", sql="""
SELECT id, round(least(greatest(0.1 + 0.9 * pow(2 * abs(p - 0.5), 2.0), 0.1), 1.0), 9) AS weight FROM soft_binary""")
def borderline_weight(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir)
    return rounded(sb.select("id", L.borderline_weight("p", 2.0, 0.1).alias("weight")))


@query("binary_vector", ops="P10", sql="""
SELECT id, round(1 - p, 9) AS p0, round(p, 9) AS p1 FROM soft_binary""")
def binary_vector(spark, sf_dir):
    sb = X.soft_binary(spark, sf_dir).select("id", L.to_binary_vector("p").alias("v"))
    return rounded(sb.select("id", F.col("v")[0].alias("p0"), F.col("v")[1].alias("p1")))
