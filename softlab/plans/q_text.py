"""Text and diversity queries: P3, P5, P24–P26, P29, A1–A4, A23, A24."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diversity as D
from ..sources import fixtures as X
from .registry import query, rounded

P = T.TOKEN_PATTERN.replace("'", "''")
W = T.WS
TOK = f"regexp_extract_all(coalesce(text, ''), '{P}')"
QPAIRS = [(0.001, 0.999), (0.005, 0.995), (0.025, 0.975)]


def _clean_sql(x: str) -> str:
    t = f"regexp_replace(lower({x}), '[^a-zA-Z0-9{W}]', '', 'g')"
    t = f"regexp_replace({t}, '[{W}]+', ' ', 'g')"
    return f"regexp_replace({t}, '^[{W}]+|[{W}]+$', '', 'g')"


@query("clean_text", ops="P5 P29", sql=f"""
SELECT id, md5({_clean_sql('text')}) AS clean_md5, CAST(length({_clean_sql('text')}) AS INTEGER) AS clean_chars
FROM texts""")
def clean_text(spark, sf_dir):
    t = X.texts(spark, sf_dir).select("id", T.clean_text("text").alias("c"))
    return t.select("id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_chars"))


@query("null_safe_concat", ops="P3 S5", sql="""
SELECT conv_id, turn, md5(coalesce(prompt, '') || ' ' || coalesce(response, '')) AS joined_md5,
       CAST(length(coalesce(prompt, '') || ' ' || coalesce(response, '')) AS INTEGER) AS joined_chars,
       CAST(response IS NULL AS INTEGER) AS right_missing
FROM responses""")
def null_safe_concat(spark, sf_dir):
    r = X.responses(spark, sf_dir).select("conv_id", "turn", T.null_safe_concat("prompt", "response").alias("j"),
                                         F.col("response").isNull().cast("int").alias("right_missing"))
    return r.select("conv_id", "turn", F.md5("j").alias("joined_md5"),
                    F.length("j").alias("joined_chars"), "right_missing")


@query("strip_text", ops="P29", sql=f"""
SELECT conv_id, turn, CAST(length(regexp_replace(prompt, '^[{W}]+|[{W}]+$', '', 'g')) AS INTEGER) AS stripped_chars,
       CAST(length(prompt) AS INTEGER) AS raw_chars
FROM responses""")
def strip_text(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    return r.select("conv_id", "turn", F.length(T.strip_text("prompt")).alias("stripped_chars"),
                    F.length("prompt").alias("raw_chars"))


@query("token_lengths", ops="P24 P25", sql=f"""
SELECT id, cls, CAST(len({TOK}) AS INTEGER) AS n_tokens FROM texts""")
def token_lengths(spark, sf_dir):
    t = X.texts(spark, sf_dir)
    return t.select("id", "cls", T.token_count("text").alias("n_tokens"))


@query("length_describe", ops="A2 P24", sql=f"""
SELECT cls, count(n) AS count, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS std,
       round(min(n), 9) AS min, round(quantile_cont(n, 0.25), 9) AS q25,
       round(quantile_cont(n, 0.5), 9) AS q50, round(quantile_cont(n, 0.75), 9) AS q75,
       round(max(n), 9) AS max
FROM (SELECT cls, CAST(len({TOK}) AS DOUBLE) AS n FROM texts) GROUP BY cls""")
def length_describe(spark, sf_dir):
    t = X.texts(spark, sf_dir).select("cls", T.token_count("text").alias("n"))
    return rounded(D.describe_by(t, "cls", "n"))


@query("length_summary", ops="A3", sql=f"""
SELECT cls, round(avg(n), 9) AS mean_tokens, round(stddev_samp(n), 9) AS std_tokens, count(*) AS n_texts
FROM (SELECT cls, len({TOK}) AS n FROM texts) GROUP BY cls""")
def length_summary(spark, sf_dir):
    return rounded(D.length_summary(X.texts(spark, sf_dir), "text", ["cls"]))


@query("length_quantiles", ops="A4", sql=f"""
WITH n AS (SELECT CAST(len({TOK}) AS DOUBLE) AS n FROM texts)
""" + "\nUNION ALL\n".join(
    f"SELECT CAST({a} AS DOUBLE) AS q_lo, CAST({b} AS DOUBLE) AS q_hi, round(quantile_cont(n, {a}), 9) AS lo, "
    f"round(quantile_cont(n, {b}), 9) AS hi FROM n" for a, b in QPAIRS))
def length_quantiles(spark, sf_dir):
    t = X.texts(spark, sf_dir).select(T.token_count("text").alias("n"))
    return rounded(D.quantile_range(t, "n", QPAIRS))


@query("value_counts", ops="A1", sql="""
SELECT cls, count(*) AS count, round(count(*) / (SELECT count(*) FROM texts), 9) AS share
FROM texts GROUP BY cls""")
def value_counts(spark, sf_dir):
    return rounded(D.value_counts(X.texts(spark, sf_dir), "cls", normalize=True))


@query("vocab_size_by_lang", ops="A23 P25", sql=f"""
SELECT cls, count(DISTINCT tok) AS vocab_size, count(*) AS n_tokens
FROM (SELECT cls, unnest({TOK}) AS tok FROM texts) GROUP BY cls""")
def vocab_size_by_lang(spark, sf_dir):
    return D.vocab_size(X.texts(spark, sf_dir), "text", ["cls"])


@query("vocab_size", ops="A23", sql=f"""
SELECT count(DISTINCT tok) AS vocab_size, count(*) AS n_tokens
FROM (SELECT unnest({TOK}) AS tok FROM texts)""")
def vocab_size(spark, sf_dir):
    return D.vocab_size(X.texts(spark, sf_dir), "text")


def _grams_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"tk[i + {j}]" for j in range(n))
    return f"""(SELECT id, cls, unnest(list_transform(range(1, len(tk) - {n - 2}), lambda i: {parts})) AS gram
              FROM (SELECT id, cls, {TOK} AS tk FROM texts))"""


for _n in (2, 3):
    def _mk(n):
        def fn(spark, sf_dir):
            return rounded(D.distinct_n(X.texts(spark, sf_dir), n))
        return fn
    query(f"distinct_{_n}", ops="A24 P26", sql=f"""
SELECT count(DISTINCT gram) AS n_unique, count(*) AS n_total,
       round(CASE WHEN count(*) > 0 THEN count(DISTINCT gram) / count(*) ELSE 0.0 END, 9) AS distinct_{_n}
FROM {_grams_sql(_n)}""")(_mk(_n))


@query("distinct_2_by_run", ops="A24 per generation run", sql=f"""
SELECT run, count(DISTINCT gram) AS n_unique, count(*) AS n_total,
       round(count(DISTINCT gram) / count(*), 9) AS distinct_2
FROM (SELECT t.run, g.gram FROM {_grams_sql(2)} g JOIN texts t USING (id)) GROUP BY run""")
def distinct_2_by_run(spark, sf_dir):
    return rounded(D.distinct_n(X.texts(spark, sf_dir), 2, by=["run"]))


@query("ngram_freq_min2", ops="A24 X5", sql=f"""
SELECT gram, count(*) AS total_count, count(DISTINCT id) AS doc_count
FROM {_grams_sql(2)} GROUP BY gram HAVING count(DISTINCT id) >= 2""")
def ngram_freq_min2(spark, sf_dir):
    return D.ngram_freq(X.texts(spark, sf_dir), 2, "id", min_docs=2)
