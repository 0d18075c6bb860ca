"""Source / sink, streaming and prompt-table queries: S1, S2, S8, T1, T2,
G1–G4, G6, G10, N14."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import prompts as G
from ..operators import sampling as S
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import readers as RD
from ..sources import writers as WR
from ..streaming import ingest as ST
from .registry import query, rounded
from .sqlhelp import bin_lc
from ..operators.binning import linspace_edges

SEED = 42
TWO52 = "CAST(4503599627370496 AS DOUBLE)"
NONBLANK = f"regexp_matches(coalesce(text, ''), '[^{WS}]')"


# ------------------------------------------------------------- streaming
def _stream_lines(spark, sf_dir):
    """events rewritten as JSON lines: out-of-range labels for large values,
    blank text for errors, a truncated (corrupt) line for user 0."""
    ev = X.table(spark, sf_dir, "events")
    k = F.from_json(F.col("props"), "k INT").getField("k")
    label = F.when(F.col("value") > 400, F.lit(1.5)).otherwise(k.cast("double") / 100)
    text = F.when(F.col("event_type") == "error", F.lit("   ")) \
        .otherwise(F.concat(F.col("event_type"), F.lit(" event from user "), F.col("user_id").cast("string")))
    rec = F.to_json(F.struct(F.col("event_id").alias("id"), label.alias("label"), text.alias("text"),
                             F.col("props").alias("reasoning")))
    line = F.when(F.col("user_id") == 0, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"),
                                                  F.lit(', "label": '))).otherwise(rec)
    return ev.select("event_id", line.alias("value"))


def _write_stream_input(spark, sf_dir):
    d = scratch_path(spark, "stream-in")
    _stream_lines(spark, sf_dir).select("value").write.text(d)
    return d


_STREAM_SQL = f"""
WITH s AS (
  SELECT event_id AS id, user_id = 0 AS corrupt,
         CASE WHEN value > 400 THEN 1.5 ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100 END AS label,
         CASE WHEN event_type = 'error' THEN '   ' ELSE event_type || ' event from user ' || CAST(user_id AS VARCHAR) END AS text
  FROM events),
v AS (SELECT *, CASE WHEN corrupt THEN 'corrupt' WHEN label < 0 OR label > 1 THEN 'label_out_of_range'
                     WHEN NOT {NONBLANK} THEN 'blank_text' ELSE 'valid' END AS status FROM s)"""


@query("stream_ingest", ops="T1 S2 F14 (stream == batch)", sql=_STREAM_SQL + """
SELECT id, round(label, 9) AS label, text FROM v WHERE status = 'valid'""")
def stream_ingest(spark, sf_dir):
    in_dir = _write_stream_input(spark, sf_dir)
    out = scratch_path(spark, "stream-out")
    ST.stream_ingest(spark, in_dir, out, scratch_path(spark, "stream-ckpt"), "binary")
    return rounded(spark.read.parquet(f"{out}/valid").select("id", "label", "text"))


@query("stream_progress", ops="T2 A5", sql=_STREAM_SQL + f"""
SELECT status, CASE WHEN status = 'valid' THEN {bin_lc('label', linspace_edges(10))} END AS bin, count(*) AS n
FROM v GROUP BY 1, 2""")
def stream_progress(spark, sf_dir):
    in_dir = _write_stream_input(spark, sf_dir)
    out = scratch_path(spark, "progress-out")
    ST.running_progress(spark, in_dir, out, scratch_path(spark, "progress-ckpt"))
    return spark.read.parquet(out)


# ------------------------------------------------------------ file sinks
def _gen_label():
    return F.bround(S.hash_uniform(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":gen")))), 3)


@query("generated_jsonl_roundtrip", ops="S8 S2 P30", sql=f"""
SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_corrupt,
       round(sum(round_even(CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':gen'), 1, 13)) AS BIGINT) AS DOUBLE) / {TWO52}, 3)), 6) AS label_sum,
       CAST(sum(length(text)) AS BIGINT) AS text_chars
FROM documents""")
def generated_jsonl_roundtrip(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(_gen_label().alias("label"), "text",
                                                   F.lit(None).cast("string").alias("reasoning"))
    path = scratch_path(spark, "generated")
    WR.append_generated(d, path)
    back = RD.read_generated(spark, path, "binary")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt_record").alias("n_corrupt"),
                    F.round(F.sum("label"), 6).alias("label_sum"),
                    F.sum(F.length("text")).alias("text_chars"))


@query("csv_labeled_roundtrip", ops="S1 P2 U1", sql="""
SELECT CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split,
       y AS labels, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS text_chars
FROM gold_text GROUP BY 1, 2""")
def csv_labeled_roundtrip(spark, sf_dir):
    g = X.gold_text(spark, sf_dir)
    h = F.substring(F.md5(F.col("id").cast("string")), 1, 1)
    sent = F.when(F.col("y") == 1, F.lit("positive")).otherwise(F.lit("negative"))
    base = scratch_path(spark, "csv")
    paths = {}
    for split, cond in (("train", h >= "4"), ("test", h < "4")):
        p = f"{base}/{split}"
        (g.filter(cond).select(F.col("text").alias("review"), sent.alias("sentiment"))
         .write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p))
        paths[split] = p
    back = RD.read_labeled_csv(spark, paths, "review", "sentiment", {"negative": 0, "positive": 1})
    return back.groupBy("split", "labels").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum(F.length("text")).alias("text_chars"))


# --------------------------------------------------------------- prompts
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SYSTEM_SQL = (f"replace(replace({_sql_str(G.IMDB_SYSTEM)}, '{{chain_of_thought_instructions}}', "
               f"{_sql_str(G.CHAIN_OF_THOUGHT)}), '{{examples_block}}', '')")


@query("render_prompts", ops="G3 G4", sql=f"""
SELECT id, md5({_SYSTEM_SQL}) AS system_md5,
       md5(replace({_sql_str(G.IMDB_HUMAN)}, '{{score}}', CAST(p AS VARCHAR))) AS human_md5,
       md5({_SYSTEM_SQL} || ' ' || replace({_sql_str(G.IMDB_HUMAN)}, '{{score}}', CAST(p AS VARCHAR))) AS merged_md5
FROM soft_binary""")
def render_prompts(spark, sf_dir):
    r = G.render_prompts(X.soft_binary(spark, sf_dir), "p", cot=True)
    return r.select("id", F.md5("system").alias("system_md5"), F.md5("human").alias("human_md5"),
                    F.md5(G.merge_messages("system", "human")).alias("merged_md5"))


def _hx(expr: str, digits: int = 15) -> str:
    return f"CAST(('0x' || substr({expr}, 1, {digits})) AS BIGINT)"


_FEWSHOT_SQL = f"""
WITH pr AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS prompt_id FROM responses),
np AS (SELECT count(*) AS n FROM texts),
ch AS (SELECT prompt_id, list_reduce(range((SELECT n FROM np) - 3, (SELECT n FROM np)),
          lambda acc, j: list_append(acc, CASE WHEN list_contains(acc,
              {_hx("md5('" + str(SEED) + ":' || prompt_id || ':' || CAST(j AS VARCHAR))")} % (j + 1))
              THEN j ELSE {_hx("md5('" + str(SEED) + ":' || prompt_id || ':' || CAST(j AS VARCHAR))")} % (j + 1) END),
          CAST([] AS BIGINT[])) AS pos FROM pr),
shots AS (SELECT prompt_id, s - 1 AS shot, pos[s] AS pos FROM ch, range(1, 4) r(s)),
pool AS (SELECT id, text, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) - 1 AS pos FROM texts),
ex AS (SELECT prompt_id, string_agg(replace('- Example ' || CAST(shot + 1 AS VARCHAR) || ': ' || text, chr(10), ''), chr(10) ORDER BY shot) AS body
       FROM shots JOIN pool USING (pos) GROUP BY prompt_id)"""


@query("few_shot_prompts", ops="N14 G1 G3", sql=_FEWSHOT_SQL + f"""
SELECT prompt_id, md5('Here are 3 examples to take advantage of:' || chr(10) || body || {_sql_str(G.EXAMPLES_FOOTER)}) AS block_md5
FROM ex""")
def few_shot_prompts(spark, sf_dir):
    r = X.responses(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"),
                                                      F.col("turn").cast("string")).alias("prompt_id"))
    pool = X.texts(spark, sf_dir).select("id", "text")
    shots = S.few_shot_sample(r, pool, 3, SEED, "prompt_id", "id")
    per = G.shots_per_prompt(shots, "prompt_id", "shot", "text")
    return per.select("prompt_id", F.md5(G.examples_block("examples")).alias("block_md5"))


@query("examples_block_learn", ops="G2", sql=_FEWSHOT_SQL.replace(
    "string_agg(replace('- Example ' || CAST(shot + 1 AS VARCHAR) || ': ' || text, chr(10), ''), chr(10) ORDER BY shot)",
    "string_agg('Example ' || CAST(shot + 1 AS VARCHAR) || ': ' || text || chr(10) || chr(10), '' ORDER BY shot)") + f"""
SELECT prompt_id, md5('Here are 3 examples to learn from:' || chr(10) || chr(10) || body || {_sql_str(G.LEARN_INSTRUCTION)}) AS block_md5
FROM ex""")
def examples_block_learn(spark, sf_dir):
    r = X.responses(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"),
                                                      F.col("turn").cast("string")).alias("prompt_id"))
    pool = X.texts(spark, sf_dir).select("id", "text")
    shots = S.few_shot_sample(r, pool, 3, SEED, "prompt_id", "id")
    per = G.shots_per_prompt(shots, "prompt_id", "shot", "text")
    return per.select("prompt_id", F.md5(G.examples_block_learn("examples")).alias("block_md5"))


@query("judge_defaults", ops="G6", sql="""
SELECT conv_id, turn,
       CASE WHEN response IS NOT NULL THEN round((length(response) % 101) / 100.0, 9) ELSE 0.5 END AS judge_score,
       CAST(CASE WHEN response IS NOT NULL THEN 0.9 ELSE 0.0 END AS DOUBLE) AS judge_confidence,
       CASE WHEN response IS NOT NULL THEN NULL ELSE 'no judgement' END AS error
FROM responses""")
def judge_defaults(spark, sf_dir):
    r = X.responses(spark, sf_dir)
    judged = r.filter(F.col("response").isNotNull()).select(
        "conv_id", "turn", ((F.length("response") % 101) / 100.0).alias("judge_score"),
        F.lit(0.9).alias("judge_confidence"))
    out = G.judge_with_defaults(r.select("conv_id", "turn"), judged, ["conv_id", "turn"])
    return rounded(out)


@query("posthoc_labels", ops="G10 J1", sql="""
SELECT g.id, round((length(d.text) % 101) / 100.0, 9) AS label
FROM gold_text g JOIN documents d ON d.doc_id = g.id""")
def posthoc_labels(spark, sf_dir):
    g = X.gold_text(spark, sf_dir).withColumnRenamed("y", "label")
    judged = X.texts(spark, sf_dir).select("id", ((F.length("text") % 101) / 100.0).alias("judge_score"))
    return rounded(G.posthoc_soft_labels(g, judged, "id").select("id", "label"))


@query("render_prompts_multi", ops="G3 J5 P14 P15 (template and class names from the dataset config)", sql=f"""
SELECT id,
       md5(replace({_sql_str(G.EMOTION_HUMAN)}, '{{score}}',
           '{{' || array_to_string(list_transform(range(1, 7),
               lambda k: '''' || ['sadness', 'joy', 'love', 'anger', 'fear', 'surprise'][k] || ''': '
                         || CAST(round_even(label[k], 3) AS VARCHAR)), ', ') || '}}')) AS human_md5,
       md5(replace({_sql_str(G.EMOTION_SYSTEM)}, '{{chain_of_thought_instructions}}', '')) AS system_md5
FROM soft_vector""")
def render_prompts_multi(spark, sf_dir):
    from ..operators import reshape as RS
    # dataset from the class count (a data-derived key keeps the lookup an equi-join)
    by_k = F.create_map(F.lit(6), F.lit("emotion"), F.lit(4), F.lit("agnews"), F.lit(2), F.lit("imdb"))
    req = X.soft_vector(spark, sf_dir).withColumn("dataset", F.element_at(by_k, F.size("label")))
    cfg = RS.dataset_config(spark)
    j = RS.lookup_config(req, cfg, "dataset")
    vals = {"score": G.format_distribution("class_names", "label"),
            "chain_of_thought_instructions": F.lit(""), "examples_block": F.lit("")}
    return j.select("id", F.md5(G.render_columns("human_template", vals)).alias("human_md5"),
                    F.md5(G.render_columns("system_template", vals)).alias("system_md5"))
