"""Model-call loops and published sinks over whole tables.

The client is a pure function of the prompt, so SQL can repeat what it returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as INF
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import readers as RD
from ..sources import writers as WR
from .registry import query, rounded

ROUNDS = 4
ANSWER = "label double, text string"


def _client():
    """Label from the prompt's length, text from its ends; no answer for lengths divisible by 7."""
    def answer(prompts):
        return [None if len(p) % 7 == 0 else {"label": len(p) % 11 / 10, "text": p[:20] + "|" + p[-20:]} for p in prompts]
    return answer


def _requests(spark, sf_dir):
    """Every turn of every conversation, dealt to rounds by its hash."""
    c = X.table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"),
                    F.pmod(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int"), F.lit(ROUNDS)).alias("round"))


_REQUESTS = f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS prompt,
  CAST(('0x' || substr(md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)), 1, 4)) AS INT) % {ROUNDS} AS round FROM conversations)"""


def _answered(prompt: str = "prompt") -> str:
    n = f"length({prompt})"
    tail = f"CASE WHEN {n} <= 20 THEN {prompt} ELSE substr({prompt}, {n} - 19) END"
    return f"{n} % 11 / 10.0 AS label, substr({prompt}, 1, 20) || '|' || {tail} AS text"


@query("generate_rounds", ops="G5 G8 P30 F14 S8", sql=f"""{_REQUESTS}
SELECT conv_id, turn, round, {_answered()} FROM q WHERE length(prompt) % 7 <> 0""")
def generate_rounds(spark, sf_dir):
    """Rounds until every request was made, stopped after the second and taken up from the log."""
    req = _requests(spark, sf_dir)
    log, out = scratch_path(spark, "generation-log"), scratch_path(spark, "generated")
    each = [req.filter(F.col("round") == i).drop("round") for i in range(ROUNDS)]
    valid = lambda d: F.col("label").isNotNull()
    total = req.filter(F.length("prompt") % 7 != 0).count()
    try:
        INF.generate_until(lambda i: each[i], total, _client(), out, ANSWER, valid, max_rounds=2, log=log)
    except RuntimeError:
        pass     # two rounds aren't enough
    INF.generate_until(lambda i: each[i], total, _client(), out, ANSWER, valid, max_rounds=ROUNDS, log=log)
    return spark.read.schema("conv_id long, turn int, label double, text string, round int").json(out) \
        .select(*[F.col(c).cast(req.schema[c].dataType) for c in ("conv_id", "turn")], "round", "label", "text")


def _feedback_sql() -> str:
    parts, pool = [], "''"
    for i in range(ROUNDS):
        parts.append(f"t{i} AS (SELECT conv_id, turn, {i} AS round, {_answered(f'({pool} || prompt)')} FROM q "
                     f"WHERE round = {i} AND length({pool} || prompt) % 7 <> 0)")
        seen = " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(i + 1))
        parts.append(f"s{i} AS (SELECT string_agg(text, ';' ORDER BY label DESC, conv_id, turn) || ' ' AS shots FROM "
                     f"(SELECT * FROM ({seen}) ORDER BY label DESC, conv_id, turn LIMIT 3))")
        pool = f"(SELECT shots FROM s{i})"
    return f"{_REQUESTS}, {', '.join(parts)} {' UNION ALL '.join(f'SELECT * FROM t{j}' for j in range(ROUNDS))}"


@query("feedback_rounds", ops="G9 G5 U2 N15", sql=_feedback_sql())
def feedback_rounds(spark, sf_dir):
    """Each round's prompts begin with the three best answers so far."""
    req = _requests(spark, sf_dir)

    def make(i, pool):
        own = req.filter(F.col("round") == i)
        if pool is None:
            return own
        shots = pool.agg(F.array_sort(F.collect_list(F.struct((-F.col("label")).alias("l"), "conv_id", "turn", "text"))).alias("p"))
        head = F.concat(F.array_join(F.transform("p", lambda s: s["text"]), ";"), F.lit(" "))
        return own.withColumn("prompt", F.concat(shots.select(head).scalar(), F.col("prompt")))     # three rows at most

    best = lambda t: t.orderBy(F.desc("label"), "conv_id", "turn").limit(3)
    done = INF.feedback_loop(make, ROUNDS, _client(), ANSWER, lambda d: F.col("label").isNotNull(), 1, best, log=scratch_path(spark, "feedback-log"))
    return done.select("conv_id", "turn", "round", "label", "text")


def _embedder():
    """Length and two letter counts; texts with a digit 7 fail."""
    def vectors(texts):
        if any("7" in t for t in texts):
            raise ValueError("no sevens")
        return [[len(t), t.count("e"), t.count("a")] for t in texts]
    return vectors


@query("embeddings_sink_roundtrip", ops="G7 S10 S3", sql="""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id AS id, CASE WHEN t LIKE '%7%' THEN NULL ELSE CAST(length(t) AS DOUBLE) END AS n_chars,
  CASE WHEN t LIKE '%7%' THEN NULL ELSE CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) END AS n_e,
  CASE WHEN t LIKE '%7%' THEN 'ValueError: no sevens' END AS error FROM d""")
def embeddings_sink_roundtrip(spark, sf_dir):
    """Whole texts embedded one by one (a failure fails one row), written once, refused a second time, read back."""
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "embeddings")
    WR.write_embeddings(INF.embed(d, "text", _embedder(), batch=1, retries=0), path)
    try:
        WR.write_embeddings(d, path)
        raise AssertionError("written twice")
    except FileExistsError:
        pass
    e = RD.read_embeddings(spark, path)
    return e.select("id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_e"), "error")


@query("training_snapshots", ops="S11 U2", sql="""
WITH d AS (SELECT doc_id AS id, text, doc_id % 3 AS part FROM documents WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT 'iter_00000' AS snapshot, 0 AS last UNION ALL SELECT 'iter_00002', 2 UNION ALL SELECT 'final', 2)
SELECT snapshot, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM d JOIN s ON d.part <= s.last GROUP BY snapshot""")
def training_snapshots(spark, sf_dir):
    """A training set that grows by a third each iteration; snapshots of every second one and of the last."""
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 3).alias("part"))
    d = d.filter("text is not null and text <> ''")
    path, out = scratch_path(spark, "snapshots"), None
    for i in range(3):
        WR.snapshot_training_set(d.filter(F.col("part") <= i).drop("part"), path, i, 2)
    WR.snapshot_training_set(d.drop("part"), path, 3, -1, final=True)
    for name in ("iter_00000", "iter_00002", "final"):
        got = WR.read_snapshot(spark, path, name, "id long, text string").agg(
            F.lit(name).alias("snapshot"), F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))
        out = got if out is None else out.unionByName(got)
    return out
