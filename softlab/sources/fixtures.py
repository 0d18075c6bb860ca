"""Soft-label views over the driver tables.

The reference consumes generated JSONL corpora, gold corpora and embedding
matrices.  The driver tables stand in for them through these views; each is
defined twice, once as a Spark plan and once as a DuckDB ``SELECT`` used by
the independent SQL oracle.  The two definitions must stay equivalent.

| view             | from            | columns                                  |
| ---------------- | --------------- | ---------------------------------------- |
| soft_binary      | events          | id, p, y                                  |
| judged_binary    | events          | id, p, y, q                               |
| soft_binary_big  | lineitem        | p, y  (no key, heavy ties)                |
| soft_vector      | documents       | id, label array<double>[6], y             |
| judged_vector    | documents       | id, label, judged array<double>[6]        |
| emb_labeled      | embeddings      | id, embedding array<double>, label        |
| emb_multilabel   | embeddings+labels | id, embedding, quality, toxic           |
| texts            | documents       | id, text, cls (lang), run (source)        |
| gold_text        | documents+labels| id, text, y (quality)                     |
| responses        | conversations   | conv_id, turn, prompt, response           |
| idx_list         | events          | pos, idx                                  |
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.common import scalar_of

K_VECTOR = 6          # classes in the soft_vector fixture


# row keys of the driver tables: used to spread an under-split scan
TABLE_KEYS = {
    "documents": ["doc_id"], "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"],
    "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"], "labels": ["doc_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "orders": ["o_orderkey"],
    "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"],
}


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = True) -> DataFrame:
    """Read a driver table.  ``heavy=False`` marks callers whose per-row work
    is cheap (a few arithmetic ops): they read the scan as it is split."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if not heavy:
        return df
    return spread(df, TABLE_KEYS.get(name, []))


def spread(df: DataFrame, keys) -> DataFrame:
    """Hash-repartition a scan by ``keys`` into ``spark.softlab.scanPartitions``
    parts, where that setting is given: for local runs over files of one row
    group, whose per-row work would be one task.  Without it (a cluster, whose
    scans have splits enough) the scan is left as it is split."""
    parts = df.sparkSession.conf.get("spark.softlab.scanPartitions", None)
    cols = [F.col(k) for k in keys if k in df.columns]
    return df.repartition(int(parts), *cols) if parts and cols else df


# ------------------------------------------------------------------ binary
def soft_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", heavy=False)
    k = F.from_json(F.col("props"), "k INT").getField("k")          # P30
    return ev.select(
        F.col("event_id").alias("id"),
        (k.cast("double") / 100).alias("p"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
    )


def judged_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", heavy=False)
    k = F.from_json(F.col("props"), "k INT").getField("k")
    return ev.select(
        F.col("event_id").alias("id"),
        (k.cast("double") / 100).alias("p"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / scalar_of(ev.agg(F.max("value").alias("m"))).getField("m")).alias("q"),
    )


def soft_binary_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", heavy=False)
    return li.select(
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


# ------------------------------------------------------------------ vector
def _md5_weights(id_col, salt: str, k: int = K_VECTOR):
    return F.array(*[
        (F.lit(1) + F.conv(F.substring(F.md5(F.concat(id_col.cast("string"),
                                                        F.lit(f":{salt}{i}"))), 1, 4),
                           16, 10).cast("int")).cast("double")
        for i in range(k)])


def _normalised(w):
    return L.with_scalar(w, L.vsum(w), lambda x, t: x / t)


def _vector_truth(id_col, label):
    h = F.md5(F.concat(id_col.cast("string"), F.lit(":y")))
    noise = F.conv(F.substring(h, 2, 2), 16, 10).cast("int") % K_VECTOR
    return F.when(F.substring(h, 1, 1) < F.lit("8"), L.argmax(label)).otherwise(noise)


def soft_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=False).select("doc_id")
    lab = _normalised(_md5_weights(F.col("doc_id"), ""))
    return docs.select(F.col("doc_id").alias("id"), lab.alias("label")) \
        .withColumn("y", _vector_truth(F.col("id"), F.col("label")).cast("int"))


def judged_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", heavy=False).select("doc_id")
    return docs.select(
        F.col("doc_id").alias("id"),
        _normalised(_md5_weights(F.col("doc_id"), "")).alias("label"),
        _normalised(_md5_weights(F.col("doc_id"), "j")).alias("judged"),
    )


# -------------------------------------------------------------- embeddings
def emb_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("embedding"),
                    F.col("label").cast("int").alias("label"))


def emb_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb_labeled(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"))
    return e.join(lab, "id")


# -------------------------------------------------------------------- text
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text",
                    F.col("lang").alias("cls"), F.col("source").alias("run"))


def gold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"),
                                                F.col("quality").cast("int").alias("y"))
    return d.join(lab, "id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn paired with the next turn when that turn is the assistant's.

    An equi-join on (conv_id, turn+1): no window over a conversation, so a
    single huge conversation cannot land in one task."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"], "left")


def idx_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", heavy=False)
    return ev.select(F.col("event_id").alias("pos"), F.col("user_id").alias("idx"))


# ----------------------------------------------------- DuckDB definitions
def _duck_weights(id_expr: str, salt: str, k: int = K_VECTOR) -> str:
    parts = [f"CAST(1 + CAST(('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || ':{salt}{i}'), 1, 4)) "
             f"AS INTEGER) AS DOUBLE)" for i in range(k)]
    return "[" + ", ".join(parts) + "]"


def _duck_norm(w: str) -> str:
    return f"list_transform({w}, lambda x: x / list_sum({w}))"


_SV_LABEL = _duck_norm(_duck_weights("doc_id", ""))
_SV_JUDGED = _duck_norm(_duck_weights("doc_id", "j"))

DUCK = {
    "soft_binary": """
        SELECT event_id AS id,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100 AS p,
               CAST(event_type = 'purchase' AS INTEGER) AS y
        FROM events""",
    "judged_binary": f"""
        SELECT event_id AS id,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100 AS p,
               CAST(event_type = 'purchase' AS INTEGER) AS y,
               value / (SELECT max(value) FROM events) AS q
        FROM events""",
    "soft_binary_big": """
        SELECT l_discount * 10 AS p, CAST(l_returnflag = 'R' AS INTEGER) AS y
        FROM lineitem""",
    "soft_vector": f"""
        SELECT id, label,
               CAST(CASE WHEN substr(md5(CAST(id AS VARCHAR) || ':y'), 1, 1) < '8'
                         THEN list_position(label, list_max(label)) - 1
                         ELSE CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || ':y'), 2, 2)) AS INTEGER) % {K_VECTOR}
                    END AS INTEGER) AS y
        FROM (SELECT doc_id AS id, {_SV_LABEL} AS label FROM documents)""",
    "judged_vector": f"""
        SELECT doc_id AS id, {_SV_LABEL} AS label, {_SV_JUDGED} AS judged FROM documents""",
    "emb_labeled": """
        SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS INTEGER) AS label
        FROM embeddings""",
    "emb_multilabel": """
        SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS embedding,
               CAST(l.quality AS INTEGER) AS quality, CAST(l.toxic AS INTEGER) AS toxic
        FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id""",
    "texts": """
        SELECT doc_id AS id, text, lang AS cls, source AS run FROM documents""",
    "gold_text": """
        SELECT d.doc_id AS id, d.text, CAST(l.quality AS INTEGER) AS y
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "responses": """
        SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
        FROM conversations u
        LEFT JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'""",
    "idx_list": """
        SELECT event_id AS pos, user_id AS idx FROM events""",
}

SPARK = {
    "soft_binary": soft_binary, "judged_binary": judged_binary,
    "soft_binary_big": soft_binary_big, "soft_vector": soft_vector,
    "judged_vector": judged_vector, "emb_labeled": emb_labeled,
    "emb_multilabel": emb_multilabel, "texts": texts, "gold_text": gold_text,
    "responses": responses, "idx_list": idx_list,
}


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the fixture views it mentions."""
    import re
    used = [n for n in DUCK if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({DUCK[n]})" for n in used)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def _register_loaders():
    """The fixture views are the registered synthetic / oracle loaders."""
    from .readers import register_oracle, register_synthetic
    for name, fn in SPARK.items():
        register_synthetic(name, fn)
    register_oracle("gold_text", gold_text)
    register_oracle("emb_labeled", emb_labeled)


_register_loaders()
