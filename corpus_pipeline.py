"""Corpus pipeline: raw documents to token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result to the shared folder as Parquet and reads it again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

Decisions belong to rows, not to ids: rows of one id with different texts, and
rows without id, are judged by their own text.  Near-dedup keeps rows without
id.  Equal rows have equal decisions (near-dedup keeps one of them).  Empty
tables give empty results; null texts pass as texts without words; texts are
whole, however long; columns beside those of ``documents`` stay as they are.
Each stage first releases what earlier jobs left in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from softlab.llm import bpe, decontam, minhash, quality, substring
from softlab.llm.queries import LlmQuery, table
from softlab.session import release, shared_table

#: Words of a repeated passage; passages of over 50 words are to go, and their ends may touch other text.
PASSAGE_WORDS = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ROW = "_pipeline_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (good and not toxic)."""
    release(spark)
    marked = docs.withColumn(ROW, F.xxhash64(*docs.columns))
    done = quality.classify(marked, table(spark, sf_dir, "labels"), carry=(ROW,))
    kept = done.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col(ROW).alias("_kept_row")).distinct()
    own = marked["doc_id"].eqNullSafe(kept["_kept_id"]) & (marked[ROW] == kept["_kept_row"])
    return marked.join(kept, own, "left_semi").drop(ROW)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity
    0.8), the one of the smallest id; a document is an id with a text."""
    release(spark)
    marked = docs.withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))))
    kept = minhash.near_duplicates(marked, id_col=ROW, shingle=5, percent=80).filter("kept").select(ROW).dropna().distinct()
    rows = marked.join(kept, ROW, "left_semi").groupBy(ROW).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.select("row.*").unionByName(docs.filter("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start earlier in the corpus; other
    text stays as it is."""
    release(spark)
    done = substring.repeats(docs, n=PASSAGE_WORDS, keep="text")
    done = done.withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    release(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    marked = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), carry=others)
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    release(spark)
    import public_tokenizers
    ids = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can express neither the fitted classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = LlmQuery(run, ORACLE_SQL)
