"""The queries of this subpackage's operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, crosstok, decontam, exactdedup, fingerprint, langid, lmscore, minhash, packing, quality, substring, variants


@dataclass
class LlmQuery:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = LlmQuery(fn, sql)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAT_PROBE = "\\### Assistant: </turn> ok"

_SQL_ESCAPED = r"replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '<next>', '\n'), '</turn>', '\e')"
OP1_SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CHAT_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{CHAT_PROBE}'),
marked AS (
  SELECT *, {_SQL_ESCAPED} AS safe,
    CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS head
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(safe)) + sum(head) * 13 + sum(CASE WHEN head = 1 THEN length(role) ELSE 0 END)
    + sum(1 - head) * 6)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CHAT_PROBE).alias("text"))
    done = chat.format_chats(own.unionByName(probe))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids and back, as digests."""
    import public_tokenizers
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decode=True)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_multiset_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    done = fingerprint.edited(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint.as_hex(F.col("fp")).alias("fingerprint"),
                       fingerprint.as_hex(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that start earlier elsewhere."""
    done = substring.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), n=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for every window of the benchmark."""
    done = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the smallest id that links reach."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their posterior of being good and not toxic."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True))
    model = langid.fit(docs.filter(~out).select("doc_id", "text", "lang"))
    done = langid.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against good labelled ones and against all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lmscore.score(docs, lmscore.fit(docs, good))


@query("op9_packed_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, packed."""
    import public_tokenizers
    return packing.packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, with the forms they vary."""
    return variants.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


@query("op12_exact_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the first half of the ids as a snapshot, the others screened against it."""
    done = exactdedup.exact_duplicates(table(spark, sf_dir, "documents"), scratch_path(spark, "exact-store"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op13_cross_tokenizer")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two vocabularies, aligned and counted over the corpus."""
    import public_tokenizers
    return crosstok.link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))
