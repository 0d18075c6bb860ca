"""Corpus diversity (A23, A24) and text summaries.

Tokens are produced once per document (``tokenize``) in their own
projection; n-grams are exploded from shifted slices.  Distinct counts are
hash aggregations: each task de-duplicates its own n-grams before the
shuffle, so a very frequent n-gram costs one row per task, not one per
occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NGRAM_SEP, ngrams, token_count, tokenize
from .common import scalar_of
from .ranking import exact_quantiles

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens_of(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, tokenize(text).alias("tokens"))


def ngram_rows(df: DataFrame, n: int, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per n-gram occurrence: keep cols + ``gram``."""
    t = tokens_of(df, text, keep)
    return t.select(*keep, F.explode(ngrams("tokens", n)).alias("gram"))


GRAM_TOKENS = 1 << 19     # tokens whose n-grams are counted together


def ngram_counts(df: DataFrame, n: int, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """keep cols + ``gram`` + ``n``: the n-grams of some rows at a time, each once with
    its count, so that those that repeat are few rows before they are aggregated."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return tokens_of(df, text, keep).mapInArrow(_counted(n, list(keep)), f"{kinds}{', ' if keep else ''}gram string, n long")


def _counted(n: int, keep: list[str]):
    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            first = np.asarray(tokens.offsets)
            cuts = np.unique(np.searchsorted(first, np.arange(first[0], first[-1], GRAM_TOKENS)))
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                words = part.column("tokens").flatten()
                row = np.repeat(np.arange(b - a), np.diff(first[a:b + 1]))
                at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.empty(0, np.int64)
                parts = [words.take(pa.array(at + i)) for i in range(n)]
                gram = pc.binary_join_element_wise(*parts, NGRAM_SEP) if n > 1 else parts[0]
                table = pa.table([*(part.column(c).take(pa.array(row[at])) for c in keep), gram], names=[*keep, "gram"])
                out = table.group_by([*keep, "gram"], use_threads=False).aggregate([([], "count_all")])
                yield from out.rename_columns([*keep, "gram", "n"]).to_batches()
    return run


def vocab_size(df: DataFrame, text: str = "text", by: Sequence[str] = (),
               approx: bool = False) -> DataFrame:
    """Distinct tokens (per group).  ``approx`` uses HyperLogLog++."""
    toks = tokens_of(df, text, by).select(*by, F.explode("tokens").alias("tok"))
    agg = F.approx_count_distinct("tok") if approx else F.count_distinct("tok")
    return toks.groupBy(*by).agg(agg.alias("vocab_size"),
                                 F.count(F.lit(1)).alias("n_tokens"))


def distinct_n(df: DataFrame, n: int, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Unique n-grams / total n-grams over the corpus (0.0 if none)."""
    g = ngram_counts(df, n, text, by).groupBy(*by, "gram").agg(F.sum("n").alias("n"))
    a = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    out = a.withColumn(f"distinct_{n}", F.when(F.col("n_total") > 0,
                                               F.col("n_unique") / F.col("n_total")).otherwise(0.0))
    if by:
        return out
    # a corpus with no n-grams still yields one row
    return out.select("n_unique", "n_total", f"distinct_{n}")


def ngram_freq(df: DataFrame, n: int, id_col: str = "id", text: str = "text",
               min_docs: int = 1) -> DataFrame:
    """Per n-gram (total count, number of documents containing it).

    Texts are dealt by document, so that (doc, gram) is aggregated where the
    text is; a task sends each distinct n-gram once, with its counts."""
    g = ngram_rows(df.select(id_col, text).repartition(id_col), n, text, [id_col])
    per_doc = g.groupBy("gram", id_col).agg(F.count(F.lit(1)).alias("c"))
    out = per_doc.groupBy("gram").agg(F.sum("c").alias("total_count"),
                                      F.count(F.lit(1)).alias("doc_count"))
    return out.filter(F.col("doc_count") >= min_docs) if min_docs > 1 else out


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """A1: counts (or shares) per value.  The total is a scalar subquery."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return c
    tot = scalar_of(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    return c.select(col, "count", (F.col("count") / tot).alias("share"))


def describe_by(df: DataFrame, key: str, x: ColumnOrName) -> DataFrame:
    """A2: count, mean, sample std, min, quartiles (linear), max per key.  The
    quartiles are order statistics of the distinct values and their counts; no
    task holds the values of a key."""
    v = _c(x).cast("double")
    rows = df.select(key, v.alias("_v"))
    plain = rows.groupBy(F.col(key).alias("_key")).agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    quartiles = exact_quantiles(rows, "_v", (0.25, 0.5, 0.75), "_q", [key])
    both = plain.join(quartiles, F.col("_key").eqNullSafe(F.col(key)), "left")
    return both.select(F.col("_key").alias(key), "count", "mean", "std", "min",
                       *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def length_summary(df: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """A3: mean and sample std of token counts."""
    t = df.select(*by, token_count(text).alias("n_tok"))
    return t.groupBy(*by).agg(F.avg("n_tok").alias("mean_tokens"),
                              F.stddev_samp("n_tok").alias("std_tokens"),
                              F.count(F.lit(1)).alias("n_texts"))


def quantile_range(df: DataFrame, x: ColumnOrName, pairs: Sequence[tuple[float, float]],
                   approx: bool = False) -> DataFrame:
    """A4: linearly interpolated (lo, hi) quantiles, one row per pair."""
    v = _c(x).cast("double")
    qs = sorted({q for pr in pairs for q in pr})
    a = df.agg(F.percentile_approx(v, qs, 100000).alias("_q")) if approx else exact_quantiles(df, v, qs, "_q")
    idx = {q: i + 1 for i, q in enumerate(qs)}
    rows = F.array(*[F.struct(F.lit(lo).alias("q_lo"), F.lit(hi).alias("q_hi"),
                              F.element_at("_q", idx[lo]).cast("double").alias("lo"),
                              F.element_at("_q", idx[hi]).cast("double").alias("hi"))
                     for lo, hi in pairs])
    return a.select(F.inline(rows))
